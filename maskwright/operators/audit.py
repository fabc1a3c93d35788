"""Audit of redacted paragraphs against what the same analysis expects of the original."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.storage import Tables

SURVIVOR = "struct<original_text:string,type:string,expected_replacement:string,actual_text:string,detector_source:string,confidence:double>"
CHANGE = "struct<expected:string,actual:string>"


@dataclass
class Report:
    """totals: one row; surviving and changes: a row for each case; by_category: total and survived of each type."""

    totals: DataFrame
    surviving: DataFrame
    changes: DataFrame
    by_category: DataFrame
    pairs: DataFrame

    def write(self, folder: str) -> None:
        """Each figure as a table of JSON lines, of any size; the comparison that all come from is made once."""
        made = report(Tables(self.pairs.sparkSession).put(self.pairs, "pairs"))
        for name in ("totals", "surviving", "changes", "by_category"):
            getattr(made, name).write.mode("overwrite").json(f"{folder}/{name}")

    def document(self) -> dict:
        """One report, for a single document: its rows come to the driver."""
        totals, rows = self.totals.first(), lambda df, *names: [{n: r[n] for n in names} | {"location": f"Paragraph {r['seq']}"} for r in df.orderBy("seq").collect()]
        return {
            "total_original_pii_candidates": totals["total"],
            "redacted_candidates": totals["redacted"],
            "coverage": totals["coverage"],
            "surviving_pii": rows(self.surviving, "original_text", "type", "expected_replacement", "actual_text", "detector_source", "confidence"),
            "unintended_changes": rows(self.changes, "expected", "actual"),
            "by_category": {r["category"]: {"total": r["total"], "survived": r["survived"]} for r in self.by_category.collect()},
        }


def _paired(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected with actual_text, null without a partner, and paired.

    Of paragraphs under one doc_id and seq those with equal texts are partners first, of which it doesn't matter which is
    whose; the others are taken in the order of their texts.
    """
    tables = Tables(expected.sparkSession)  # both are read several times
    one = tables.put(expected.select("doc_id", "seq", "text", "replaced", "redacted_text"), "expected")
    other = tables.put(actual.select("doc_id", "seq", "actual_text"), "actual")
    texts = one.select("doc_id", "seq", F.col("redacted_text").alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(other.select("doc_id", "seq", F.col("actual_text").alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = texts.groupBy("doc_id", "seq", "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toDF("k_doc", "k_seq", "k_t", "a", "b")

    def split(df: DataFrame, text: str, mine: str, theirs: str) -> tuple[DataFrame, DataFrame]:
        """Rows with a partner of their text, and the rest."""
        same = F.col("doc_id").eqNullSafe(F.col("k_doc")) & F.col("seq").eqNullSafe(F.col("k_seq")) & F.col(text).eqNullSafe(F.col("k_t"))
        known = df.join(counts, same, "left").drop("k_doc", "k_seq", "k_t")
        some = known.where((F.col(theirs) > 0) & (F.col(theirs) < F.col(mine))).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "seq", text).orderBy(F.lit(0))))
        all_or_none = known.where((F.col(theirs) == 0) | (F.col(theirs) >= F.col(mine)))
        met = all_or_none.where(F.col(theirs) > 0).select(*df.columns).unionByName(some.where(F.col("nth") <= F.col(theirs)).select(*df.columns))
        return met, all_or_none.where(F.col(theirs) == 0).select(*df.columns).unionByName(some.where(F.col("nth") > F.col(theirs)).select(*df.columns))

    met, left = split(one, "redacted_text", "a", "b")
    right = split(other, "actual_text", "b", "a")[1]
    nth = lambda text: F.row_number().over(Window.partitionBy("doc_id", "seq").orderBy(text))
    right = right.select("doc_id", "seq", "actual_text", nth("actual_text").alias("nth")).toDF("other_id", "other_seq", "actual_text", "other_nth")
    left = left.withColumn("nth", nth("redacted_text"))
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & F.col("seq").eqNullSafe(F.col("other_seq")) & (F.col("nth") == F.col("other_nth"))
    rest = left.join(right, same, "left").withColumn("paired", F.col("other_nth").isNotNull()).drop("other_id", "other_seq", "other_nth", "nth")
    return met.withColumns({"actual_text": F.col("redacted_text"), "paired": F.lit(True)}).unionByName(rest)


def compared(expected: DataFrame, actual: DataFrame, unpaired: str = "empty") -> DataFrame:
    """Every paragraph of expected with its partner by doc_id and seq, either of which may be null, with surviving and changes.

    unpaired: what has no partner counts as "empty", so that all its findings survive, or is "left out", as where of two
    lists the shorter one ends the comparison.

    expected: from pipeline.redact() on the original; actual: (doc_id, seq, actual_text). Where the texts differ, the
    original's spans and the gaps between them are looked for at the places that they should have: after a replacement
    of another length than expected, all that follows counts as changed.
    """
    if unpaired not in ("empty", "left out"):
        raise ValueError("unpaired is empty or left out")
    rows = _paired(expected, actual)
    if unpaired == "left out":
        rows = rows.where("paired")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("there"), F.array().cast(f"array<{SURVIVOR}>").alias("surviving"), F.array().cast(f"array<{CHANGE}>").alias("changes"))
    text, actual_text = F.col("text"), F.coalesce("actual_text", F.lit(""))

    def change(gap, found, changes):
        return F.when(gap != found, F.concat(changes, F.array(F.struct(gap.alias("expected"), found.alias("actual"))))).otherwise(changes)

    def step(s, e):
        gap = T.part(text, s["at"], e["start"])
        there = s["there"] + F.length(gap)
        found = T.part(actual_text, s["there"], there)
        stop = there + F.length(e["replacement"])
        span = T.part(actual_text, there, stop)
        kept = F.struct(e["text"].alias("original_text"), e["entity_type"].alias("type"), e["replacement"].alias("expected_replacement"), span.alias("actual_text"), e["detector"].alias("detector_source"), e["confidence"].alias("confidence"))
        return F.struct(
            e["end"].alias("at"), stop.alias("there"), F.when(span != e["replacement"], F.concat(s["surviving"], F.array(kept))).otherwise(s["surviving"]).alias("surviving"), change(gap, found, s["changes"]).alias("changes"),
        )

    def end(s):
        rest, found = text.substr(s["at"] + F.lit(1), F.length(text)), actual_text.substr(s["there"] + F.lit(1), F.length(actual_text))
        return F.struct(s["surviving"].alias("surviving"), change(rest, found, s["changes"]).alias("changes"))

    walked = F.when(F.col("redacted_text") != actual_text, F.aggregate("replaced", begin, step, end))
    rows = rows.withColumn("walked", T.once(walked))
    return rows.select("doc_id", "seq", "replaced", F.coalesce("walked.surviving", F.array().cast(f"array<{SURVIVOR}>")).alias("surviving"), F.coalesce("walked.changes", F.array().cast(f"array<{CHANGE}>")).alias("changes"))


def report(pairs: DataFrame) -> Report:
    """The figures of compared()."""
    totals = pairs.agg(F.coalesce(F.sum(F.size("replaced")), F.lit(0)).alias("total"), F.coalesce(F.sum(F.size("surviving")), F.lit(0)).alias("survived"), F.coalesce(F.sum(F.size("changes")), F.lit(0)).alias("unintended_changes"))
    totals = totals.select("total", (F.col("total") - F.col("survived")).alias("redacted"), "survived", "unintended_changes", F.coalesce(F.try_divide(F.col("total") - F.col("survived"), F.col("total")), F.lit(1.0)).alias("coverage"))
    surviving = pairs.select("doc_id", "seq", F.explode("surviving").alias("e")).select("doc_id", "seq", "e.*")
    changes = pairs.select("doc_id", "seq", F.explode("changes").alias("e")).select("doc_id", "seq", "e.*")
    count = lambda kind, total, survived: F.struct(kind.alias("category"), F.lit(total).alias("total"), F.lit(survived).alias("survived"))
    counts = F.concat(F.transform("replaced", lambda e: count(e["entity_type"], 1, 0)), F.transform("surviving", lambda e: count(e["type"], 0, 1)))
    found = pairs.select(F.explode(counts).alias("e")).groupBy("e.category").agg(F.sum("e.total").alias("total"), F.sum("e.survived").alias("survived"))
    return Report(totals, surviving, changes, found, pairs)


def audit(expected: DataFrame, actual: DataFrame, unpaired: str = "empty") -> Report:
    return report(compared(expected, actual, unpaired))

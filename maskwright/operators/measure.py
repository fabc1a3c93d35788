"""Counts of what the analysis did, and scores against expected findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T
from maskwright.storage import Tables


def stats(redacted: DataFrame) -> DataFrame:
    """Per document: paragraphs, candidates, those that resolution dropped or merged, replacements, and where they lie."""
    text = F.coalesce("text", F.lit(""))
    applied = F.filter("resolved", lambda e: (e["start"] < e["end"]) & (e["end"] <= F.length(text)))
    columns = redacted.columns
    table = F.col("loc.table_index").isNotNull() if "loc" in columns else F.lit(False)
    edge = (F.coalesce("loc.is_header", F.lit(False)) | F.coalesce("loc.is_footer", F.lit(False))) if "loc" in columns else F.lit(False)
    rows = redacted.select("doc_id", F.size("candidates").alias("c"), F.size("resolved").alias("r"), F.size(applied).alias("a"), F.size(F.filter("resolved", lambda e: e["confidence"] < V.NAME_MODEL)).alias("low"), table.alias("table"), edge.alias("edge"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("processed_paragraphs"),
        F.sum("c").alias("total_candidates"),
        F.sum(F.col("c") - F.col("r")).alias("rejected_by_resolver"),
        F.sum("a").alias("entities_replaced"),
        F.sum(F.when(F.col("table"), F.col("a")).otherwise(0)).alias("replacements_in_tables"),
        F.sum(F.when(F.col("edge"), F.col("a")).otherwise(0)).alias("replacements_in_headers_footers"),
        F.sum("low").alias("low_confidence_entities"),
    )


def counts_by_type(entities: DataFrame, *by: str) -> DataFrame:
    return entities.groupBy(*by, "entity_type").agg(F.count("*").alias("n"))


def matched(predictions: Column, expected: Column, mode: str = "containment") -> Column:
    """Struct (hits, false_positives, false_negatives): each prediction takes the first expected one, not yet taken, that fits.

    They fit if the types are equal and, by mode, one text holds the other ("containment") or the texts are equal ("exact").
    """
    if mode not in ("containment", "exact"):
        raise ValueError("mode is containment or exact")

    def fits(p, g):
        same = p["text"] == g["text"]
        return (p["entity_type"] == g["type"]) & (same if mode == "exact" else same | F.contains(g["text"], p["text"]) | F.contains(p["text"], g["text"]))

    pred = "array<struct<text:string,entity_type:string,start:int,end:int,confidence:double,detector:string,ord:int>>"
    begin = F.struct(expected.cast("array<struct<type:string,text:string>>").alias("left"), F.array().cast("array<string>").alias("hits"), F.array().cast(pred).alias("wrong"))

    def step(s, p):
        at = F.array_position(F.transform(s["left"], lambda g: fits(p, g)), True).cast("int")
        left = F.when(at > 0, F.filter(s["left"], lambda g, i: i != at - 1)).otherwise(s["left"])
        hits = F.when(at > 0, F.concat(s["hits"], F.array(p["entity_type"]))).otherwise(s["hits"])
        return F.struct(left.alias("left"), hits.alias("hits"), F.when(at > 0, s["wrong"]).otherwise(F.concat(s["wrong"], F.array(p))).alias("wrong"))

    return F.aggregate(predictions, begin, step, lambda s: F.struct(s["hits"].alias("hits"), s["wrong"].alias("false_positives"), s["left"].alias("false_negatives")))


def evaluated(analysed: DataFrame, mode: str = "containment") -> DataFrame:
    """analysed rows with entities (array of type, text), the expected ones, with outcome: see matched()."""
    expected = F.coalesce(F.col("entities"), F.array().cast("array<struct<type:string,text:string>>"))
    expected = F.transform(expected, lambda g: F.struct(g["type"].alias("type"), g["text"].alias("text")))
    return analysed.withColumn("outcome", T.once(matched(F.col("resolved"), expected, mode)))


def _shares(tp, fp, fn):
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def category_counts(outcomes: DataFrame, categories: tuple[str, ...] = V.ENTITY_TYPES) -> DataFrame:
    """Per category, all of them: tp, fp, fn. Findings of other types aren't counted."""
    parts = F.concat(
        F.transform("outcome.hits", lambda k: F.struct(k.alias("category"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))),
        F.transform("outcome.false_positives", lambda p: F.struct(p["entity_type"].alias("category"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))),
        F.transform("outcome.false_negatives", lambda g: F.struct(g["type"].alias("category"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))),
    )
    counted = outcomes.select(F.explode(parts).alias("x")).select("x.*").groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    names = outcomes.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return names.join(counted, "category", "left").fillna(0, ["tp", "fp", "fn"])


def category_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each category; null where nothing was expected."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    expected = tp + fn > 0
    return counts.select("category", "tp", "fp", "fn", *[F.when(expected, x).alias(n) for x, n in zip(_shares(tp, fp, fn), ("precision", "recall", "f1"), strict=True)])


def overall_scores(counts: DataFrame) -> DataFrame:
    """The same over all categories together; 0 where there is nothing to divide by."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return total.select("tp", "fp", "fn", *[x.alias(n) for x, n in zip(_shares(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)])


def false_positives(outcomes: DataFrame) -> DataFrame:
    rows = outcomes.select("doc_id", "seq", "text", F.explode("outcome.false_positives").alias("e"))
    return rows.select(F.col("e.text").alias("predicted_text"), F.col("e.entity_type").alias("predicted_type"), F.col("e.detector").alias("detector_source"), "e.confidence", F.concat(F.lit("Paragraph "), F.col("seq")).alias("location"), F.col("text").alias("surrounding_context"))


def false_negatives(outcomes: DataFrame) -> DataFrame:
    rows = outcomes.select("doc_id", "seq", "text", F.explode("outcome.false_negatives").alias("e"))
    return rows.select(F.col("e.text").alias("ground_truth_text"), F.col("e.type").alias("expected_type"), F.concat(F.lit("Paragraph "), F.col("seq")).alias("location"), F.col("text").alias("surrounding_context"))


def write_failures(outcomes: DataFrame, folder: str) -> None:
    """Both kinds as JSON lines; the outcomes are worked out once, and those without a failure aren't kept."""
    wrong = F.size("outcome.false_positives") + F.size("outcome.false_negatives") > 0
    outcomes = Tables(outcomes.sparkSession).put(outcomes.where(wrong).select("doc_id", "seq", "text", "outcome"), "outcomes")
    false_positives(outcomes).write.mode("overwrite").json(f"{folder}/false_positives")
    false_negatives(outcomes).write.mode("overwrite").json(f"{folder}/false_negatives")

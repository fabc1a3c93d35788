"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import shuffle_width

SEED = 42
#: A Poisson variable of a larger mean is the sum of independent ones of at most this mean.
MOST_MEAN = 16.0
#: Such a variable exceeds this number with a chance below 1e-40.
MOST_COUNT = 100
#: Up to so many sources their rates are sent to every task; beyond, they are joined.
MOST_SOURCES = 10_000


def uniform(*parts):
    """A number in (0, 1) from the md5 of the parts, joined by bars: 52 bits."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source_col: str = "source") -> DataFrame:
    """(source, rate): copies of each document wanted on average, so that sources get their weights and the total stays.

    weights: relative, by source; a source left out gets 0; None: all sources alike. A null source is a source.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("sources"))
    if weights is None:
        weighed = counts.crossJoin(F.broadcast(total)).withColumn("weight", 1.0 / F.col("sources"))  # total is one row
    else:
        whole = sum(weights.values()) or 1.0
        names = docs.sparkSession.createDataFrame([(k, v / whole) for k, v in weights.items()], "name string, weight double")
        weighed = counts.join(names, F.col("source").eqNullSafe(F.col("name")), "left").fillna(0.0, ["weight"]).crossJoin(F.broadcast(total))
    return weighed.select("source", (F.col("weight") * F.col("total") / F.col("n")).alias("rate"))


def below(mean):
    """Array of the Poisson distribution function at 0, 1, ... for a mean of at most MOST_MEAN."""

    def step(s, k):
        term = s["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + term)).alias("sums"))

    first = F.exp(-mean)
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_COUNT)), F.struct(first.alias("term"), F.array(first).alias("sums")), step, lambda s: s["sums"])


def _free(taken: list[str], name: str) -> str:
    """The name, longer if a column has it."""
    taken = {c.lower() for c in taken}
    while name in taken:
        name += "_"
    return name


def replicated(docs: DataFrame, weights: Mapping[str | None, float] | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with the column copy (0, 1, ...), each row as often as its Poisson number says, in random order over all files.

    The number is the inverse of a Poisson distribution, of the mean that its source's target weight asks for, at a hash of
    seed and id: the same for the same id, whatever the order or the partitions. Rows that repeat an id are each taken
    that often; a null id hashes as an empty one; texts are never looked at; an empty table stays empty; a column named
    copy is replaced, all others stay, whatever their names.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c.lower() != "copy"]
    source, parts, sums, order = (_free(docs.columns, n) for n in ("mixed_source", "mixed_parts", "mixed_sums", "mixed_order"))
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int")
    table = rates(docs, weights, source_col).select(F.col("source").alias(source), n_parts.alias(parts), below(F.col("rate") / n_parts).alias(sums))
    if docs.select(F.col(f"`{source_col}`")).distinct().limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        table = F.broadcast(table)  # its size has been checked
    drawn = docs.select(*[F.col(f"`{c}`") for c in names]).join(table, F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    # a large mean is the sum of several: the first takes the hash of the id, the others further ones; each is worked out once, outside of the comparisons
    further = F.transform(F.sequence(F.lit(1), F.col(parts) - 1), lambda j: uniform(F.lit(str(seed)), key, j.cast("string")))
    draws = F.concat(F.array(uniform(F.lit(str(seed)), key)), F.when(F.col(parts) > 1, further).otherwise(F.array().cast("array<double>")))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(sums, lambda s: s < u)))
    # from 0 to the number, of which the 0 goes again: so the number stands, and is worked out, only once
    many = drawn.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long"))).alias("copy")).where(F.col("copy") > 0).withColumn("copy", F.col("copy") - 1)
    return many.withColumn(order, F.rand(seed)).repartition(shuffle_width(spark), order).sortWithinPartitions(order).drop(order)


#: DuckDB: the same for equal weights, where no mean exceeds MOST_MEAN.
SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (1.0 / (SELECT count(*) FROM counts))::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE / n AS mean FROM counts),
steps AS (
  SELECT source, k, sum(exp(-mean) * mean ** k / gamma(k + 1.0)) OVER (PARTITION BY source ORDER BY k) AS below
  FROM rates, (SELECT unnest(range(0, 100)) AS k)
),
drawn AS (
  SELECT doc_id, text, lang, source, n_chars,
         (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / {1 << 52} AS u
  FROM documents
),
numbered AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.below < d.u) AS n
  FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::BIGINT AS copy FROM numbered WHERE n > 0
"""

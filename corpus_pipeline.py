"""From raw documents to packed training sequences, in five stages of which each reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import mixing, packing, quality, simhash, substring
from maskwright.llm.common import Written, load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on those with labels that aren't held out, doesn't reject."""
    forest = quality.train(docs, load(spark, sf_dir, "labels"))
    rows = quality.scored(docs, forest, carry=("lang", "source", "n_chars")).where(F.col("score") >= quality.THRESHOLD)
    return rows.select("doc_id", "text", "rest.*").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 0.8 of their five-word shingles in common the one of the smallest id."""
    return simhash.one_of_each(docs, words=5, similarity=0.8).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that twenty-word windows repeat from earlier ones; those of which nothing is left go."""
    rows = substring.removed(docs, carry=("lang", "source")).where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return rows.select("doc_id", "text", "rest.*", F.length("text").cast("long").alias("n_chars")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source with the same weight."""
    return mixing.replicated(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier's trees or the fingerprints' votes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, over documents."""
    written = Written(spark)
    docs = load(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for name, stage in STAGES:
        docs = written.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        written.drop(before)
        before = docs
    return docs

"""Paragraphs from tables: documents, conversations, web pages, any columns, and expected findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCATION = "struct<paragraph_index:int,table_index:int,row_index:int,cell_index:int,is_header:boolean,is_footer:boolean>"


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has: for tables of few bytes of which much is made, which one task would read."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, seq, text, header_text) of the lines that aren't blank; seq is the line's place in its text. keep: further columns."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(F.split(text_col, "\n")).alias("seq", "text"))
    return rows.where(F.col("text").rlike(r"(?U)\S")).withColumn("header_text", F.lit(None).cast("string"))


def turns(conversations: DataFrame) -> DataFrame:
    """A conversation is a document, a turn a paragraph."""
    rows = conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seq"), "text")
    return rows.where(F.col("text").rlike(r"(?U)\S")).withColumn("header_text", F.lit(None).cast("string"))


def page_lines(pages: DataFrame) -> DataFrame:
    """The lines of web pages without tags, scripts and styles."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return lines(pages.select(F.col("page_id").alias("doc_id"), bare.alias("text")))


def cells(table: DataFrame, id_col: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A paragraph for each cell, under its column's name as table header; loc says the row 1 and the column."""
    names = list(columns or [c for c in table.columns if c != id_col])
    each = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(n).alias("header_text"), F.col(f"`{n}`").cast("string").alias("text")) for i, n in enumerate(names)])
    rows = table.select(F.col(id_col).alias("doc_id"), F.explode(each).alias("c")).select("doc_id", "c.seq", "c.text", "c.header_text")
    loc = F.struct(F.lit(0).alias("paragraph_index"), F.lit(0).alias("table_index"), F.lit(1).alias("row_index"), F.col("seq").alias("cell_index"), F.lit(False).alias("is_header"), F.lit(False).alias("is_footer"))
    return rows.where(F.col("text").rlike(r"(?U)\S")).withColumn("loc", loc.cast(LOCATION))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, seq, text, header_text, entities: array of type, text) from JSON arrays, one in a file; path may be a pattern or a folder.

    A document is a file, by its name without folders; an item is a paragraph, by its place in the array.
    """
    items = spark.read.option("multiLine", True).schema("text string, entities array<struct<type:string,text:string>>").json(path)
    rows = items.select("text", "entities", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("doc_id"), F.monotonically_increasing_id().alias("at"))
    # an array is one record of one file, which one task has parsed: its items come in order
    seq = (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).alias("seq")
    return rows.select("doc_id", seq, "text", F.lit(None).cast("string").alias("header_text"), "entities")

"""The analysis as views for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.plans import pipeline


def register(spark: SparkSession, paragraphs: DataFrame, config: pipeline.Config = pipeline.Config(), prefix: str = "maskwright") -> tuple[str, str, str]:
    """Makes the views <prefix>_paragraphs, <prefix>_entities and <prefix>_redacted of the session, and returns their names.

    They are plans, not tables: a query over them is optimised as a whole, and reads only the columns that it needs.
    """
    done = pipeline.redact(paragraphs, config)
    views = {
        "paragraphs": paragraphs,
        "entities": pipeline.entities(done, "replaced"),
        "redacted": done.select("doc_id", "seq", "text", F.size("resolved").alias("n_entities"), "redacted_text"),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(f"{prefix}_{name}")
    return tuple(f"{prefix}_{name}" for name in views)

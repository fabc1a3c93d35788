"""The whole analysis of paragraphs as a logical plan: detect, refine, add, recall, resolve, replace."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import pseudonym
from maskwright.functions import text as T
from maskwright.operators import context, detect, memo, names, refine, resolve


@dataclass(frozen=True)
class Config:
    """detectors: "patterns", "names", "context" or functions (Column) -> Column of entities, in the order in which they act."""

    detectors: tuple[Any, ...] = ("patterns", "names", "context")
    enabled: tuple[str, ...] = V.ENTITY_TYPES
    name_provider: Any = None
    use_memo: bool = True
    memo_min_confidence: float = 0.95
    memo_scope: str = "forward"
    strict_company_end: bool = True
    drop_intermediate: bool = False
    seed: int = V.SEED


def candidates(paragraphs: DataFrame, config: Config = Config()) -> DataFrame:
    """paragraphs (doc_id, seq, text, header_text, ...) with candidates: what the detectors find before any is weighed against another.

    A null text has none. The context detector refines what those before it found, and then adds its own.
    """
    df = paragraphs.withColumn("candidates", T.no_entities())
    if "header_text" not in df.columns:
        df = df.withColumn("header_text", F.lit(None).cast("string"))
    text = F.coalesce("text", F.lit(""))
    for step in config.detectors:
        if step == "context":
            df = refine.refine(df, enabled=config.enabled)
            added = context.generate(text, config.enabled, config.strict_company_end, F.col("__low"))
            df = df.withColumn("__low", F.lower(text)).withColumn("candidates", F.concat("refined", added)).drop("refined", "__low")
        elif step == "names":
            if config.name_provider is not None:
                df = df.withColumn("candidates", F.concat("candidates", names.entities(text, config.name_provider)))
        else:
            found = detect.detect(text, config.enabled) if step == "patterns" else step(text)
            df = df.withColumn("candidates", F.concat("candidates", found))
    if config.drop_intermediate:
        df = df.withColumn("candidates", F.filter("candidates", lambda e: e["entity_type"].isin(*config.enabled)))
    return df.withColumn("candidates", T.once(T.numbered(F.col("candidates"))))


def analyse(paragraphs: DataFrame, config: Config = Config()) -> DataFrame:
    """candidates() with resolved: the findings that stay, by start. A document's memo is applied if it has any entry."""
    df = candidates(paragraphs, config).withColumn("resolved", T.once(resolve.resolve(F.col("candidates"))))
    if config.use_memo and memo.reachable(config):
        df = memo.recall(df, config.memo_min_confidence, config.memo_scope)
    return df


def redact(paragraphs: DataFrame, config: Config = Config()) -> DataFrame:
    """analyse() with replaced (resolved, with replacement) and redacted_text; with redacted_runs where there are runs."""
    df = analyse(paragraphs, config).withColumn("replaced", T.once(pseudonym.with_replacements(F.col("resolved"), config.seed)))
    if "runs" in df.columns:
        df = df.withColumn("redacted_runs", pseudonym.redacted_runs(F.col("runs"), F.col("replaced")))
    return df.withColumn("redacted_text", pseudonym.redacted(F.coalesce("text", F.lit("")), F.col("replaced")))


def entities(analysed: DataFrame, column: str = "resolved") -> DataFrame:
    """A row for each finding."""
    kept = [c for c in ("doc_id", "seq", "header_text") if c in analysed.columns]
    return analysed.where(F.size(column) > 0).select(*kept, F.explode(column).alias("e")).select(*kept, "e.*")

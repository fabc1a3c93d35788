"""Refinement of candidates by the text around them and by the table header above."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T


def context_of(text: Column, header: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit(" | "), text)).otherwise(text)


def _signs(context: Column) -> Column:
    """What the refinement asks of a context, each worked out once."""
    low = F.lower(context)
    pin, street = low.rlike("(?U)" + V.PIN), T.has_word(low, V.STREET_WORDS)
    several = F.size(F.filter(F.split(low, ","), lambda x: F.length(T.strip(x)) > 3)) > 2
    return F.struct(
        T.has_any(low, V.BIRTH).alias("birth"),
        T.has_any(low, V.COMPANY_LABELS).alias("company"),
        (T.has_any(low, V.ADDRESS_LABELS) | (pin & street) | (several & (pin | street))).alias("address"),
        (T.has_any(low, V.PERSON_PREFIXES) | T.has_any(low, V.PERSON_TITLES)).alias("person"),
        T.has_word(low, V.TECH_STOP_WORDS).alias("technical"),
        T.has_any(low, V.PHONE_LABELS).alias("phone"),
        T.has_word(low, V.PHONE_STOP_WORDS).alias("no_phone"),
        T.has_any(low, V.CARD_TERMS).alias("card"),
        F.contains(low, F.lit("aadhaar")).alias("aadhaar"),
    )


def _by_header(e: Column, header: Column) -> Column:
    kind, name = e["entity_type"], F.coalesce(F.lower(header), F.lit(""))
    has = lambda *terms: T.has_any(name, terms)
    changed = (
        F.when(has("dob", "birth"), F.when(kind == "DATE", F.lit("DATE_OF_BIRTH")))
        .when(has("name") & (kind == "PERSON"), F.lit("PERSON"))
        .when(has("address") & (kind == "ADDRESS_CANDIDATE"), F.lit("PHYSICAL_OR_MAILING_ADDRESS"))
        .when(has("company", "entity") & (kind == "COMPANY_CANDIDATE"), F.lit("COMPANY"))
    )
    return T.entity(e["text"], F.coalesce(changed, kind), e["start"], e["end"], F.when(changed.isNotNull(), V.TABLE_HEADER).otherwise(e["confidence"]), e["detector"], e["ord"])


def _keep_person(e: Column, signs: Column) -> Column:
    low, words = F.lower(e["text"]), F.size(T.words_of(e["text"]))
    doubtful = F.startswith(low, F.lit("the ")) | (words == 1) | signs["technical"]
    plausible = signs["person"] | ((words >= 2) & T.is_title(e["text"]))
    return ~T.has_word(low, V.PERSON_STOP_WORDS) & (signs["person"] | ~doubtful) & ~T.has_any(low, V.DOMAIN_TERMS) & plausible


def _keep(e: Column, signs: Column) -> Column:
    kind, low = e["entity_type"], F.lower(e["text"])
    marked = F.contains(e["text"], F.lit("+")) | F.contains(e["text"], F.lit("-")) | F.contains(e["text"], F.lit("("))
    return (
        F.when(kind == "COMPANY_CANDIDATE", ~T.has_any(low, V.DOMAIN_TERMS) & (T.has_any(low, V.COMPANY_SUFFIXES) | signs["company"]))
        .when(kind == "ADDRESS_CANDIDATE", signs["address"])
        .when(kind == "PERSON", _keep_person(e, signs))
        .when(kind == "PHONE", ~signs["no_phone"] & (signs["phone"] | marked))
        .when(kind == "AADHAAR", ~signs["card"])
        .otherwise(F.lit(True))
    )


def _by_context(e: Column, signs: Column) -> Column:
    kind = e["entity_type"]
    changed = (
        F.when((kind == "DATE") & signs["birth"], F.lit("DATE_OF_BIRTH"))
        .when(kind == "COMPANY_CANDIDATE", F.lit("COMPANY"))
        .when(kind == "ADDRESS_CANDIDATE", F.lit("PHYSICAL_OR_MAILING_ADDRESS"))
        .when(((kind == "PERSON") & signs["person"]) | ((kind == "AADHAAR") & signs["aadhaar"]), kind)
    )
    return T.entity(e["text"], F.coalesce(changed, kind), e["start"], e["end"], F.when(changed.isNotNull(), V.CONTEXT).otherwise(e["confidence"]), e["detector"], e["ord"])


def refine(df: DataFrame, candidates: str = "candidates", out: str = "refined", enabled: Collection[str] = V.ENTITY_TYPES) -> DataFrame:
    """Adds the refined candidates of rows with text and header_text: typed, promoted, rejected, and of enabled types only."""
    some = F.size(candidates) > 0
    signs = F.when(some, _signs(context_of(F.col("text"), F.col("header_text"))))
    headed = F.transform(candidates, lambda e: _by_header(e, F.col("header_text")))
    df = df.withColumns({"__signs": T.once(signs), "__headed": F.when(some, headed).otherwise(T.no_entities())})
    kept = F.filter("__headed", lambda e: _keep(e, F.col("__signs")))
    typed = F.filter(F.transform(kept, lambda e: _by_context(e, F.col("__signs"))), lambda e: e["entity_type"].isin(*enabled))
    return df.withColumn(out, T.once(F.when(F.size("__headed") > 0, typed).otherwise(T.no_entities()))).drop("__signs", "__headed")

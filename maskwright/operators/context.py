"""Findings that context alone gives: labelled and implicit addresses, lists of people, organisations."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T


def _one(e: Column, when: Column) -> Column:
    return F.when(when, F.array(e)).otherwise(T.no_entities())


def _whole(text: Column, found: Column, detector: str) -> Column:
    start = F.position(found, text) - 1
    return T.entity(found, "PHYSICAL_OR_MAILING_ADDRESS", start, start + F.length(found), V.CONTEXT, detector)


def addresses(text: Column, low: Column | None = None) -> Column:
    """What follows the first address label, or else a whole text with a PIN code, a street word and a comma."""
    low = F.lower(text) if low is None else low
    labelled = F.contains(low, F.lit(":")) & T.has_any_of(low, V.ADDRESS_TRIGGERS)  # they end with it
    rest = T.strip(F.regexp_replace(text, rf"(?Uis)\A.*?{V.ADDRESS_SPLIT}", ""))
    implied = ~labelled & F.contains(text, F.lit(",")) & text.rlike(r"(?U)\d{6}") & text.rlike("(?U)" + V.PIN) & T.has_word(low, V.STREET_WORDS)
    return F.when(labelled, _one(_whole(text, rest, "context_block"), F.length(rest) > 10)).otherwise(_one(_whole(text, T.strip(text), "context_implicit"), implied))


def people(text: Column, low: Column | None = None) -> Column:
    """Runs of capitalised words in a text that announces people."""
    spans = F.transform(T.scan(text, V.NAMES), lambda s: T.entity(T.part(text, s["start"], s["end"]), "PERSON", s["start"], s["end"], V.CONTEXT, "context_person_list"))
    kept = F.filter(spans, lambda e: ~T.has_word(F.lower(e["text"]), V.PERSON_LIST_STOP_WORDS))
    low = F.lower(text) if low is None else low
    return F.when(T.has_any_of(low, V.PERSON_LIST_PARTS) & T.has_any_of(low, V.PERSON_LIST_TRIGGERS), kept).otherwise(T.no_entities())


def organisations(text: Column, low: Column | None = None) -> Column:
    """Runs of capitalised words in a text that names who issued or prepared something."""
    spans = F.transform(T.scan(text, V.ORGANISATIONS), lambda s: F.struct((s["start"] + F.when(F.startswith(F.lower(T.part(text, s["start"], s["end"])), F.lit("the ")), 4).otherwise(0)).alias("start"), s["end"].alias("end")))
    found = F.transform(spans, lambda s: T.entity(T.part(text, s["start"], s["end"]), "COMPANY", s["start"], s["end"], V.CONTEXT, "context_org_fallback"))
    kept = F.filter(found, lambda e: ~T.has_word(F.lower(e["text"]), V.ORGANISATION_STOP_WORDS) & (F.length(e["text"]) > 3))
    low = F.lower(text) if low is None else low
    return F.when(T.has_any_of(low, V.ORGANISATION_PARTS) & T.has_any_of(low, V.ORGANISATION_TRIGGERS), kept).otherwise(T.no_entities())


def companies(text: Column, strict_end: bool = True) -> Column:
    """Capitalised words before a legal form. strict_end: the form must end at a word's edge, so that a final dot needs a word after it."""
    pattern = V.COMPANIES + (r"\b" if strict_end else r"(?:\b|(?<=\.))")
    found = F.transform(T.scan(text, pattern), lambda s: T.entity(T.part(text, s["start"], s["end"]), "COMPANY", s["start"], s["end"], V.CONTEXT, "context_suffix_fallback"))
    return F.when(T.has_any_of(text, ("Limited", "LLP", "LLC", "Inc", "Corp")), found).otherwise(T.no_entities())


def generate(text: Column, enabled: Collection[str] = V.ENTITY_TYPES, strict_end: bool = True, low: Column | None = None) -> Column:
    """All of them, of enabled types. low: the text in lower case, where a column of its own holds it: many terms are looked for in it."""
    parts = []
    if "PHYSICAL_OR_MAILING_ADDRESS" in enabled:
        parts.append(addresses(text, low))
    if "PERSON" in enabled:
        parts.append(people(text, low))
    if "COMPANY" in enabled:
        parts += [organisations(text, low), companies(text, strict_end)]
    return F.concat(*parts) if parts else T.no_entities()

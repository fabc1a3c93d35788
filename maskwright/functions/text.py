"""Text tests and the span scan, as Catalyst expressions; offsets are code points, from 0, ends excluded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "struct<text:string,entity_type:string,start:int,end:int,confidence:double,detector:string,ord:int>"
ENTITIES = f"array<{ENTITY}>"
_OPEN, _CLOSE = "\x01", "\x02"


def no_entities() -> Column:
    return F.array().cast(ENTITIES)


def once(column: Column) -> Column:
    """The column, worked out just where it stands: filters above, also those that explode() implies, don't repeat it below.

    For the price of that no filter gets below it either, not even one on other columns: filter before it.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def entity(text: Column, kind: Column | str, start: Column, end: Column, confidence: Column | float, detector: Column | str, order: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        text.alias("text"), lit(kind).alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        lit(confidence).cast("double").alias("confidence"), lit(detector).alias("detector"), lit(order).cast("int").alias("ord"),
    )


def numbered(entities: Column) -> Column:
    """The entities with their places as ord."""
    return F.transform(entities, lambda e, i: entity(e["text"], e["entity_type"], e["start"], e["end"], e["confidence"], e["detector"], i))


def part(text: Column, start: Column, end: Column) -> Column:
    return text.substr(start + F.lit(1), end - start)


def scan(text: Column, pattern: str | Column, flags: str = "U") -> Column:
    """Spans (start, end) of the pattern's successive matches, left to right; the pattern may be a column.

    Matches are put between two control characters, at which the text is then split: every second piece is a match, and
    the pieces' lengths add up to offsets. Where the text has these characters itself, two others stand in for them,
    which no pattern tells from them.
    """
    plain = F.translate(text, _OPEN + _CLOSE, "\x03\x04")
    pieces = F.split(F.regexp_replace(plain, F.concat(F.lit(f"(?{flags})"), pattern) if isinstance(pattern, Column) else F.lit(f"(?{flags}){pattern}"), F.lit(f"{_OPEN}$0{_CLOSE}")), f"[{_OPEN}{_CLOSE}]")
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state, piece):
        stop = state["at"] + F.length(piece)
        more = F.concat(state["found"], F.array(F.struct(state["at"].alias("start"), stop.alias("end"))))
        return F.struct(stop.alias("at"), (~state["inside"]).alias("inside"), F.when(state["inside"], more).otherwise(state["found"]).alias("found"))

    return F.aggregate(pieces, begin, step, lambda state: state["found"])


def has_any(lowered: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms stands anywhere in the text, inside words too."""
    return lowered.rlike("|".join(rf"\Q{term}\E" for term in terms))


def has_any_of(lowered: Column, terms: Sequence[str]) -> Column:
    """has_any() for whole texts, where looking for each term by itself is faster than one pattern of all."""
    found = F.contains(lowered, F.lit(terms[0]))
    for term in terms[1:]:
        found = found | F.contains(lowered, F.lit(term))
    return found


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def has_word(lowered: Column, words: Sequence[str]) -> Column:
    """Whether a word between white space, without its marks, is one of words."""
    bare = F.transform(words_of(lowered), lambda w: F.regexp_replace(w, r"(?U)[^\w\s]", ""))
    return F.arrays_overlap(bare, F.array(*[F.lit(w) for w in words]))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_title(text: Column) -> Column:
    """Upper case only, and always, where a run of cased letters begins."""
    return text.rlike(r"(?U)\p{Lu}") & ~text.rlike(r"(?U)[\p{Lu}\p{Ll}]\p{Lu}") & ~text.rlike(r"(?U)(^|[^\p{Lu}\p{Ll}])\p{Ll}")


def luhn(digits: Column) -> Column:
    """The card checksum; false where something else than digits 0 to 9 occurs."""
    backwards = F.reverse(digits)

    def add(total, k):
        d = backwards.substr(k, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0, F.lit(False)) & (F.length(digits) > 0)

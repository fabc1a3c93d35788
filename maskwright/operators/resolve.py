"""Resolution of overlapping findings: merge equal ones, then a greedy fold from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T


def _same(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity_type"] == b["entity_type"])


def merge_equal(entities: Column) -> Column:
    """One of each span and type, the first; a later one of higher confidence lends it that, and adds its detector."""

    def raised(a, e):
        better = _same(a, e) & (e["confidence"] > a["confidence"])
        return T.entity(a["text"], a["entity_type"], a["start"], a["end"], F.when(better, e["confidence"]).otherwise(a["confidence"]), F.when(better, F.concat_ws(",", a["detector"], e["detector"])).otherwise(a["detector"]), a["ord"])

    def step(acc, e):
        return F.when(F.exists(acc, lambda a: _same(a, e)), F.transform(acc, lambda a: raised(a, e))).otherwise(F.concat(acc, F.array(e)))

    return F.aggregate(entities, T.no_entities(), step)


def priority(kind: Column) -> Column:
    rank = F.lit(0)
    for value in sorted(set(V.PRIORITY.values())):
        rank = F.when(kind.isin(*[k for k, v in V.PRIORITY.items() if v == value]), value).otherwise(rank)
    return rank


def beats(new: Column, old: Column) -> Column:
    """Confidence, then containing the other, then the type's priority, then length."""
    holds = (new["start"] <= old["start"]) & (new["end"] >= old["end"])
    held = (old["start"] <= new["start"]) & (old["end"] >= new["end"])
    rank, other = priority(new["entity_type"]), priority(old["entity_type"])
    return (
        F.when(new["confidence"] != old["confidence"], new["confidence"] > old["confidence"])
        .when(holds != held, holds)
        .when(rank != other, rank > other)
        .otherwise(new["end"] - new["start"] > old["end"] - old["start"])
    )


def in_order(entities: Column) -> Column:
    """By start, longer ones first, then as they came."""
    keyed = F.transform(entities, lambda e: F.struct(e["start"].alias("a"), (e["start"] - e["end"]).alias("b"), e["ord"].alias("c"), e.alias("e")))
    return F.transform(F.sort_array(keyed), lambda k: k["e"])


def resolve(entities: Column) -> Column:
    """Findings that don't overlap: each must beat all that it overlaps, and then drives them out for good."""

    def step(acc, e):
        apart = lambda a: F.greatest(a["start"], e["start"]) >= F.least(a["end"], e["end"])
        wins = F.forall(acc, lambda a: apart(a) | beats(e, a))
        return F.when(wins, F.concat(F.filter(acc, apart), F.array(e))).otherwise(acc)

    folded = F.aggregate(in_order(merge_equal(entities)), T.no_entities(), step)  # what stays is in order as it was
    return F.when(F.size(entities) > 1, folded).otherwise(entities)

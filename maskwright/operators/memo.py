"""A document's memo: names of high confidence are found again, as they are, in its later paragraphs.

`recall` works a whole table out by joins that are repeated until nothing changes; the functions on lists do the same for
one paragraph after another, for streams, whose state they keep.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T
from maskwright.operators import resolve
from maskwright.storage import Tables, shuffled


def reachable(config) -> bool:
    """Whether any finding can reach the memo's confidence: by itself the context's can't, a name under a table header can."""
    if config.memo_min_confidence <= V.CONTEXT:
        return True
    own = [d for d in config.detectors if callable(d)]
    return bool(own) or config.name_provider is not None


def seeds(resolved, least: float):
    """The findings that enter the memo."""
    return F.filter(
        resolved,
        lambda e: (e["confidence"] >= least) & e["entity_type"].isin("PERSON", "COMPANY") & (F.size(T.words_of(e["text"])) >= 2) & ~F.lower(e["text"]).isin(*V.MEMO_STOP_TERMS),
    )


def _overlap(a: dict, b: dict) -> bool:
    return max(a["start"], b["start"]) < min(a["end"], b["end"])


def _rank(new: dict, old: dict) -> bool:
    if new["confidence"] != old["confidence"]:
        return new["confidence"] > old["confidence"]
    holds = new["start"] <= old["start"] and new["end"] >= old["end"]
    held = old["start"] <= new["start"] and old["end"] >= new["end"]
    if holds != held:
        return holds
    new_rank, old_rank = V.PRIORITY.get(new["entity_type"], 0), V.PRIORITY.get(old["entity_type"], 0)
    return new_rank > old_rank if new_rank != old_rank else new["end"] - new["start"] > old["end"] - old["start"]


def resolve_list(found: list[dict]) -> list[dict]:
    """What operators.resolve does, for one paragraph at a time."""
    one: dict[tuple, dict] = {}
    for e in found:
        key = e["start"], e["end"], e["entity_type"]
        if key not in one:
            one[key] = dict(e)
        elif e["confidence"] > one[key]["confidence"]:
            one[key] |= {"confidence": e["confidence"], "detector": f"{one[key]['detector']},{e['detector']}"}
    kept: list[dict] = []
    for e in sorted(one.values(), key=lambda e: (e["start"], e["start"] - e["end"], e["ord"])):
        met = [k for k in kept if _overlap(e, k)]
        if all(_rank(e, k) for k in met):
            kept = [k for k in kept if k not in met] + [e]
    return sorted(kept, key=lambda e: (e["start"], e["start"] - e["end"], e["ord"]))


def learnt(resolved: list[dict], least: float) -> dict[str, str]:
    """What seeds() picks, as memo entries."""
    return {
        e["text"]: e["entity_type"]
        for e in resolved
        if e["confidence"] >= least and e["entity_type"] in ("PERSON", "COMPANY") and len(e["text"].split()) >= 2 and e["text"].lower() not in V.MEMO_STOP_TERMS
    }


def recalled(memo: dict[str, str], text: str, candidates: list[dict]) -> list[dict]:
    """The candidates and, after them, what the memo finds: literally, between word edges."""
    out = list(candidates)
    for name, kind in memo.items():
        if name in text:
            out += [{"text": name, "entity_type": kind, "start": m.start(), "end": m.end(), "confidence": V.MEMO, "detector": V.MEMO_DETECTOR, "ord": 0} for m in re.finditer(rf"\b{re.escape(name)}\b", text)]
    return [{**e, "ord": i} for i, e in enumerate(out)]


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))


def _longest_run(name: Column) -> Column:
    """The longest run of word characters: wherever the name stands between word edges, this is a whole word."""
    return F.array_max(F.transform(_runs(name), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]


def _between_edges(name: Column) -> Column:
    """A pattern of the name, literally, between word edges."""
    return F.concat(F.lit(r"\b\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def _events(rows: DataFrame, entities: Column) -> DataFrame:
    """(doc, name, kind, at): what enters the memo, in the order in which it does."""
    found = rows.select("doc_id", "__pos", F.posexplode(entities).alias("i", "e"))
    return found.select(F.col("doc_id").alias("doc"), F.col("e.text").alias("name"), F.col("e.entity_type").alias("kind"), F.struct(F.col("__pos").alias("pos"), F.col("i")).alias("at"))


def _mentions(base: DataFrame, least: float, forward: bool) -> DataFrame:
    """(row, doc, pos, name, spans) of the paragraphs that hold a name which a candidate of their document could put into the memo, if forward of an earlier paragraph.

    They meet by a word of the name, so no name is tried on a paragraph that lacks it, and a document's paragraphs may lie anywhere.
    """
    could = _events(base, seeds(F.col("candidates"), least)).groupBy("doc", "name").agg(F.min("at").alias("at")).withColumn("word", _longest_run(F.col("name"))).where(F.col("word").isNotNull())
    some = base.select("__row", "__pos", "doc_id", "text").join(shuffled(could.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")
    words = some.select("__row", "__pos", F.col("doc_id").alias("doc"), F.explode(F.array_distinct(_runs(F.col("text")))).alias("word"))
    met = words.join(shuffled(could), ["doc", "word"])
    if forward:
        met = met.where(F.col("at")["pos"] < F.col("__pos"))
    met = met.select(F.col("__row").alias("row"), "doc", F.col("__pos").alias("pos"), "name")
    texts = base.select(F.col("__row").alias("row"), "text")
    spans = met.join(shuffled(texts), "row").where(F.contains("text", F.col("name"))).withColumn("spans", T.once(T.scan(F.col("text"), _between_edges(F.col("name")))))
    return spans.where(F.size("spans") > 0).select("row", "doc", "pos", "name", "spans")


def _known(mentions: DataFrame, events: DataFrame, forward: bool) -> DataFrame:
    """mentions with kind and since: as what, and since when, the memo knows the name; those that it doesn't know go."""
    of_name = events.groupBy("doc", "name").agg(F.min("at").alias("since"), F.min("kind").alias("kind"), F.max("kind").alias("other"), F.max_by("kind", "at").alias("last"))
    rows = mentions.join(shuffled(of_name), ["doc", "name"])
    if not forward:
        return rows.withColumn("kind", F.col("last")).drop("other", "last")
    rows = rows.where(F.col("since")["pos"] < F.col("pos"))
    one = rows.where(F.col("kind") == F.col("other")).drop("other", "last")
    # names of several types: the type that it had last before the paragraph
    several = rows.where(F.col("kind") != F.col("other")).drop("kind", "other", "last")
    told = events.join(shuffled(several.select("doc", "name").distinct()), ["doc", "name"]).select("doc", "name", "at", "kind")
    asked = several.select("doc", "name", F.struct("pos", F.lit(-1).alias("i")).alias("at"), F.struct(*[c for c in several.columns if c not in ("doc", "name")]).alias("m"))
    before = Window.partitionBy("doc", "name").orderBy("at")
    seen = told.unionByName(asked, allowMissingColumns=True).withColumn("now", F.last("kind", ignorenulls=True).over(before)).where(F.col("m").isNotNull())
    return one.unionByName(seen.select("doc", "name", "m.*", F.col("now").alias("kind")))


def recall(df: DataFrame, least: float = 0.95, scope: str = "forward") -> DataFrame:
    """df (doc_id, seq, text, candidates, resolved, ...) with candidates and resolved as the memo makes them.

    scope: "forward", where a name counts from the paragraph after it, or "document", where it counts in all paragraphs.
    Every row stays, with all its columns; rows that share a place follow each other in the order in which they are read;
    a null place is the last. Paragraphs without a document have no memo. Names without a letter or digit aren't found again.

    The paragraphs that hold a name of their document's earlier ones are found once, by joins on document and word. Then
    they are resolved with what the memo would hold, which may change what enters it; those for which that changed are
    resolved again, until nothing changes, which comes after as many rounds as names depend on each other. All other
    paragraphs are written once and never looked at again. A document of any size is spread over tasks, and no table goes
    through the driver.
    """
    if scope not in ("forward", "document"):
        raise ValueError("scope is forward or document")
    forward, tables, names = scope == "forward", Tables(df.sparkSession), df.columns
    base = tables.put(df.withColumn("__row", F.monotonically_increasing_id()), "paragraphs")
    base = base.withColumn("__pos", F.struct(F.coalesce(F.col("seq").cast("long"), F.lit(1 << 40)).alias("seq"), F.col("__row").alias("row")))
    mentions = tables.put(_mentions(base, least, forward), "mentions")
    if mentions.isEmpty():
        return base.select(*names)
    touched = mentions.select(F.col("row").alias("__row")).distinct()
    fixed = _events(base.join(shuffled(touched), "__row", "left_anti"), seeds(F.col("resolved"), least))
    state = base.join(shuffled(touched), "__row").select("__row", "__pos", "doc_id", F.col("candidates").alias("own"), "candidates", "resolved", F.lit(0).cast("long").alias("sign"), F.lit(True).alias("changed"))
    fixed, state = tables.put(fixed, "fixed"), tables.put(state, "state")
    while True:
        events = fixed.unionByName(_events(state, seeds(F.col("resolved"), least)))
        known = _known(mentions, events, forward).groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("since", "name", "kind", "spans"))).alias("memo"))
        recalled_ = F.flatten(F.transform("memo", lambda m: F.transform(m["spans"], lambda s: T.entity(m["name"], m["kind"], s["start"], s["end"], V.MEMO, V.MEMO_DETECTOR))))
        now = state.drop("changed").join(shuffled(known), "__row", "left").withColumn("now", F.coalesce(F.xxhash64(F.transform("memo", lambda m: F.struct(m["since"], m["name"], m["kind"]))), F.lit(0).cast("long")))
        now = now.withColumn("now", F.when(F.col("memo").isNull(), F.lit(0).cast("long")).otherwise(F.col("now"))).withColumn("changed", F.col("now") != F.col("sign"))
        pool = F.when(F.col("changed"), T.numbered(F.concat("own", F.coalesce(recalled_, T.no_entities())))).otherwise(F.col("candidates"))
        now = now.withColumn("candidates", T.once(pool)).withColumn("resolved", T.once(F.when(F.col("changed"), resolve.resolve(F.col("candidates"))).otherwise(F.col("resolved"))))
        state = tables.put(now.select("__row", "__pos", "doc_id", "own", "candidates", "resolved", F.col("now").alias("sign"), "changed"), "state")
        if not forward or state.where("changed").isEmpty():
            break
    done = state.select("__row", F.struct("candidates", "resolved").alias("__done"))
    rows = base.join(shuffled(done), "__row", "left")
    return rows.select(*[F.when(F.col("__done").isNull(), F.col(c)).otherwise(F.col("__done")[c]).alias(c) if c in ("candidates", "resolved") else F.col(f"`{c}`") for c in names])

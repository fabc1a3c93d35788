"""The memo over a stream as state that ends: names that haven't been said for a while are forgotten, and so are idle documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from maskwright.functions import text as T
from maskwright.operators import memo


def recall_stream(analysed: DataFrame, least: float = 0.95, name_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """analysed (doc_id long, seq int, text, candidates), a stream -> (doc_id, seq, resolved), with a memo that ends.

    A name is forgotten name_ms after the last batch that said it, a document with all its names idle_ms after its last
    paragraph, both by the clock of the cluster; None: never. Otherwise as micro.recall_stream: a paragraph counts as
    later than those of earlier batches, inside a batch the order is by seq. The state outlives a restart of the query
    from its checkpoint. With idle_ms a query has always another batch to come, in which documents may end: a trigger that
    stops when its source is read up (availableNow) never does. Rows without a document share one memo, whose names are those of no document.
    """
    state_schema, out = "names array<string>, kinds array<string>, said array<long>", f"doc_id long, seq int, resolved {T.ENTITIES}"

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        names, kinds, said = state.get if state.exists else ([], [], [])
        known = {n: (k, t) for n, k, t in zip(names, kinds, said, strict=True) if name_ms is None or t + name_ms > now}
        rows, kept = pd.concat(list(frames)).sort_values("seq", kind="stable"), []
        for text, found in zip(rows["text"], rows["candidates"], strict=True):
            resolved = memo.resolve_list(memo.recalled({n: k for n, (k, _) in known.items()}, text or "", [dict(e) for e in found]))
            known |= {n: (k, now) for n, k in memo.learnt(resolved, least).items()}
            kept.append(resolved)
        state.update((list(known), [k for k, _ in known.values()], [t for _, t in known.values()]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"doc_id": key[0], "seq": rows["seq"].to_numpy(), "resolved": kept})

    timeout = "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    return analysed.select("doc_id", "seq", "text", "candidates").groupBy("doc_id").applyInPandasWithState(fold, out, state_schema, "append", timeout)

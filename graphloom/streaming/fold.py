"""Document state folded over chunks in order: in batch by windows, on streams by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators import graph

RECENT = 5
NEW, SEEN = 0.5, 0.6
OUT = "doc_id long, index int, added array<string>, updated array<string>, known array<string>, recent array<string>"
#: Chunks that came too early (by index) wait in the state.
STATE = "next int, known array<string>, recent array<string>, waiting array<struct<index:int,chunk_id:string,entities:array<string>>>"


def transitions(mentions: DataFrame) -> DataFrame:
    """doc_id, index, entity_id, added or updated, confidence: the first chunk with an entity adds it, later ones update it."""
    w = Window.partitionBy("doc_id", "entity_id").orderBy("index")
    first = F.row_number().over(w) == 1
    rows = mentions.select("doc_id", "index", "entity_id").distinct()
    return rows.withColumn("change", F.when(first, "added").otherwise("updated")).withColumn("confidence", F.when(first, NEW).otherwise(SEEN))


def batch_fold(chunks: DataFrame) -> DataFrame:
    """State after every chunk of (doc_id, index, chunk_id, entities array): entities known so far, the last few chunk ids."""
    flat = chunks.withColumn("_e", F.array_distinct("entities"))
    before = Window.partitionBy("doc_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.array_distinct(F.flatten(F.collect_list("_e").over(before)))
    rows = graph.ring(flat.withColumn("_before", earlier), "doc_id", "index", "chunk_id", RECENT)
    return rows.select("doc_id", "index", F.array_sort(F.array_except("_e", "_before")).alias("added"), F.array_sort(F.array_intersect("_e", "_before")).alias("updated"), F.array_sort(F.array_union("_before", "_e")).alias("known"), F.col("ring").alias("recent"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, known, recent, waiting = state.get if state.exists else (0, [], [], [])
    known, recent = set(known), list(recent)
    queue = {w["index"] if isinstance(w, dict) else w[0]: (w["chunk_id"], list(w["entities"])) if isinstance(w, dict) else (w[1], list(w[2])) for w in waiting}
    for pdf in batches:
        for i, c, e in zip(pdf["index"], pdf["chunk_id"], pdf["entities"], strict=True):
            if i >= now:
                queue[int(i)] = (c, list(e))
    out = []
    while now in queue:
        chunk, entities = queue.pop(now)
        own = set(entities)
        recent = [*recent, chunk][-RECENT:]
        out.append((key[0], now, sorted(own - known), sorted(own & known), sorted(known | own), list(recent)))
        known |= own
        now += 1
    state.update((now, sorted(known), recent, [(i, c, e) for i, (c, e) in sorted(queue.items())]))
    yield pd.DataFrame(out, columns=["doc_id", "index", "added", "updated", "known", "recent"])


def stream_fold(chunks: DataFrame) -> DataFrame:
    """The same state from a stream of chunks (contiguous indexes from 0), in whatever order they come."""
    return chunks.groupBy("doc_id").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Extension: counts by event time and type; rows later than ``late`` are left out on streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")

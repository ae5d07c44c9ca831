"""Structured Streaming twins of the gateway operators and incremental index maintenance."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gateway import accepted, micros
from ..operators.index import Stored, tokenized


def stream_limit(events: DataFrame, most: int, window_seconds: float, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """The sliding-log limit over a stream. A key's state is its log: the accepted times in the window, most of them at most.

    Events of a key must come in the order of their times, batch by batch; within a batch they are sorted.
    """
    window = int(window_seconds * 1_000_000)

    def run(k, batches, state):
        log = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["t", "event"])
        allowed = accepted(rows["t"].tolist(), most, window, log)
        state.update((list(log),))
        yield pd.DataFrame({"event": rows["event"], "key": rows["key"], "t": rows["t"], "allowed": allowed})

    rows = events.select(F.col(event).alias("event"), F.col(key).alias("key"), micros(ts).alias("t"))
    kinds = {c: events.schema[c].dataType.simpleString() for c in (event, key)}
    out = rows.groupBy("key").applyInPandasWithState(run, f"event {kinds[event]}, key {kinds[key]}, t long, allowed boolean", "log array<long>", "append", "NoTimeout")
    return out.select(F.col("event").alias(event), F.col("key").alias(key), F.timestamp_micros("t").alias(ts), "allowed")


def stream_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Events of each key in each window, final once the watermark has passed."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def maintain_index(documents: DataFrame, path: str, checkpoint: str, key: str = "id", *columns: str, removed: str | None = None):
    """A streaming query that keeps a stored index: each batch adds a delta of its new and changed documents.

    removed: a boolean column of those that have gone. Of several rows of a key in a batch one counts; a batch that is run again
    replaces its delta.
    """

    def step(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates([key])
        gone = own.where(F.coalesce(F.col(removed), F.lit(False))) if removed else own.limit(0)
        fresh = own.where(~F.coalesce(F.col(removed), F.lit(False))) if removed else own
        Stored(batch.sparkSession, path, key).add(tokenized(fresh, *(columns or ("text",)), key=key), number + 1, gone)

    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

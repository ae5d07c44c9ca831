"""Gateway events: rate limits, expiry of tokens and caches, users and tokens."""

from __future__ import annotations

from collections import deque
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted(times: list[int], most: int, window: int, log: deque | None = None) -> list[bool]:
    """Whether each event (sorted microseconds) passes: fewer than most accepted ones in the window before it. Rejected ones take no quota."""
    log = deque() if log is None else log
    out = []
    for now in times:
        while log and now - log[0] >= window:
            log.popleft()
        out.append(len(log) < most)
        if out[-1]:
            log.append(now)
    return out


def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def sliding_log(events: DataFrame, most: int, window_seconds: float, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """event, key, ts, allowed and retry_after. Acceptance depends on earlier decisions, so a key's events are taken in order: they
    are sorted by Spark, streamed, and only the window's log (most entries) is held for the key at hand.

    retry_after, of an event that does not pass: the seconds until the oldest entry of the log leaves its window; else null.
    Events with a null key share one log. An event without a time does not pass, takes no quota and has no retry_after.
    """
    window = int(window_seconds * 1_000_000)

    def run(batches):
        current, log = object(), deque()  # no key is equal to the first one
        for batch in batches:
            allowed, waits = [], []
            for k, own in groupby(zip(batch["k"].to_pylist(), batch["t"].to_pylist(), strict=True), key=lambda x: x[0]):
                if k != current:
                    current, log = k, deque()
                for _, now in own:
                    passes = now is not None and accepted([now], most, window, log)[0]
                    allowed.append(passes)
                    waits.append(None if passes or now is None or not log else log[0] + window - now)
            columns = [batch["event"], batch["key"], batch["t"], pa.array(allowed, pa.bool_()), pa.array(waits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["event", "key", "t", "allowed", "wait"])

    kinds = {c: events.schema[c].dataType.simpleString() for c in (event, key)}
    rows = events.select(F.col(event).alias("event"), F.col(key).alias("key"), micros(ts).alias("t"), F.col(key).cast("string").alias("k"))
    ordered = rows.repartition("k").sortWithinPartitions("k", "t", "event")
    decided = ordered.mapInArrow(run, f"event {kinds[event]}, key {kinds[key]}, t long, allowed boolean, wait long")
    return decided.select(F.col("event").alias(event), F.col("key").alias(key), F.timestamp_micros("t").alias(ts), "allowed", (F.col("wait") / 1_000_000).alias("retry_after"))


def fixed_window(events: DataFrame, most: int = 30, width: str = "1 minute", key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """allowed: among the first of its key in its window."""
    own = Window.partitionBy(key, F.window(ts, width)).orderBy(ts, event)
    return events.withColumn("allowed", F.row_number().over(own) <= most)


def trailing_count(events: DataFrame, window_seconds: float, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """n: events of the key in the window up to this one, rejected ones too."""
    span = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-int(window_seconds * 1_000_000) + 1, 0)
    return events.withColumn("n", F.count("*").over(span))


def valid_tokens(tokens: DataFrame, users: DataFrame, at: Column) -> DataFrame:
    """Active tokens that haven't expired, with their users."""
    live = tokens.where(F.col("is_active") & (F.col("expires_at") >= at))
    return live.join(users, "user_id")


def expired(tokens: DataFrame, at: Column) -> DataFrame:
    """tokens with is_active turned off where they have expired."""
    return tokens.withColumn("is_active", F.col("is_active") & (F.col("expires_at") >= at))


def issue(users: DataFrame, requests: DataFrame) -> DataFrame:
    """users with those that are asked for and don't exist yet; ids go on from the highest one."""
    fresh = requests.select("username").distinct().join(users.select("username"), "username", "left_anti")
    # New users of one run; a sequence of ids needs their order.
    base = users.agg(F.coalesce(F.max("user_id"), F.lit(0)).alias("base"))
    numbered = fresh.withColumn("n", F.row_number().over(Window.orderBy("username"))).join(F.broadcast(base))
    return users.unionByName(numbered.select((F.col("base") + F.col("n")).alias("user_id"), "username"), allowMissingColumns=True)


def is_fresh(updated: Column, now: Column, hours: int = 72) -> Column:
    """False where the time is missing or can't be read."""
    at = F.try_to_timestamp(updated) if isinstance(updated, Column) else updated
    return F.coalesce(micros(now) - micros(at) < hours * 3_600_000_000, F.lit(False))


def latency_ms(start: Column, end: Column) -> Column:
    return F.round((micros(end) - micros(start)) / 1000, 1)

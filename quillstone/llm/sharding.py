"""Sharding: histogram sort.

Rows are ordered by a key and cut into shards of near equal bytes. The cuts (splitters) are found by counting alone: probes
cut the space of keys into cells, one pass over the rows counts the exact bytes in each cell, and the cells that hold a cut are
probed anew, until each cut is within the tolerance or falls between two single rows. Then every row knows its shard, and the
rows are exchanged once. The driver sees counts of cells alone, a bounded number a pass.

The key has three parts of 62 bits: a hash of the text, so that equal texts stand together, one of the row's id, and one of the
row's place in the table. A text that holds many rows is cut by the second part, and repeated rows by the third; so no
group, however large, keeps a cut from its place. The rows are written once to the shared folder before they are counted, which
fixes their places; all passes, and tasks that are tried again, see the same keys.

Slots number the rows of a shard in small parts of the space of keys: rows are counted by part, the counts are summed up, and a
row has its part's sum and its number within the part. Parts with many rows are cut further by the next part of the key.

Defined results: a null text has no bytes and the CRC-32 of none. Rows with null or equal ids, and repeated rows, are rows of
their own. A row is never cut, so a shard's bytes differ from the mean by the tolerance and the largest row at most, about. With fewer
rows than shards some shards are empty. An empty table gives an empty result. Columns of any name may stand beside the key's.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, table

SHARDS = 24
#: How far a cut may be from its place, as a share of a shard's mean bytes.
TOLERANCE = 0.0005
#: Bytes that a row counts besides its text.
ROW_BYTES = 8
#: Bits of a part of the key; cells of a pass at most.
BITS, CELLS = 62, 4096
#: Parts that slots are numbered in hold about so many rows; those with more than four times as many are cut by the next part of the key.
NUMBERED, LEAST_PARTS = 32_768, 4096
LEVELS = ("k0", "k1", "k2")


def hashed(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def measured(documents: DataFrame, *keep: str, key: str = "doc_id") -> DataFrame:
    """row (the columns to keep, or all), size, text_crc32 and the parts of the key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.struct(*(keep or ["*"])).alias("row"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hashed(text).alias("k0"), hashed(F.col(key)).alias("k1"), hashed(F.monotonically_increasing_id()).alias("k2"),
    )


@dataclass(frozen=True)
class Open:
    """A part of the space of keys that holds a cut: values from lo to stop (exclusive) of one part of the key, behind fixed values of the parts before; below: bytes of all keys before it."""

    fixed: tuple[int, ...]
    lo: int
    stop: int
    below: int

    def holds(self) -> Column:
        level = len(self.fixed)
        same = [F.col(LEVELS[i]) == v for i, v in enumerate(self.fixed)]
        held = (F.col(LEVELS[level]) >= self.lo) & (F.col(LEVELS[level]) < self.stop)
        for s in same:
            held &= s
        return held


def counted(rows: DataFrame, places: list[Open], cells: int) -> dict[Open, list]:
    """(first key, last key, bytes, rows) of the cells of each place that have rows, in order: one pass over the rows, one row a cell to the driver."""
    each = max(1, cells // len(places))
    told = []
    for i, p in enumerate(places):
        at, step = LEVELS[len(p.fixed)], -(-(p.stop - p.lo) // each)
        told.append(F.when(p.holds(), F.struct(F.lit(i).alias("place"), F.expr(f"({at} - {p.lo}) div {step}").alias("cell"), F.col(at).alias("at"))))
    found = rows.select(F.coalesce(*told).alias("x"), "size").where("x is not null").groupBy("x.place", "x.cell")
    sums = found.agg(F.min("x.at").alias("first"), F.max("x.at").alias("last"), F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("place", "cell").collect()
    out: dict[Open, list] = {p: [] for p in places}
    for r in sums:
        out[places[r["place"]]].append((r["first"], r["last"], r["bytes"], r["n"]))
    return out


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, cells: int = CELLS) -> tuple[list[tuple[int, ...]], int]:
    """The first keys of all shards but the first, sorted, for rows(size, k0, k1, k2); and the number of rows."""
    whole = Open((), 0, 1 << BITS, 0)
    found = counted(rows, [whole], cells)
    total, n_rows = sum(c[2] for c in found[whole]), sum(c[3] for c in found[whole])
    if not n_rows or shards < 2:
        return [], n_rows
    allowed = tolerance * total / shards
    wanted = {i: (whole, total * i / shards) for i in range(1, shards)}
    cuts: dict[int, tuple[int, ...]] = {}
    while wanted:
        left = {}
        for i, (place, target) in wanted.items():
            held = found[place]
            sums = [*accumulate((c[2] for c in held), initial=place.below)]
            # The cell that the cut falls in: the last that begins at or before it.
            c = min(bisect_right(sums, target) - 1, len(held) - 1)
            first, last, size, n = held[c]
            level = len(place.fixed)
            near_start = target - sums[c] <= sums[c + 1] - target
            if n == 1 or size <= allowed or min(target - sums[c], sums[c + 1] - target) <= allowed or (first == last and level == len(LEVELS) - 1):
                cuts[i] = (*place.fixed, first if near_start else last + 1, *[0] * (len(LEVELS) - 1 - level))
            elif first == last:
                left[i] = (Open((*place.fixed, first), 0, 1 << BITS, sums[c]), target)
            else:
                left[i] = (Open(place.fixed, first, last + 1, sums[c]), target)
        wanted = left
        if wanted:
            found = counted(rows, sorted({p for p, _ in wanted.values()}, key=lambda p: (p.fixed, p.lo)), cells)
    return sorted(cuts.values()), n_rows


def shard_of(cuts: list[tuple[int, ...]]) -> Column:
    """Cuts at or before the key."""
    own = F.struct(*LEVELS)
    out = F.lit(0)
    for cut in cuts:
        out = out + (own >= F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(LEVELS, cut, strict=True)])).cast("int")
    return out


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows(shard, k0, k1, k2, ...) with slot, by the key's order within the shard."""
    bits = min(30, max(0, ceil(log2(max(LEAST_PARTS, n_rows / NUMBERED)))))
    parts = ["shard", "p0"]
    rows = rows.withColumn("p0", F.shiftright("k0", BITS - bits))
    for level in (1, 2):
        # A part with many rows takes the first bits of the next part of the key along. There are fewer of them than a
        # row in 4 * mean, so at 100 billion rows a million, of 30 bytes each.
        mean = max(n_rows >> bits, 64)
        many = rows.groupBy(*parts).agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * mean)
        many = many.select(*parts, F.ceil(F.log2(F.col("_n") / mean)).cast("int").alias("_bits"))
        rows = rows.join(F.broadcast(many), parts, "left")
        rows = rows.withColumn(f"p{level}", F.coalesce(F.expr(f"shiftright(k{level}, {BITS} - _bits)"), F.lit(0).cast("long"))).drop("_bits")
        parts.append(f"p{level}")
    sums = Window.partitionBy("shard").orderBy(*parts[1:]).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*parts).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(sums), F.lit(0))).drop("_n")
    own = Window.partitionBy(*parts).orderBy(*LEVELS)
    numbered = rows.withColumn("_number", F.row_number().over(own)).join(before.hint("merge"), parts)
    return numbered.withColumn("slot", F.col("_before") + F.col("_number") - 1).drop("_before", "_number", *parts[1:])


def shard(documents: DataFrame, *keep: str, shards: int = SHARDS, tolerance: float = TOLERANCE, key: str = "doc_id") -> DataFrame:
    """row (the columns to keep, or all), size, text_crc32, shard and slot for each of documents(text, key, ...)."""
    rows = Tables(documents.sparkSession).kept("rows", measured(documents, *keep, key=key))
    cuts, n_rows = splitters(rows, shards, tolerance)
    return with_slots(rows.withColumn("shard", shard_of(cuts)), n_rows).drop(*LEVELS)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

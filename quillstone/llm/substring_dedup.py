"""Suffix-array dedup by prefix-free parsing: every string of 100 bytes (a window) stays only where it stands first.

The corpus is parsed to phrases at rolling-hash triggers (repeats.py). A phrase holds each of its windows whole. Triggers
that occur once drop out. The dictionary holds each distinct phrase with the first place that the parse has of it in
corpus order; whatever else the parse has of a phrase is a repeat. Equal windows have the same trigger, so dictionary
phrases are dealt out by trigger, and a suffix array of those of a task, sorted to the 100 bytes of a window, brings equal
windows together; combined with the places of their phrases in the parse it gives each window's first place in corpus
order. Only windows that share 66 bytes about the trigger with another phrase take part. A trigger with more than MOST
phrases has several suffix arrays; the first windows of each are brought together by a 128-bit hash.

Defined results: a null text is an empty one; a text below 100 bytes has nothing removed. Rows with a null doc_id come
before all others, in the order of a hash of their texts. Of rows with the same doc_id, a string is earlier if it starts
at a smaller byte, in whichever row; of those that start at the same byte, the one in the row with the smaller 32-bit hash
of its text. Rows that agree in id and text are one document: they don't remove each other. Texts are read whole, however
long. Columns besides doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, table, with_code
from .repeats import FIELDS, LENGTH, covered, doubtful, phrases, spread, suffix_ranks, window_hashes
from .shingles import texts_of

#: Phrases of a trigger in one suffix array, about; and bytes of phrases that are sorted at once.
MOST, SORTED_BYTES = 4096, 1_500_000
#: The low bits of a phrase's place tell rows of the same doc_id apart; the high bits are its first byte.
_ROW = 0xFFFFFFFF


def numbered(documents: DataFrame) -> DataFrame:
    """doc (the id; below all others for null ids), row (a hash of the text) and text."""
    hashed = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    doc = F.coalesce(F.col("doc_id").cast("long"), hashed.bitwiseAND(F.lit((1 << 60) - 1)) + F.lit(-(1 << 63)))
    return documents.select(doc.alias("doc"), hashed.bitwiseAND(F.lit(_ROW)).alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))


def parsed(docs: DataFrame, *fields: str) -> DataFrame:
    """A row for each phrase of docs(doc, row, text): doc, place if start is among the fields, and the first fields of phrases, as many as named."""
    names = ["place" if f == "start" else f for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for found in phrases(texts_of(batch.column(2)), 1 + len(fields)):
                own = dict(zip(["owner", *fields], found, strict=True))
                if "start" in own:
                    own["start"] = own["start"].astype(np.int64) << 32 | row[own["owner"]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[own["owner"]]), *[pa.array(own[f]) for f in fields]], names=["doc", *names])

    schema = "doc long, " + ", ".join(f"{n} {'int' if FIELDS[x] == 'int32' and x != 'start' else 'long'}" for n, x in zip(names, fields, strict=True))
    return docs.select("doc", "row", "text").mapInArrow(run, schema)


def compressed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([press.compress(t) for t in texts_of(batch.columns[-1])], pa.binary())], names=batch.schema.names)

    return docs.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'text' else 'long'}" for c in docs.columns))


def lists(column: pa.Array) -> Iterator:
    """The numbers of each row's list, or the fields of its structs; null: none."""
    flat, ends = column.flatten(), np.cumsum([n.as_py() or 0 for n in column.value_lengths()])
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)} if pa.types.is_struct(flat.type) else None
    whole = flat.to_numpy(zero_copy_only=False).astype(np.int64) if fields is None else None
    at = 0
    for end in ends.tolist():
        yield whole[at:end] if fields is None else {name: values[at:end] for name, values in fields.items()}
        at = end


_SLICE = ["trigger", "part", "parts", "doc", "start", "row", "bytes"]


def doubtful_slices(rows: DataFrame) -> DataFrame:
    """Of rows(doc, row, phrases, text): the bytes of the doubtful windows of each phrase, with the place of the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in _SLICE]
            for doc, row, found, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists(batch.column(2)), batch.column(3), strict=True):
                text = expand.decompress(text.as_py())
                low, high = doubtful(found["windows"], found["at"], found["flags"])
                some = high > low
                start, stop = (found["start"] + low)[some], (found["start"] + high)[some] + LENGTH - 1
                for values, own in zip(out, (*(found[f][some] for f in ("trigger", "part", "parts")), np.full(len(start), doc), start, np.full(len(start), row)), strict=False):
                    values.append(own)
                out[-1] += [text[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(v)) for v in out[:-1]], pa.array(out[-1], pa.binary())], names=_SLICE)

    return rows.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'bytes' else 'long'}" for c in _SLICE))


_SORTED = ["doc", "row", "start", "n", "a", "b"]


def sorted_slices(rows: pa.Table) -> pa.RecordBatch:
    """The windows of these slices that repeat an earlier one of them, as runs; and, where their trigger has several suffix arrays, the first of each class with its hash."""
    data = rows.column("bytes").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw, ends = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    get = lambda c: rows.column(c).to_numpy()
    windows = np.diff(ends) - (LENGTH - 1)
    owner, at = np.repeat(np.arange(len(windows)), windows), spread(ends[:-1], windows)
    rank, doc, row = suffix_ranks(raw, at), get("doc")[owner], get("row")[owner]
    start = get("start")[owner] + at - ends[:-1][owner]
    # The suffix array, suffixes of the same 100 bytes in the order of the corpus.
    array = np.lexsort((row, start, doc, rank))
    head = np.flatnonzero(np.concatenate([[True], rank[array][1:] != rank[array][:-1]]))
    first = np.repeat(array[head], np.diff(np.append(head, len(array))))
    later = np.zeros(len(array), bool)
    later[array] = (doc[array] != doc[first]) | (start[array] != start[first]) | (row[array] != row[first])
    # Runs of repeats: neighbours in a slice are neighbours here.
    repeat = np.flatnonzero(later)
    jump = np.concatenate([[True], (np.diff(repeat) != 1) | (np.diff(owner[repeat]) != 0)]) if len(repeat) else np.zeros(0, bool)
    begins = np.flatnonzero(jump)
    lengths = np.diff(np.append(begins, len(repeat)))
    told = [repeat[begins], np.flatnonzero(~later & (get("parts")[owner] > 1))]
    chosen, n = np.concatenate(told), np.concatenate([lengths, np.ones(len(told[1]), np.int64)])
    a, b = window_hashes(raw, at[told[1]])
    hashed = lambda h: pa.concat_arrays([pa.nulls(len(begins), pa.int64()), pa.array(h, pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(doc[chosen]), pa.array(row[chosen]), pa.array(start[chosen]), pa.array(n), hashed(a), hashed(b)], names=_SORTED)


def suffix_arrays(slices: DataFrame, sorted_bytes: int = SORTED_BYTES) -> DataFrame:
    """sorted_slices for slices that are sorted by trigger and part; all of the same trigger and part are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.column(len(_SLICE) - 1).nbytes
            if size >= sorted_bytes:
                rows = pa.Table.from_batches(waiting).combine_chunks()
                trigger, part = rows.column("trigger").to_numpy(), rows.column("part").to_numpy()
                last = np.flatnonzero((trigger[1:] != trigger[:-1]) | (part[1:] != part[:-1]))[-1:] + 1
                if len(last):
                    yield sorted_slices(rows.slice(0, last[0]))
                    rest = rows.slice(last[0])
                    waiting = rest.to_batches()
                    size = sum(len(x) for x in rest.column("bytes").to_pylist())
        if waiting:
            yield sorted_slices(pa.Table.from_batches(waiting).combine_chunks())

    return slices.mapInArrow(run, ", ".join(f"{c} long" for c in _SORTED))


def cleaned(rows: DataFrame, texts: bool = False) -> DataFrame:
    """The result for rows(doc_id, text, all, first, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, text, every, first, runs in zip(*(batch.column(i).to_pylist() for i in range(2)), *(lists(batch.column(i)) for i in range(2, 5)), strict=True):
                text, repeated = expand.decompress(text), np.zeros(0, np.int64)
                if len(every):
                    later = every[~np.isin(every >> 32, first)]
                    repeated = np.concatenate([spread(later >> 32, later & _ROW), spread(runs >> 32, runs & _ROW)])
                gone, n_runs = covered(len(text), repeated)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(repeated) else text
                out.append((doc_id, len(text), int(gone.sum()), n_runs, sha256(kept).hexdigest(), kept if texts else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(columns[i], pa.int64()) for i in range(4)), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(documents: DataFrame, texts: bool = False, most: int = MOST, sorted_bytes: int = SORTED_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each document; with texts also kept, the bytes that are left."""
    spark = documents.sparkSession
    with_code(spark)
    keep = Tables(spark)
    docs = numbered(documents)

    once = parsed(docs, "trigger", "several").groupBy("trigger").agg(F.count("*").alias("n"), F.max("several").alias("any"))
    # A phrase with several places of its trigger may hold equal windows itself.
    triggers = keep.kept("triggers", once.where("n > 1 or any = 1").select("trigger"))
    parse = keep.kept("parse", parsed(docs, *list(FIELDS)[1:]).join(triggers, "trigger", "left_semi"))
    keep.drop("triggers")

    # The dictionary: each distinct phrase with its first place in the parse.
    start, row = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(_ROW))
    shared = [F.min(c).alias(c) for c in ("at", "sides", "several")]
    words = parse.groupBy("trigger", "content", "windows").agg(F.min(F.struct("doc", "place")).alias("x"), *shared)
    sides = [F.shiftrightunsigned("sides", 32).alias("left"), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("right")]
    words = keep.kept("dictionary", words.select("trigger", "x.doc", "x.place", "windows", "at", *sides, "several"))
    # Only triggers of several phrases, and those of one phrase that repeats itself, leave room for doubt.
    alike = words.groupBy("trigger").agg(F.count("*").alias("n"), F.max("several").alias("any")).where("n > 1 or any = 1")
    twice = lambda side: words.where(f"{side} <> 0").groupBy("trigger", side).agg(F.count("*").alias("n")).where("n > 1").select("trigger", side, F.lit(1).alias(f"{side}_twice"))
    told = words.join(alike, "trigger", "left").join(twice("left"), ["trigger", "left"], "left").join(twice("right"), ["trigger", "right"], "left")
    flag = lambda side, bit: F.when((F.col("any") == 1) | F.col(f"{side}_twice").isNotNull(), bit).otherwise(0)
    parts = F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64("doc", "place"), parts).cast("int")
    told = told.select("trigger", part.alias("part"), parts.alias("parts"), "doc", "place", "windows", "at", (flag("left", 1) + flag("right", 2)).cast("int").alias("flags"))
    first = keep.kept("first", told)
    keep.drop("dictionary")

    open_ = first.where("flags > 0").groupBy("doc", row.alias("row")).agg(F.collect_list(F.struct("trigger", "part", "parts", start.alias("start"), "windows", "at", "flags")).alias("phrases"))
    slices = doubtful_slices(open_.join(compressed(docs.select("doc", "row", "text")), ["doc", "row"]).select("doc", "row", "phrases", "text"))
    dealt = slices.repartition("trigger", "part").sortWithinPartitions("trigger", "part")
    found = keep.kept("sorted", suffix_arrays(dealt, sorted_bytes))
    # Of the first windows of several suffix arrays, those that aren't first of all.
    place = F.struct("doc", "start", "row")
    again = found.where("a is not null").withColumn("least", F.min(place).over(Window.partitionBy("a", "b"))).where(place != F.col("least"))
    runs = found.where("a is null").drop("a", "b").unionByName(again.drop("a", "b", "least"))

    # Lists of numbers: a start in the high bits, how many windows in the low ones. Rows that agree in id and text share a list.
    pair = lambda start, n: F.shiftleft(start, 32).bitwiseOR(n.cast("long"))
    every = parse.groupBy("doc", row.alias("row")).agg(F.collect_set(pair(start, F.col("windows"))).alias("all"))
    own = first.groupBy("doc", row.alias("row")).agg(F.collect_list(start).alias("first"))
    gone = runs.groupBy("doc", "row").agg(F.collect_list(pair(F.col("start"), F.col("n"))).alias("runs"))
    rows = compressed(docs.select("doc", "row", "doc_id", "text"))
    told = every.join(own, ["doc", "row"], "left").join(gone, ["doc", "row"], "left")
    out = cleaned(rows.join(told, ["doc", "row"], "left").select("doc_id", "text", "all", "first", "runs"), texts)
    return out if texts else out.drop("kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))

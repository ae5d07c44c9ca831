"""Cross-tokenizer alignment: which tokens of two tokenizers stand over the same bytes, and how firm each link is in the corpus.

Both tokenizers read a text as a space and the text. The places where tokens of both end cut them into groups; a token of A
and one of B are linked where their bytes overlap. A pair of ids counts as many links as hold it in the whole corpus.

Id-striped dense count matrices: ids of B are dealt to stripes of neighbouring ids. Links are encoded once, in batches of
documents, and written as arrays by batch and stripe. Counts of pairs are summed up within tasks, meet by stripe, and are added into a
dense block of the stripe's ids by all ids of A with np.add.at; the maximum of a row is the best count of an id of B. For scoring, a
stripe's counts go ahead of its links into the same tasks (a stripe with many links to several), so links look their counts up
in one block; sums of documents go back to their batch. A task holds a block, a batch's sums and a row of links at a time.

Words are encoded once and remembered, new ones of a batch in one go: behind a space, a character that is no white space begins a new piece in both tokenizers (no
piece of B has a space inside), if the character before is no space. So the parts of a text between such places are encoded
on their own, and their links don't cross.

Defined results: texts that are null, empty or not given back by the tokens of both (byte by byte) have no tokens: zeros, and ''
for the groups. Strings of special tokens are plain text. Rows with null or equal ids, and repeated rows, are documents of their
own and count each. Very long texts are encoded whole. An empty table gives an empty result. Columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, table, with_code
from .packing import vocabulary

#: Cells of a stripe's dense block (8 bytes each).
BLOCK_CELLS = 4_000_000
#: Characters and documents of a batch, about; distinct pairs that a task sums up before it hands them on; links of a stripe in one task.
BATCH_CHARACTERS, BATCH_DOCS, HELD_PAIRS, TASK_LINKS = 4_000_000, 60_000, 2_000_000, 20_000_000
#: Parts and links that a worker remembers, about; characters of new words that are encoded at once.
MEMORY_PARTS, MEMORY_LINKS, RUN_CHARACTERS = 400_000, 6_000_000, 100_000
#: Where parts of a text begin that both tokenizers read on their own.
_cuts = regex.compile(r"(?<=[^ ])(?= [!-~\p{L}])").split
#: How a run without spaces begins if the space before it is such a place.
_plain = regex.compile(r"[!-~\p{L}]").match


class Pair:
    """Two tokenizers, A from ranks of byte pieces and B from a model of pieces, and a memory of parts of texts: their links and groups."""

    def __init__(self, ranks: str, model: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.b.get_piece_size()
        self.size_a = max(table.values()) + 1
        self.bytes_a = [b""] * self.size_a
        for piece, i in table.items():
            self.bytes_a[i] = piece
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(n))]
        self.length_a, self.length_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: An id with what may stand behind it: another id of its side, the other side, another group.
        self.said = np.array([f"{i}{mark}".encode() for i in range(max(n, self.size_a)) for mark in ",|;"], object)
        self.forget()

    def forget(self) -> None:
        """Parts by number: their tokens, groups and links. A word that begins plainly is known by itself, any other part with the space before it."""
        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        self.odd: set[int] = set()  # parts without groups
        self.counts, self.pairs = np.zeros((4, 0), np.int64), np.zeros(0, np.int64)

    def encoded(self, spaced: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B of a text that begins with a space; None if they don't give it back."""
        a, b, whole = self.a.encode_ordinary(spaced), self.b.encode(spaced[1:]), spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return a, b

    def learn(self, keys: list[str]) -> None:
        """Parts that stand behind one another as one text; those that aren't given back have no groups."""
        parts = [k if k[:1] == " " else " " + k for k in keys]
        both = self.encoded("".join(parts))
        stops = np.cumsum([len(p.encode()) for p in parts])
        if both is not None:
            ids_a, ids_b = (np.array(x, np.int64) for x in both)
            end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
            common = np.intersect1d(end_a, end_b, assume_unique=True)
        if both is None or len(keys) > 1 and not np.isin(stops, common, assume_unique=True).all():
            if len(keys) == 1:
                self.known[keys[0]] = len(self.groups)
                self.odd.add(len(self.groups))
                self.groups.append(None)
                self.counts = np.concatenate([self.counts, np.zeros((4, 1), np.int64)], axis=1)
            else:
                self.learn(keys[: len(keys) // 2])
                self.learn(keys[len(keys) // 2 :])
            return
        # Tokens of B that a token of A overlaps: from the first that ends behind its start to the first that ends at or behind its end.
        first = np.searchsorted(end_b, end_a - self.length_a[ids_a], side="right")
        n = np.searchsorted(end_b, end_a, side="left") - first + 1
        before = np.cumsum(n) - n
        at = np.repeat(first - before, n) + np.arange(n.sum())
        pairs = ids_b[at] * self.size_a + np.repeat(ids_a, n)
        # The ids in the order of the groups, those of A first: each moves behind the other side's ids of the groups so far.
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        upto_a, upto_b = (np.concatenate([[0], np.searchsorted(e, common, side="right")]) for e in (end_a, end_b))
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + upto_b[group_a]] = 3 * ids_a + (end_a == common[group_a])
        codes[np.arange(len(ids_b)) + upto_a[group_b + 1]] = 3 * ids_b + 2 * (end_b == common[group_b])
        said = self.said[codes].tolist()
        cut_a, cut_b, cut_groups = (np.concatenate([[0], np.searchsorted(e, stops, side="right")]) for e in (end_a, end_b, common))
        cuts = (cut_a + cut_b).tolist()
        number = len(self.groups)
        self.groups += [b"".join(said[i:k]) for i, k in zip(cuts[:-1], cuts[1:], strict=True)]
        self.known.update(zip(keys, range(number, len(self.groups)), strict=True))
        n_links = np.diff(np.concatenate([before, [len(pairs)]])[cut_a])
        self.counts = np.concatenate([self.counts, [np.diff(cut_a), np.diff(cut_b), np.diff(cut_groups), n_links]], axis=1)
        self.pairs = np.concatenate([self.pairs, pairs])

    def parts(self, text: str) -> list[str]:
        """Keys of the parts of a text."""
        words = text.split(" ")
        if all(map(_plain, set(words).difference(self.known))):
            return words
        # Behind several spaces, or before anything odd, the places are looked for with care.
        return [p[1:] if _plain(p, 1) else p for p in _cuts(" " + text)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text: tokens of A, of B, groups and links (a row each), and the digest of its groups; for each link: its pair, b * size_a + a, and its text."""
        if len(self.known) >= MEMORY_PARTS or len(self.pairs) >= MEMORY_LINKS:
            self.forget()
        keys = [self.parts(t) if t else [] for t in texts]
        self.look_up(set().union(*keys))
        places = [[*map(self.known.__getitem__, own)] for own in keys]
        for i, own in enumerate(places):
            if not self.odd.isdisjoint(own):
                # Its parts together might still give the text back; else it has no tokens.
                whole = " " + texts[i]
                self.look_up({whole})
                places[i] = [self.known[whole]] if self.known[whole] not in self.odd else []
        digests = [sha256(b"".join(map(self.groups.__getitem__, own))[:-1]).hexdigest() if own else "" for own in places]
        sizes = np.array([*map(len, places)])
        flat = np.fromiter(chain.from_iterable(places), np.int64, int(sizes.sum()))
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(self.counts[:, flat], axis=1)], axis=1)
        stops = np.concatenate([[0], np.cumsum(sizes)])
        n = self.counts[3, flat]
        starts = (np.cumsum(self.counts[3]) - self.counts[3])[flat]
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.diff(sums[:, stops], axis=1), digests, self.pairs[at], np.repeat(np.repeat(np.arange(len(texts)), sizes), n)

    def look_up(self, keys: set[str]) -> None:
        """What isn't known of these is learned: words in runs, other parts by themselves."""
        run, size = [], 0
        for k in keys.difference(self.known):
            if k[:1] == " ":
                self.learn([k])
                continue
            run.append(k)
            size += len(k)
            if size >= RUN_CHARACTERS:
                self.learn(run)
                run, size = [], 0
        if run:
            self.learn(run)


@lru_cache(1)
def pair_of(ranks: str, model: str) -> Pair:
    return Pair(ranks, model)


LINKS = "batch long, stripe int, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, cells binary, docs binary, times binary"


def links(documents: DataFrame, ranks: str, model: str, stripe_ids: int) -> DataFrame:
    """By batch: a row for each document (stripe is null), and for each stripe its links: cells of the block, documents of the batch, and how often."""
    names = [x.split()[0] for x in LINKS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), *[pa.binary()] * 3]

    def record(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = pair_of(ranks, model)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[str] = []

        def packed() -> Iterator[pa.RecordBatch]:
            (n_a, n_b, n_groups, n_links), digests, pairs, docs = encode(texts)
            yield record(batch=[number] * len(ids), doc=range(len(ids)), doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=digests)
            # One number for a pair and its document; sorted, so that each stripe is a run.
            coded, times = np.unique(pairs * len(ids) + docs, return_counts=True)
            pairs, docs = coded // len(ids), coded % len(ids)
            stripe_cells = stripe_ids * encode.size_a
            stripes, starts = np.unique(pairs // stripe_cells, return_index=True)
            stops = [*starts[1:], len(pairs)]
            cut = lambda values: [values[i:k].astype(np.uint32).tobytes() for i, k in zip(starts, stops, strict=True)]
            if len(stripes):
                yield record(batch=[number] * len(stripes), stripe=stripes.tolist(), cells=cut(pairs % stripe_cells), docs=cut(docs), times=cut(times))

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARACTERS or len(ids) >= BATCH_DOCS:
                    yield from packed()
                    number += 1
                    size = 0
                    ids.clear(), texts.clear()
        if ids:
            yield from packed()

    with_code(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LINKS)


def _array(value: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(value, kind)


def pair_counts(linked: DataFrame, stripe_ids: int, size_a: int) -> DataFrame:
    """stripe, cells and counts of all its pairs that occur, and n (their links): the dense block of each stripe, as what is not 0 in it."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def one(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            cells, where = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
            counts = np.zeros(len(cells), np.int64)
            np.add.at(counts, where, np.concatenate([n for _, n in own]))
            return cells, counts

        def handed() -> Iterator[pa.RecordBatch]:
            for stripe, own in held.items():
                cells, counts = one(own)
                yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([cells.tobytes()]), pa.array([counts.tobytes()])], names=["stripe", "cells", "counts"])
            held.clear()

        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                # A row's cells are sorted, so those of a pair are a run.
                cells = _array(row["cells"])
                starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] + 1))
                found = cells[starts], np.add.reduceat(_array(row["times"]).astype(np.int64), starts)
                held.setdefault(row["stripe"], []).append(found)
                size += len(found[0])
            if size >= HELD_PAIRS:
                # What the batches have in common is summed up first; only if little is, the pairs are handed on.
                for stripe, own in held.items():
                    held[stripe] = [one(own)]
                size = sum(len(c) for own in held.values() for c, _ in own)
                if size >= HELD_PAIRS // 2:
                    yield from handed()
                    size = 0
        yield from handed()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            cells = np.flatnonzero(block)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([cells.astype(np.uint32).tobytes()]), pa.array([block[cells].tobytes()]), pa.array([int(block.sum())])], names=["stripe", "cells", "counts", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["stripe"] != current:
                    if current is not None:
                        yield told()
                    current, block = row["stripe"], np.zeros(stripe_ids * size_a, np.int64)
                np.add.at(block, _array(row["cells"]), _array(row["counts"], np.int64))
        if current is not None:
            yield told()

    partial = linked.where("stripe is not null").select("stripe", "cells", "times").mapInArrow(summed, "stripe int, cells binary, counts binary")
    return partial.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(added, "stripe int, cells binary, counts binary, n long")


def scores(linked: DataFrame, counts: DataFrame, stripe_ids: int, size_a: int) -> DataFrame:
    """batch, docs, best and sums: of each stripe and batch, the links at their id's highest count and the sum of counts, by document of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                cells = _array(row["cells"])
                if row["batch"] is None:
                    block = np.zeros(stripe_ids * size_a, np.int64)
                    np.add.at(block, cells, _array(row["counts"], np.int64))
                    best = block.reshape(stripe_ids, size_a).max(axis=1)
                    continue
                times, n = _array(row["times"]).astype(np.int64), block[cells]
                docs, where = np.unique(_array(row["docs"]), return_inverse=True)
                at_best, sums = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                np.add.at(at_best, where, times * (n == best[cells // size_a]))
                np.add.at(sums, where, times * n)
                rows.append((row["batch"], docs.tobytes(), at_best.tobytes(), sums.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["batch", "docs", "best", "sums"])

    # As many tasks for a stripe as its links need; there is a row for each stripe, and their number is that of the vocabulary.
    deals = F.ceil(F.col("n") / TASK_LINKS).cast("int")
    dealt = counts.select("stripe", deals.alias("deals"))
    ahead = counts.select("stripe", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.lit(None).cast("long").alias("batch"), "cells", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"), "counts")
    behind = linked.where("stripe is not null").select("stripe", "batch", "cells", "docs", "times").join(F.broadcast(dealt), "stripe")
    behind = behind.select("stripe", F.pmod(F.xxhash64("batch"), F.col("deals")).cast("int").alias("deal"), "batch", "cells", "docs", "times", F.lit(None).cast("binary").alias("counts"))
    both = ahead.union(behind).repartition("stripe", "deal").sortWithinPartitions("stripe", "deal", F.col("batch").asc_nulls_first())
    return both.select("batch", "cells", "docs", "times", "counts").mapInArrow(run, "batch long, docs binary, best binary, sums binary")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def finished(linked: DataFrame, scored: DataFrame) -> DataFrame:
    """The documents of each batch with the sums of all stripes."""
    about = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, docs, best, sums = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            own = {c: [d[c] for d in docs] for c in about} | {"n_best": best[: len(docs)], "count_sum": sums[: len(docs)]}
            return pa.RecordBatch.from_arrays([pa.array(own[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in names], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["batch"] != current:
                    if docs:
                        yield told()
                    current, docs, best, sums = row["batch"], [], np.zeros(1024, np.int64), np.zeros(1024, np.int64)
                if row["docs"] is None:
                    docs.append(row)
                    if len(docs) > len(best):
                        best, sums = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (best, sums))
                else:
                    at = _array(row["docs"])
                    best[at] += _array(row["best"], np.int64)
                    sums[at] += _array(row["sums"], np.int64)
        if docs:
            yield told()

    none = lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    first = linked.where("stripe is null").select("batch", "doc", *about, *none("binary", "docs", "best", "sums"))
    then = scored.select("batch", F.lit(None).cast("int").alias("doc"), *none("long", *about[:-1]), *none("string", about[-1]), "docs", "best", "sums")
    both = first.union(then).repartition("batch").sortWithinPartitions("batch", F.col("doc").asc_nulls_last())
    return both.select("batch", *about, "docs", "best", "sums").mapInArrow(run, RESULT)


def align(documents: DataFrame, ranks: str | None = None, model: str | None = None, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """A row for each of documents(doc_id, text)."""
    import sentencepiece

    ranks, model = ranks or vocabulary("byte_bpe_50k.tiktoken"), model or vocabulary("piece_bpe_32k.model")
    with open(ranks, "rb") as lines:
        size_a = 1 + max(int(line.split()[1]) for line in lines)
    size_b = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    stripe_ids = min(size_b, max(1, block_cells // size_a))
    tables = Tables(documents.sparkSession)
    linked = tables.kept("links", links(documents, ranks, model, stripe_ids))
    counts = tables.kept("counts", pair_counts(linked, stripe_ids, size_a))
    return finished(linked, scores(linked, counts, stripe_ids, size_a))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))

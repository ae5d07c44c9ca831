"""Packing: cost-balanced sequences of a fixed number of tokens.

Each task packs its own documents in groups of a bounded number of tokens; nothing is shuffled, and a task that is tried
again packs the same rows the same way. In a group, the whole sequences that long documents fill come first. The rest is
dealt in descending order of its cost, linear plus quadratic in its length as attention is, to the sequence of lowest
cost that has room for it; where none has, it is cut to fill the one with most room. The last tokens of a group fill
sequences that are powers of two, so no sequence needs padding.

Defined results: a null text is an empty one, and its document is the end token alone. Rows with equal or null doc_ids
are documents of their own. Very long texts are cut to as many pieces as they need. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_code

CAPACITY, END_ID = 2048, 1
#: Tokens after which a group is packed, about.
GROUP_TOKENS = 2_000_000
#: Linear and quadratic cost of a token.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Words that a worker keeps the ids of.
CACHE_WORDS = 400_000
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Odd(Exception):
    """More white space than single spaces between words."""


class Words(dict):
    """Ids of a run without white space as it stands behind a space (or not), as 32-bit integers in bytes."""

    def __init__(self, encoder: Encoder, before: str):
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Odd
        encoder = self.encoder
        if word.isalpha():
            ids = encoder.joined(encoder.piece((self.before + word).encode()))
        elif word[-1:] in ",." and word[:-1].isalpha():
            ids = self[word[:-1]] + encoder.marks[word[-1]]
        elif "\n" in word:
            head, _, tail = word.partition("\n")
            ids = encoder.whole(self.before + word) if not head or tail[:1].isspace() or not tail else self[head] + encoder.marks["\n"] + encoder.first[tail]
        else:
            ids = encoder.whole(self.before + word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """The ids of tokenizers' byte_bpe_50k.json, from the same vocabulary as ranks, with a memory for words.

    A space before a character that is none always begins a new piece, so the runs between single spaces can be encoded on their own.
    """

    def __init__(self, vocabulary_json: str, ranks: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary_json = vocabulary_json
        self.piece = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.spaced, self.first = Words(self, " "), Words(self, "")
        self.marks = {x: self.whole(x) for x in ",.\n"}

    def whole(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(text):
            ids += self.piece(piece.encode())
        return self.joined(ids)

    @staticmethod
    def joined(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def special(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        return np.array(Tokenizer.from_file(self.vocabulary_json).encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return self.special(text)
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))
        except Odd:
            return self.whole(text)


@lru_cache(1)
def encoder(vocabulary_json: str, ranks: str) -> Encoder:
    return Encoder(vocabulary_json, ranks)


def capacities(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Of the sequences that hold so many tokens: whole ones, then a power of two for each bit of the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece; all sequences are full."""
    pieces, rest, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((-(n % capacity), doc))
    heapq.heapify(rest)
    room = np.array(capacities(sum(-n for n, _ in rest), capacity), np.int64)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    while rest:
        n, doc = heapq.heappop(rest)
        n = -n
        fits = np.flatnonzero(room >= n)
        at = fits[np.argmin(cost[fits])] if len(fits) else int(np.argmax(room))
        taken = min(n, int(room[at]))
        start = lengths[doc] - n
        pieces.append((doc, start, taken, sequence + int(at), int(used[at])))
        room[at] -= taken
        used[at] += taken
        cost[at] += linear * taken + quadratic * taken * taken
        if taken < n:
            heapq.heappush(rest, (taken - n, doc))
    return pieces


def pack_documents(documents: DataFrame, vocabulary_json: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row for each piece of each row of documents(doc_id, text)."""
    vocabulary_json, ranks = vocabulary_json or vocabulary("byte_bpe_50k.json"), ranks or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary_json, ranks), np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        docs: list[tuple[int | None, bytes]] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal next_id, tokens
            lengths = [len(ids) // 4 for _, ids in docs]
            pieces = pack(lengths, capacity)
            filled: dict[int, int] = {}
            for p in pieces:
                filled[p[3]] = filled.get(p[3], 0) + p[2]
            rows = [(docs[d][0], start, n, zlib.crc32(docs[d][1][4 * start : 4 * (start + n)]), lengths[d], next_id + s, at, filled[s]) for d, start, n, s, at in pieces]
            next_id += len(filled)
            tokens = 0
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append((doc_id, encode(text.as_py() or "") + end))
                tokens += len(docs[-1][1]) // 4
                if tokens >= group_tokens:
                    yield packed()
        if docs:
            yield packed()

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    with_code(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

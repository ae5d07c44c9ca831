"""Sets of word n-grams of whole texts, as sorted 64-bit hashes, and their MinHash bands."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text that are hashed at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(4)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return _powers(_BASE, 1 << bits), _powers(pow(_BASE, -1, 1 << 64), 1 << bits)


def shingle_hashes(raw: np.ndarray, ends: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in text order, number in each text before the next) of texts that end at these places of the bytes.

    A text of 1 to n - 1 words has one hash, of all of them. Words are compared byte by byte.
    """
    white = _WHITE[raw]
    begins = ~white
    begins[1:] &= white[:-1]
    firsts = ends[:-1][ends[:-1] < len(raw)]
    begins[firsts] = ~white[firsts]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    stop = ~white
    stop[:-1] &= white[1:]
    lasts = ends - 1
    lasts = lasts[lasts >= 0]
    stop[lasts] = ~white[lasts]
    stop = np.flatnonzero(stop) + 1
    up, down = powers(max(8, int(len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    word = mixed((sums[stop] - sums[start]) * down[start])
    doc = np.searchsorted(ends, start, side="right")
    per_doc = np.bincount(doc, minlength=len(ends))
    factors = _powers(_BASE ^ 0x5555555555555554, n)
    many = len(word) - n + 1
    hashes = np.zeros(max(many, 0), np.uint64)
    for k in range(n if many > 0 else 0):
        hashes += word[k : k + many] * factors[k]
    inside = doc[: max(many, 0)] == doc[n - 1 :] if many > 0 else np.zeros(0, bool)
    hashes, owner = mixed(hashes[inside]), doc[: max(many, 0)][inside]
    counts = np.maximum(per_doc - n + 1, 0)
    short = np.flatnonzero((per_doc > 0) & (per_doc < n))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per_doc)])[short]
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = per_doc[short] > k
            extra[has] += word[first[has] + k] * factors[k]
        extra = mixed(extra + per_doc[short].astype(np.uint64))
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, counts = np.concatenate([hashes, extra])[order], counts + np.bincount(short, minlength=len(ends))
    return hashes, counts


def sets(texts: list[bytes], n: int = WORDS):
    """The sorted distinct hashes of each text."""
    at = 0
    while at < len(texts):
        size, last = 0, at
        while last < len(texts) and (last == at or size + len(texts[last]) <= CHUNK_BYTES):
            size += len(texts[last])
            last += 1
        raw = np.frombuffer(b"".join(texts[at:last]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[at:last]])
        hashes, counts = shingle_hashes(raw, ends, n)
        stop = np.cumsum(counts)
        for a, b in zip(stop - counts, stop, strict=True):
            yield np.unique(hashes[a:b])
        at = last


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def set_key(one: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for an empty one."""
    return blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None


def choose_bands(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows): rows of about 5 hashes, the fewest bands that find pairs at the threshold with the recall."""
    rows = max(1, round(log(1 / 3) / log(threshold)))
    return ceil(log(1 - recall) / log(1 - threshold**rows)), rows


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.factors = _powers(_BASE, rows)
        self.band = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, one: np.ndarray) -> np.ndarray:
        """A hash for each band; equal hashes of a band mean equal rows."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(one), 512):
            values = self.a[:, None] * one[None, at : at + 512]
            values += self.b[:, None]
            np.minimum(least, values.min(axis=1), out=least)
        rows = mixed(least).reshape(self.bands, self.rows)
        return mixed((rows * self.factors).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)

"""Repeated byte strings across a corpus: phrases between rolling-hash triggers, as in prefix-free parsing.

Every string of LENGTH bytes (a window) has a trigger: the least rolling hash of its GRAM-byte grams. So equal windows
have the same trigger hash wherever they stand. Neighbouring windows with the same trigger make a phrase: the bytes that
they cover. A phrase tells its windows apart by their content alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .shingles import mixed

LENGTH, GRAM = 100, 32
#: Grams in a window.
_GRAMS = LENGTH - GRAM + 1
#: A window holds HALF more bytes on the left or on the right of its trigger's gram, at least.
_HALF = (LENGTH - GRAM) // 2
#: Bytes that are hashed at once; longer texts are cut, with LENGTH - 1 bytes of overlap.
SLICE = 500_000
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@lru_cache(2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(2 * SLICE + LENGTH + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashes:
    """Hashes of any string of the bytes, equal for equal strings wherever they stand."""

    def __init__(self, raw: np.ndarray, base: int = _BASES[0]):
        self.up, self.down = _powers(base)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        """A hash of each n neighbouring bytes, mixed enough to be ordered by."""
        out = self.sums[n:] - self.sums[:-n]
        out *= self.down[: len(out)]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    size, out = 1, x
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (n - size)], out[n - size :]) if n > size else out


def slices(texts: list[bytes]):
    """(numbers of the texts, their first bytes, the bytes, ends) for batches of about SLICE bytes."""
    owners, firsts, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for first in range(0, max(1, len(text) - LENGTH + 1), SLICE):
            part = text[first : first + SLICE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > SLICE + LENGTH and parts:
                yield np.array(owners), np.array(firsts), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                owners, firsts, parts, size = [], [], [], 0
            owners.append(k)
            firsts.append(first)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(owners), np.array(firsts), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


#: Fields of a phrase: owner (number of the text), trigger, several (places of the trigger), content, start (of its first window), windows, at (of the
#: trigger's gram from the start), sides (32-bit hashes of the gram with HALF more bytes on the left and on the right; 0: no window has them).
FIELDS = {"owner": "int64", "trigger": "int64", "several": "int32", "content": "int64", "start": "int32", "windows": "int32", "at": "int32", "sides": "int64"}


def phrases(texts: list[bytes], only: int = len(FIELDS)):
    """The first fields of the phrases of each batch."""
    for owners, firsts, raw, ends in slices(texts):
        hashes = Hashes(raw)
        each = hashes.grams(GRAM)
        least = sliding_least(each, _GRAMS)
        starts = np.concatenate([[0], ends[:-1]])
        # Windows that end in the text in which they start.
        inside = np.zeros(len(least) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends - LENGTH + 1, -1)
        inside = np.cumsum(inside[:-1]) > 0
        fresh = np.ones(len(least), bool)
        fresh[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        fresh[starts] = True
        low = np.flatnonzero(fresh & inside)
        high = np.flatnonzero(inside & np.concatenate([(fresh | ~inside)[1:], [True]]))
        trigger = least[low]
        grams = np.lib.stride_tricks.sliding_window_view(each, _GRAMS)
        gram = low + (grams[low] == trigger[:, None]).argmax(axis=1)
        several = gram < high
        part = np.searchsorted(ends, low, side="right")
        found = [owners[part], trigger, several]
        if only > len(found):
            left = np.where(several | (gram - _HALF < low), np.uint64(0), hashes.of(np.maximum(gram - _HALF, 0), gram + GRAM) >> np.uint64(32))
            right = np.where(several | (gram - _HALF > high), np.uint64(0), hashes.of(gram, np.minimum(gram + GRAM + _HALF, len(raw))) >> np.uint64(32))
            content = mixed(hashes.of(low, high + LENGTH) + (high - low).astype(np.uint64))
            found += [content, low - starts[part] + firsts[part], high - low + 1, gram - low, left << np.uint64(32) | right]
        yield [x.view(np.int64) if x.dtype == np.uint64 else x.astype(kind) for x, kind in zip(found, FIELDS.values(), strict=False)]


def window_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of the bytes that starts at these sorted places."""
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, len(raw), SLICE):
        mine = at[np.searchsorted(at, first) : np.searchsorted(at, first + SLICE)] - first
        if len(mine):
            for found, base in zip(out, _BASES, strict=True):
                found.append(Hashes(raw[first : first + SLICE + LENGTH], base).of(mine, mine + LENGTH).view(np.int64))
    return np.concatenate(out[0]), np.concatenate(out[1])


def _ranked(x: np.ndarray) -> np.ndarray:
    """The rank of each number among the distinct ones."""
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def suffix_ranks(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at these places by their first LENGTH bytes: equal ones rank equal.

    Prefix doubling: ranks by 8 bytes, then by 16, 32 and 64, of all suffixes; the last step takes the 64 bytes at a
    place and those that end with its LENGTH bytes, which overlap. Ranks of suffixes that end before that are not used.
    """
    wide = np.zeros(len(raw) + 128, np.uint64)
    wide[: len(raw)] = raw
    word, size = np.zeros(len(raw), np.uint64), 8
    for k in range(size):
        word |= wide[k : k + len(raw)] << np.uint64(56 - 8 * k)
    rank = _ranked(word)
    while size * 2 <= LENGTH:
        both = rank << np.uint64(32)
        both[: len(raw) - size] |= rank[size:]
        if size * 4 > LENGTH:
            # The last ranks of all suffixes are only needed where windows ask for them.
            places = np.unique(np.concatenate([at, at + (LENGTH - 2 * size)]))
            rank = np.zeros(len(raw), np.uint64)
            rank[places] = _ranked(both[places])
        else:
            rank = _ranked(both)
        size *= 2
    return _ranked(rank[at] << np.uint64(32) | rank[at + (LENGTH - size)])


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places from each start, n of them."""
    if not len(start):
        return np.zeros(0, np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def doubtful(windows, at, flags) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the windows of phrases on the sides that are in doubt: flag 1 left of the trigger, 2 right of it, 3 both."""
    cut = np.clip(at - _HALF + 1, 0, windows)  # so many windows have HALF bytes or more on the left
    low = np.where(flags & 1, 0, cut)
    # Windows with exactly HALF on both sides count on either.
    high = np.where(flags & 2, windows, cut)
    low = np.where(flags == 2, np.clip(at - _HALF, 0, windows), low)
    return low, np.maximum(high, low)


def covered(size: int, repeated: np.ndarray) -> tuple[np.ndarray, int]:
    """(which bytes stand in the windows at these places, number of runs of them)."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    return gone, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())

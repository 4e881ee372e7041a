"""Content-defined segments of byte strings, so that equal windows meet under one key.

Every window of `length` bytes holds a least `gram`-byte string by a fixed hash (the leftmost
of equals): its anchor. Equal windows have equal anchors wherever they stand. Neighbouring
windows that share an anchor at one place form a segment, so a text of n bytes has about
2n / (length - gram) segments, and each window lies in exactly one of them.

Anchors may use a hash that is easy to compute over all places at once, since different strings
that share one only meet in vain. Whether two segments are equal is told by another one (xxh3),
so that texts made to collide under the first are still told apart.
"""

from __future__ import annotations

import numpy as np
import xxhash

from lodestar.llm.common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2**64, for i up to n."""
    if _tables["n"] < n:
        size = max(n, 2 * _tables["n"], 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("powers", BASE), ("inverses", inverse)):
            _tables[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base)]), dtype=np.uint64)
        _tables["n"] = size
    return _tables["powers"], _tables["inverses"]


class Hashes:
    """Hashes of substrings of one byte array, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        powers, self.inverses = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * powers[: len(data)], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Of all substrings of one width."""
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.inverses[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` numbers."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    if step < width:
        x = np.minimum(x[: len(x) - (width - step)], x[width - step :])
    return x


#: Positions share a number with the hash they go with; texts are read in pieces of this size.
PIECE_BITS = 22


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams the position of its least one, the leftmost of equals."""
    low = np.uint64((1 << PIECE_BITS) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_least(packed, width) & low).astype(np.int64)


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash, digest of the segment's bytes) of one text's segments.

    A segment of n windows from s on covers the bytes s to s + n - 1 + length. Texts are read
    in pieces, which bounds memory; a piece's end only cuts a segment in two.
    """
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    out = []
    piece = (1 << PIECE_BITS) - length
    for at in range(0, n, piece):
        size = min(n - at, piece)
        part = data[at : at + size + length - 1]
        grams = Hashes(part).every(gram)
        place = anchors(grams, length - gram + 1)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(first, size))
        anchor = mix64(grams[place[first]])
        end = first + count - 1 + length
        raw = part.tobytes()
        digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), end.tolist())), np.uint64, len(first))
        digest = mix64(digest + (place[first] - first).astype(np.uint64))
        out.append((at + first, count, anchor, digest))
    return tuple(np.concatenate(x) for x in zip(*out))

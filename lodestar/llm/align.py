"""Banded alignment of word sequences, many pairs at a time."""

from __future__ import annotations

import numpy as np

#: Cells of one band row over all pairs of a batch.
CELLS = 1 << 18


def sorted_bigrams(a: np.ndarray) -> np.ndarray:
    """A sequence's word pairs as hashes, sorted."""
    return np.sort(a[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ a[1:])


def shared_bigrams(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the multiset intersection of two sequences' sorted word pairs, or sorted words."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    if not len(both):
        return 0
    cuts = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    values, n = both[cuts], np.diff(np.append(cuts, len(both)))
    several = n > 1
    if not several.any():
        return 0
    values, n = values[several], n[several]
    in_x = np.searchsorted(x, values, "right") - np.searchsorted(x, values, "left")
    return int(np.minimum(in_x, n - in_x).sum())


def may_align(a: np.ndarray, b: np.ndarray, most: int, grams: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """False only if more than `most` edits are needed: lengths, shared word pairs and shared words are bounds.

    Word pairs are telling where edits are spread, words where they lie together.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    need = max(n, m) - 1 - 2 * most
    if need > 0 and shared_bigrams(*(grams or (sorted_bigrams(a), sorted_bigrams(b)))) < need:
        return False
    return max(n, m) <= most or shared_bigrams(np.sort(a), np.sort(b)) >= max(n, m) - most


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """The least edits of alignments within the band: exact where at most `width`."""
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, count = int(n.max()), len(pairs)
    left = np.zeros((count, rows), np.uint64)
    right = np.zeros((count, rows + 2 * width + 1), np.uint64)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        right[i, width : width + len(b)] = b[: rows + width + 1]
    steps = np.arange(2 * width + 1, dtype=np.int32)
    far = np.int32(1 << 28)
    # cell k of row i is column i + k - width
    line = np.where(steps >= width, steps - width, far)[None, :].repeat(count, 0).astype(np.int32)
    result = np.full(count, far, np.int32)
    end = m - n + width
    inside = (end >= 0) & (end <= 2 * width)
    done = inside & (n == 0)
    result[done] = line[done, end[done]]
    for i in range(1, rows + 1):
        other = line + (left[:, i - 1, None] != right[:, i - 1 : i + 2 * width])
        other[:, :-1] = np.minimum(other[:, :-1], line[:, 1:] + 1)
        if i <= width:
            other[:, : width - i] = far
            other[:, width - i] = i
        line = np.minimum.accumulate(other - steps, axis=1) + steps
        done = inside & (n == i)
        if done.any():
            result[done] = line[done, end[done]]
    return result


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], most: list[int], grams: list | None = None) -> list[bool]:
    """For each pair whether some alignment has at most `most` edits. grams: the pairs' sorted bigrams, if known.

    Sequences may be of any length, and empty: memory grows with the longest pair's length times
    the band's width. Two empty sequences align.

    An alignment within a band is an alignment, so a narrow band can already say yes; bands
    widen fourfold until they do, or are as wide as the bound, where they say no for certain.
    """
    out = [False] * len(pairs)
    todo = [i for i, (a, b) in enumerate(pairs) if may_align(a, b, most[i], grams and grams[i])]
    width = 4
    while todo:
        todo.sort(key=lambda i: len(pairs[i][0]))
        wider, at = [], 0
        while at < len(todo):
            stop = at + 1
            limit = max(1, CELLS // (2 * width + 1 + 8))
            while stop < len(todo) and stop - at < limit and len(pairs[todo[stop]][0]) <= 1.25 * len(pairs[todo[at]][0]) + 16:
                stop += 1
            group = todo[at:stop]
            for i, d in zip(group, _band([pairs[i] for i in group], width).tolist()):
                if d <= most[i]:
                    out[i] = True
                elif width < most[i]:
                    wider.append(i)
            at = stop
        todo, width = wider, 4 * width
    return out

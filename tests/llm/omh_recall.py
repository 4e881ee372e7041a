"""Prints the recall of Order MinHash candidates by words and similarity, as in the README."""

import numpy as np

from lodestar.llm import omh


def recall(n_words: int, similarity: float, pairs: int = 300, seed: int = 0) -> float:
    """The share of random pairs, one text with words replaced at random places, that agree in a sketch."""
    rng = np.random.default_rng([seed, n_words, int(similarity * 1000)])
    edits = int((1 - similarity) * n_words + 1e-9)
    met = 0
    for _ in range(pairs):
        a = rng.integers(0, 1 << 63, n_words, np.uint64)
        b = a.copy()
        b[rng.choice(n_words, edits, replace=False)] = rng.integers(0, 1 << 63, edits, np.uint64)
        met += bool(np.intersect1d(omh.sketches_of(a), omh.sketches_of(b)).size)
    return met / pairs


if __name__ == "__main__":
    print("words", 0.80, 0.85, 0.90, 0.95)
    for n in (6, 10, 20, 40, 100, 125, 126, 150, 300, 1000):
        print(n, *(f"{recall(n, s):.2f}" for s in (0.8, 0.85, 0.9, 0.95)))

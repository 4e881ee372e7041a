"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are sought inside long documents. Shingles are runs of five words. The items
are partitioned by size, each partition holding sizes from w/2 + 1 to w shingles, and documents
are read through overlapping windows of 2w shingles at steps of w, so that every place of an
item lies in one window of like size and the containment sought becomes a workable Jaccard
similarity. A window and an item are candidates if they agree in one of `hashes` minima.
Candidates are verified by exact containment: the share of the item's distinct shingles that
the document has, at least `threshold`.

The items are the stated query set. They go to every task in blocks of at most `block` items,
so what is broadcast at once has a fixed bound and more items mean more passes over the
documents, which are never shuffled.

Words are what lies between white space, in lower case. A document or item of fewer than five
words is one shingle of all its words.

Defined results: null or empty documents and items match nothing; repeated items each match;
repeated documents each have their rows; texts of any length are read whole; null ids are kept; an empty table on either side
gives an empty result; extra columns are left out (`without_items` keeps all, whatever their names).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lodestar.llm.common import WordHashes, bound_batches, by_place, fresh, input_columns, map_texts, mix64, shingle_hashes, slices

SCHEMA = "doc_id bigint, item_id bigint, n_shingles int, containment double"


def _seeds(n: int) -> np.ndarray:
    return (mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _folded(shingles: np.ndarray) -> np.ndarray:
    """32 bits of each shingle's hash: enough for random orders, as candidates are verified."""
    return (shingles >> np.uint64(32)).astype(np.uint32)


def _order(folded: np.ndarray, seed: np.uint32) -> np.ndarray:
    """One random order of shingles: a bijection of 32-bit numbers."""
    return (folded ^ seed) * (seed | np.uint32(1))


class Items:
    """A block of test items: distinct shingles and, by size partition, sorted minima."""

    def __init__(self, ids: list, texts: list[str], hashes: int, words: int) -> None:
        of = WordHashes()
        found = [(i, np.unique(shingle_hashes(of.of(t.lower().split()), words))) for i, t in zip(ids, texts)]
        found = [(i, s) for i, s in found if len(s)]
        self.ids = [i for i, _ in found]
        self.shingles = [s for _, s in found]
        self.partitions = {}
        widths = np.array([1 << max(0, int(len(s) - 1).bit_length()) for s in self.shingles], np.int64)
        seeds = _seeds(hashes)
        for w in np.unique(widths).tolist():
            members = np.flatnonzero(widths == w)
            minima = np.array([[_order(_folded(self.shingles[m]), s).min() for m in members] for s in seeds], np.uint32)
            order = np.argsort(minima, axis=1, kind="stable")
            self.partitions[w] = (np.take_along_axis(minima, order, 1), members[order])


def candidates(shingles: np.ndarray, starts: np.ndarray, items: Items, seeds: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) pairs of a batch: shingles of all documents, one after another."""
    found: set[tuple[int, int]] = set()
    sizes, folded = np.diff(starts), _folded(shingles)
    full = np.flatnonzero(sizes)
    windows = []
    for width, (minima, members) in items.partitions.items():
        # blocks of `width` shingles, none across documents; a window is two neighbouring blocks
        n_blocks = (sizes[full] + width - 1) // width
        owner = np.repeat(full, n_blocks)
        first = np.cumsum(n_blocks) - n_blocks
        block_at = starts[owner] + (np.arange(len(owner)) - np.repeat(first, n_blocks)) * width
        alone = np.append(owner[1:] != owner[:-1], True)
        windows.append((owner, block_at, alone, minima, members))
    for j, seed in enumerate(seeds):
        ordered = _order(folded, seed)
        for owner, block_at, alone, minima, members in windows:
            low = np.minimum.reduceat(ordered, block_at)
            low = np.where(alone, low, np.minimum(low, np.append(low[1:], low[-1:])))
            left = np.searchsorted(minima[j], low, "left")
            hit = np.flatnonzero(minima[j][np.minimum(left, members.shape[1] - 1)] == low)
            if len(hit):
                right = np.searchsorted(minima[j], low[hit], "right")
                for d, a, b in zip(owner[hit].tolist(), left[hit].tolist(), right.tolist()):
                    found.update((d, m) for m in members[j, a:b].tolist())
    return found


def _matcher(items: Items, threshold: float, hashes: int, words: int):
    """A function from texts to (text's index, item's index, containment), verified."""

    def make():
        of, seeds = WordHashes(), _seeds(hashes)

        def match(texts: list[str]) -> list[tuple[int, int, float]]:
            per_doc = [shingle_hashes(of.of(t.lower().split()), words) for t in texts]
            starts = np.cumsum([0, *map(len, per_doc)])
            if not starts[-1] or not items.ids:
                return []
            found, distinct = [], {}
            for d, m in sorted(candidates(np.concatenate(per_doc), starts, items, seeds)):
                if d not in distinct:
                    distinct[d] = np.unique(per_doc[d])
                own, item = distinct[d], items.shingles[m]
                at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                share = float((own[at] == item).mean())
                if share >= threshold:
                    found.append((d, m, share))
            return found

        return match

    return make


def contained(docs: DataFrame, items: Items, threshold: float, hashes: int, words: int) -> DataFrame:
    """(doc_id, item_id) of one block of items, verified."""
    matcher = _matcher(items, threshold, hashes, words)

    def make():
        match = matcher()

        def call(batch, texts):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], items.ids[m], len(items.shingles[m]), share) for d, m, share in match(texts)]
            return dict(zip(("doc_id", "item_id", "n_shingles", "containment"), list(zip(*rows)) or [[], [], [], []]))

        return call

    return map_texts(docs, "text", None, SCHEMA, make=make)


def _flagged(docs: DataFrame, text_col: str, flag: str, items: Items, threshold: float, hashes: int, words: int) -> DataFrame:
    """docs with a column that tells whether the row's text holds an item."""
    bound_batches(docs.sparkSession)
    matcher = _matcher(items, threshold, hashes, words)
    placed, (text,) = by_place(docs, text_col)

    def run(batches):
        match = matcher()
        for whole in batches:
            for part in slices(whole, text):
                has = np.zeros(part.num_rows, bool)
                has[[d for d, _, _ in match([t or "" for t in part.column(text).to_pylist()])]] = True
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(has)], names=[*part.schema.names, "has"])

    return placed.mapInArrow(run, StructType([*placed.schema.fields, StructField("has", BooleanType())])).toDF(*docs.columns, flag)


def _item_blocks(benchmark: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8,
                 hashes: int = 48, words: int = 5, block: int = 20_000, block_bytes: int = 8 << 20):
    """The items in blocks of about `block` items and `block_bytes` of text, dealt by a hash, each with the search's options."""
    known = benchmark.select(F.col(item_id_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))
    n, n_bytes = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    n_blocks = max(1, -(-n // block), -(-n_bytes // block_bytes))
    for k in range(n_blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).toArrow()
        texts = [t or "" for t in rows.column("text").to_pylist()]
        yield Items(rows.column("item_id").to_pylist(), texts, hashes, words), (threshold, hashes, words)


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, containment) with containment >= threshold."""
    texts = input_columns(docs, id_col, text_col)
    return functools.reduce(DataFrame.unionAll, (contained(texts, items, *how) for items, how in _item_blocks(benchmark, **options)))


def without_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold an item; all columns stay.

    A row goes by its own text: ids may be null or shared. The search is run where the texts
    are read, so that nothing is joined or shuffled.
    """
    (flag,) = fresh(docs, "has_item")
    out = docs
    for items, (threshold, hashes, words) in _item_blocks(benchmark, **options):
        out = _flagged(out, text_col, flag, items, threshold, hashes, words).where(~F.col(flag)).drop(flag)
    return out

"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is fitted in numpy on confirmed toxic texts (positives)
and unlabelled texts. With class prior p and logistic loss l, the risk is

    p * E_pos[l(+g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

and where the bracket falls below zero its gradient is reversed, which keeps a flexible model
from driving the estimated negative risk below zero. The prior is the share of toxic rows
among the labelled ones of the training folds.

Fitting uses a bounded sample: at most `max_positive` toxic labelled rows and about
`max_unlabelled` other rows, both picked by a hash of the id, and of each no more than have `max_words`
distinct words in all, so that what reaches the driver is bounded in bytes. All else covers every row:
each whole text is scored where it is read, without a shuffle.

Labels are learned only from rows with crc32(id as text) mod 5 other than 0. Scores depend on
the text alone.

Defined results: a null or empty text is scored like one without any known word; texts of any
length are scored whole; rows are
kept one for one; null ids count as the text "" for the fold; a document with several label
rows is toxic if one of them says so; without any positive every score is 0; an empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestar.llm.common import WordHashes, bound_batches, by_place, input_columns, map_texts, slices

WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Weights over 2**bits hashed words, and an intercept."""

    weights: np.ndarray
    bias: float
    prior: float

    @property
    def mask(self) -> int:
        return len(self.weights) - 1


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _features(mask: int):
    """A batch function: the sorted distinct word buckets of each text."""

    def make():
        hashes = WordHashes()

        def call(batch, texts):
            found = [np.unique(hashes.of(list(set(WORD.findall(t.lower())))) & np.uint64(mask)).astype(np.int32) for t in texts]
            return {"doc_id": batch.column("doc_id"), "words": found}

        return call

    return make


def risk(g_pos: np.ndarray, g_unl: np.ndarray, prior: float) -> tuple[float, float]:
    """(p E_pos[l(+g)], the bracket that estimates the risk of the negatives) of scores g."""
    bracket = np.logaddexp(0, g_unl).sum() / max(1, len(g_unl)) - prior * np.logaddexp(0, g_pos).sum() / len(g_pos)
    return prior * np.logaddexp(0, -g_pos).sum() / len(g_pos), bracket


def slopes(g_pos: np.ndarray, g_unl: np.ndarray, prior: float) -> np.ndarray:
    """The gradient by each score: of the risk, or of the reversed bracket where that is below zero."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    s_pos, s_unl, n = sig(g_pos), sig(g_unl), max(1, len(g_unl))
    if risk(g_pos, g_unl, prior)[1] >= 0:
        return np.concatenate([prior * (s_pos - 1) / len(g_pos) - prior * s_pos / len(g_pos), s_unl / n])
    return np.concatenate([prior * s_pos / len(g_pos), -s_unl / n])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int, steps: int = 250,
        rate: float = 0.05, decay: float = 1e-4, least: int = 5, apart: float = 4.0) -> Model:
    """Minimise the non-negative risk by full-batch Adam.

    Words in fewer than `least` texts are left out, as are words whose share of the positives
    is within `apart` standard errors of their share of the unlabelled texts: with far more
    words than positives, the rest could only fit noise.
    """
    size = 1 << bits
    rows = positive + unlabelled
    if not positive:
        return Model(np.zeros(size, np.float32), -50.0, prior)
    ids = np.concatenate([*rows, np.zeros(0, np.int32)])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    in_pos = np.bincount(ids[owner < len(positive)], minlength=size)
    in_all = np.bincount(ids, minlength=size)
    n_pos, n_unl = len(positive), max(1, len(unlabelled))
    usual = (in_all + 1) / (len(rows) + 2)
    error = np.sqrt(usual * (1 - usual) * (1 / n_pos + 1 / n_unl))
    used = (in_all >= least) & (np.abs(in_pos / n_pos - (in_all - in_pos) / n_unl) >= apart * error)
    dense = np.cumsum(used) - 1
    keep = used[ids]
    ids, owner = dense[ids[keep]], owner[keep]
    k = int(used.sum())
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, steps + 1):
        g = b + np.bincount(owner, w[ids], minlength=len(rows))
        grad = slopes(g[:n_pos], g[n_pos:], prior)
        gw = np.bincount(ids, grad[owner], minlength=k)[:k] + decay * w
        gb = grad.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-10)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, b, prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          bits: int = 18, max_positive: int = 4000, max_unlabelled: int = 12000, max_words: int = 8 << 20) -> Model:
    """Fit on the bounded sample; only its word buckets, not its texts, come to the driver."""
    marked = (
        labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    prior = min(0.95, max(0.005, toxic / n)) if n else 0.05
    positives = marked.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).select("doc_id")
    texts = input_columns(docs, id_col, text_col).where(~is_held_out(F.col("doc_id")))
    share = min(1.0, max_unlabelled / max(1, docs.count()))
    scale = 1 << 30
    unlabelled = texts.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("unlabelled")), F.lit(scale)) < int(share * scale))
    # at most max_positive ids: a bound that doesn't grow with the input
    positive = texts.join(F.broadcast(positives), "doc_id")
    mask = (1 << bits) - 1
    rows = [
        _arrays(part.toArrow().column("words").combine_chunks())
        for part in (_bounded(positive, mask, 2 * max_positive, max_words), _bounded(unlabelled, mask, 2 * max_unlabelled, max_words))
    ]
    return fit(rows[0], rows[1], prior, bits)


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as views of one array."""
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return np.split(values[ends[0] : ends[-1]], ends[1:-1] - ends[0]) if len(lists) else []


def _bounded(texts: DataFrame, mask: int, most: int, max_words: int) -> DataFrame:
    """Word buckets of the sampled texts, in hash order of the ids; repeated rows can't exceed the bounds."""
    found = map_texts(texts, "text", None, "doc_id bigint, words array<int>", make=_features(mask))
    packed = found.select("doc_id", "words").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # a window over at most `most` rows; the first row always stays
    upto = F.sum(F.size("words")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "words").rowsBetween(Window.unboundedPreceding, -1))
    return packed.withColumn("upto", F.coalesce(upto, F.lit(0))).where((F.col("upto") == 0) | (F.col("upto") + F.size("words") <= max_words)).select("words")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    return with_scores(input_columns(docs, id_col, text_col), model).select("doc_id", "score")


def _scorer(model: Model):
    weights, bias, mask = model.weights, model.bias, model.mask

    class Weights(dict):
        def __init__(self):
            self.hashes = WordHashes()

        def __missing__(self, word):
            if len(self) >= 400_000:
                self.clear()
            w = self[word] = float(weights[self.hashes[word] & mask])
            return w

    def make():
        known = Weights()

        def call(texts):
            # sorted: the same text has the same score to the last bit
            z = np.array([sum(map(known.__getitem__, sorted(set(WORD.findall(t.lower()))))) for t in texts], np.float64) + bias
            return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

        return call

    return make


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column; for stages that go on with all columns (a clashing one is replaced)."""
    bound_batches(docs.sparkSession)
    base = docs.drop(score_col)
    placed, (text,) = by_place(base, text_col)
    schema = StructType([*placed.schema.fields, StructField("score", DoubleType())])
    make = _scorer(model)

    def run(batches):
        call = make()
        for whole in batches:
            for part in slices(whole, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(call(texts))], names=[*part.schema.names, "score"])

    return placed.mapInArrow(run, schema).toDF(*base.columns, score_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

"""Run-length index: exact removal of long repeats.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else. The
corpus is never sorted as a whole. Instead:

1. Texts are cut into segments by content (see segments.py), so that equal windows of `length`
   bytes have equal anchors. Per anchor an aggregate tells whether it occurs once (no window of
   the segment repeats), always in equal segments (every window repeats), or in different ones.
2. Of segments with a contested anchor, the distinct ones meet in blocks of bounded size. A
   block gets a run-length index: the Burrows-Wheeler transform of its segments, kept by runs,
   with text positions and common prefix lengths sampled at the runs' ends. Matching statistics
   (the longest match elsewhere of each suffix) are streamed from the samples alone: inside a
   run, what stands before a suffix also stands before its neighbour, so the statistic is the
   previous position's less one; only at run ends is it looked up. Windows whose statistic is
   at least `length` repeat. In repetitive text, runs and so samples are few.
3. Segments of an anchor that more than `most` different ones share are cut again by longer
   grams, up to whole windows, which set them apart without gathering them.
4. Marks are joined to the texts and the bytes removed.

Two equal strings of bytes always get equal keys. Different ones are taken for equal only if they
share an anchor and a segment's xxh3 digest (64 bits), by chance; strings made to share an anchor
still differ in their digests.

Defined results: a null or empty text has 0 bytes; a text shorter than `length` loses nothing;
rows with the same text of `length` bytes or more lose all of it; rows are kept one for one
(null ids too); texts of any length are cut whole; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import DataFrameSchema, SharedTables, map_texts, text_digest
from lodestar.llm.segments import segments

# --- the index of a block ------------------------------------------------------------------


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of some byte strings.

    Strings are set apart by a separator below all bytes. Suffixes are sorted by prefix ranks
    whose length grows threefold (twofold in large blocks) up to the longest string.
    """

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.text = np.zeros(int((sizes + 1).sum()), np.int16)
        inside = np.ones(len(self.text), bool)
        inside[self.starts + sizes] = False
        self.text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
        self.room = (np.repeat(self.starts + sizes, sizes + 1) - np.arange(len(self.text))).astype(np.int32)
        self._sort(int(sizes.max(initial=0)) + 1)
        self._sample()

    def _sort(self, longest: int) -> None:
        n = len(self.text)
        key = np.zeros(n, np.int64)
        for k in range(7):  # seven symbols of nine bits
            key = (key << 9) | self._shifted(self.text, k)
        width, self.ranks = 7, []
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.append(1, ordered[1:] != ordered[:-1]), dtype=np.int32)
            self.ranks.append((width, rank))
            del ordered, key
            if width >= longest or rank[order[-1]] == n:
                break
            bits = int(n).bit_length()
            joined = max(2, 63 // bits)
            joined = min(joined, 3)
            key = rank.astype(np.int64)
            for k in range(1, joined):
                key = (key << bits) | self._shifted(rank, k * width)
            width *= joined
        self.suffixes = order

    @staticmethod
    def _shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by < len(x):
            out[: len(x) - by] = x[by:]
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes at a and b, within their strings."""
        n, total = len(self.text), np.zeros(len(a), np.int64)
        for width, rank in [*reversed(self.ranks), (1, self.text)]:
            going = np.arange(len(a))
            while len(going):
                x, y = a[going] + total[going], b[going] + total[going]
                within = (x < n) & (y < n)
                going, x, y = going[within], x[within], y[within]
                same = rank[x] == rank[y]
                if width == 1:
                    same &= self.text[x] > 0
                going = going[same]
                total[going] += width
                # past the end of a string nothing more can count
                going = going[total[going] < np.minimum(self.room[a[going]], self.room[b[going]])]
        return np.minimum(total, np.minimum(self.room[a], self.room[b]))

    def _sample(self) -> None:
        sa = self.suffixes
        before = self.text[sa - 1]
        before[sa == 0] = 0
        # runs of the transform; a string's start has nothing before it and ends every run
        self.heads = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
        self.n_runs = len(self.heads) + 1
        head, tail = sa[self.heads], sa[self.heads - 1]
        common = self._common(tail, head)
        self.sampled = np.full(len(self.text), -1, np.int32)
        np.maximum.at(self.sampled, head, common.astype(np.int32))
        np.maximum.at(self.sampled, tail, common.astype(np.int32))

    def matching_statistics(self) -> np.ndarray:
        """Per text position the length of the longest match that starts elsewhere."""
        at = np.arange(len(self.text))
        reach = np.where(self.sampled >= 0, self.sampled + at, -1)
        return np.maximum(np.maximum.accumulate(reach) - at, 0)


# --- steps over tables ---------------------------------------------------------------------

_SEGMENTS = "node binary, anchor bigint, digest bigint, first int, windows int"


def _segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """All segments of all texts. A text met a third time in a task adds nothing new."""

    def make():
        met: dict[bytes, int] = {}

        def call(batch, rows):
            columns, owner = [[], [], [], []], []
            for i, (node, text) in enumerate(zip(batch.column("node").to_pylist(), rows)):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) < length or (seen := met.get(node, 0)) >= 2:
                    continue
                if seen or len(met) < 1_000_000:
                    met[node] = seen + 1
                first, windows, anchor, digest = segments(data, length, gram)
                owner.append(np.full(len(first), i))
                for to, x in zip(columns, (anchor.view(np.int64), digest.view(np.int64), first, windows)):
                    to.append(x)
            found = dict(zip(("anchor", "digest", "first", "windows"), (np.concatenate([*c, np.zeros(0, np.int64)]) for c in columns)))
            return found | {"node": batch.column("node").take(pa.array(np.concatenate([*owner, np.zeros(0, np.int64)])))}

        return call

    return map_texts(texts.select("node", "text"), "text", None, _SEGMENTS, make=make)


def _end(first: str, windows: str, length: int):
    return (F.col(first) + F.col(windows) + F.lit(length - 1)).alias("stop")


_MARKS = "node binary, start int, stop int"


def _indexed_marks(length: int):
    """A group function: repeats among a block's segments, as byte intervals of their texts."""
    schema = DataFrameSchema(_MARKS)

    def run(table):
        rows = table.to_pandas()
        # a segment that two rows delivered counts once
        rows = rows.drop_duplicates(["anchor", "digest"])
        index = RunLengthIndex(rows["bytes"].tolist())
        repeats = index.matching_statistics() >= length
        out = [[], [], []]
        for node, first, n, count, at in zip(rows["node"], rows["first"], rows["windows"], rows["n"], index.starts.tolist()):
            if count > 1:
                continue  # marked as a whole already
            hit = np.flatnonzero(np.diff(np.concatenate([[False], repeats[at : at + n], [False]]).astype(np.int8)))
            for a, b in zip(hit[::2].tolist(), hit[1::2].tolist()):
                for to, x in zip(out, (node, int(first + a), int(first + b - 1 + length))):
                    to.append(x)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema.arrow())], schema=schema.arrow())

    return run


_PIECES = "anchor bigint, digest bigint, n bigint, node binary, first int, windows int, bytes binary"


def _recut(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of segments, by anchors of a longer gram. rows: n, node, first, bytes."""

    def call(batch, _):
        out = {k: [] for k in ("anchor", "digest", "n", "node", "first", "windows", "bytes")}
        for row in batch.to_pylist():
            first, windows, anchor, digest = segments(np.frombuffer(row["bytes"], np.uint8), length, gram)
            out["anchor"] += anchor.view(np.int64).tolist()
            out["digest"] += digest.view(np.int64).tolist()
            out["first"] += (row["first"] + first).tolist()
            out["windows"] += windows.tolist()
            out["bytes"] += [row["bytes"][a : a + w - 1 + length] for a, w in zip(first.tolist(), windows.tolist())]
            out["n"] += [row["n"]] * len(first)
            out["node"] += [row["node"]] * len(first)
        return out

    return map_texts(rows.select("n", "node", "first", "bytes"), None, call, _PIECES)


def _crowded_marks(rows: DataFrame, tables: SharedTables, length: int) -> DataFrame:
    """Repeats among the segments of anchors that too many different segments share.

    They are cut again by longer and longer grams. A gram that reaches beyond what the segments
    share sets them apart, so each round leaves a fraction; the last gram is a whole window,
    where equal anchors mean equal windows. rows: n (over 1: marked already), node, first, bytes.
    """
    marks = None
    for level, gram in enumerate((length * 16 // 25, length * 22 // 25, length)):
        cut = tables.write(_recut(rows, length, gram), f"crowd-{level}")
        anchors = cut.groupBy("anchor").agg(F.count("*").alias("of"), (F.min("digest") == F.max("digest")).alias("uniform"))
        met = tables.write(cut.join(tables.write(anchors.where("of > 1").select("anchor", "uniform"), f"crowd-anchors-{level}"), "anchor"), f"crowd-met-{level}")
        kinds = met.where("not uniform").groupBy("anchor", "digest")
        kinds = tables.write(kinds.agg(F.count("*").alias("of"), F.min(F.struct("node", "first")).alias("one")), f"crowd-kinds-{level}")
        known = met.join(kinds, ["anchor", "digest"], "left")
        whole = known.where("n = 1 and (uniform or of > 1)").select("node", F.col("first").alias("start"), _end("first", "windows", length))
        marks = whole if marks is None else marks.unionAll(whole)
        # of equal segments one goes on, to bear witness for others; it is marked already
        on = known.where("not uniform and one.node = node and one.first = first")
        rows = on.select(F.when(F.col("of") > 1, F.greatest("n", F.lit(2))).otherwise(F.col("n")).alias("n"), "node", "first", "bytes")
    return marks


def repeated_marks(texts: DataFrame, tables: SharedTables, length: int, gram: int, block: int, most: int) -> DataFrame:
    """node, start, stop: byte intervals that repeat. texts: doc_id, node, text."""
    found = _segments(texts, length, gram)
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("digest") == F.max("digest")).alias("uniform"))
    anchors = tables.write(anchors.where("n > 1").select("anchor", "uniform"), "anchors")
    met = tables.write(found.join(anchors, "anchor"), "met")
    whole = met.where("uniform").select("node", F.col("first").alias("start"), _end("first", "windows", length))
    contested = met.where("not uniform")
    place = F.min(F.struct("node", "first", "windows")).alias("place")
    distinct = contested.groupBy("anchor", "digest").agg(F.count("*").alias("n"), place)
    distinct = tables.write(distinct.select("anchor", "digest", "n", "place.*"), "distinct")
    # a table of its own has its true size: small, it is sent to the rows, and a digest that very many
    # rows share isn't dealt out by key; large, Spark splits such a key when it joins
    often = tables.write(distinct.where("n > 1").select("anchor", "digest"), "often")
    copied = contested.join(often, ["anchor", "digest"], "left_semi").select("node", F.col("first").alias("start"), _end("first", "windows", length))
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("different")).where(F.col("different") > most).select("anchor")
    crowded = tables.write(crowded, "crowded")
    n_bytes = distinct.agg(F.coalesce(F.sum(F.col("windows") + length), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_bytes // block))
    # each distinct segment's bytes, from one row with its text
    owner = texts.groupBy("node").agg(F.min("doc_id").alias("owner"))
    asked = distinct.join(crowded.withColumn("crowd", F.lit(True)), "anchor", "left")
    asked = asked.groupBy("node").agg(
        F.collect_list(F.struct("anchor", "digest", "n", "first", "windows", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("asked")
    )
    asked = tables.write(asked.join(owner, "node").withColumnRenamed("node", "asked_node"), "asked")
    # the row of least id, said as a range: then this join and the last one deal out texts alike,
    # by the node alone, and Spark shuffles them once for both
    last = F.lit((1 << 63) - 1)
    on = (F.col("node") == F.col("asked_node")) & (F.coalesce("doc_id", last) <= F.coalesce("owner", last))
    cut = _cut_bytes(texts.join(asked, on).select("node", "text", "asked"), length)
    quiet = cut.where("not crowd").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int"))
    indexed = quiet.groupBy("block").applyInArrow(_indexed_marks(length), _MARKS)
    marks = whole.unionAll(copied).unionAll(indexed)
    if not crowded.isEmpty():
        marks = marks.unionAll(_crowded_marks(cut.where("crowd").dropDuplicates(["anchor", "digest"]), tables, length))
    return marks


def _cut_bytes(rows: DataFrame, length: int) -> DataFrame:
    def call(batch, texts):
        out = {k: [] for k in ("anchor", "digest", "n", "node", "first", "windows", "crowd", "bytes")}
        for node, text, asked in zip(batch.column("node").to_pylist(), texts, batch.column("asked").to_pylist()):
            data = text.encode()
            for a in asked:
                for k in ("anchor", "digest", "n", "first", "windows", "crowd"):
                    out[k].append(a[k])
                out["node"].append(node)
                out["bytes"].append(data[a["first"] : a["first"] + a["windows"] - 1 + length])
        return out

    schema = "anchor bigint, digest bigint, n bigint, node binary, first int, windows int, crowd boolean, bytes binary"
    return map_texts(rows, "text", call, schema)


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32,
                   block: int = 1 << 19, most: int = 16_384, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    tables = SharedTables(docs.sparkSession, "rlindex")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.select("doc_id", text_digest(F.col("text")).alias("node"), "text")
    marks = repeated_marks(texts, tables, length, gram, block, most)
    per_text = marks.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    # a key of its own makes Spark deal out the marks again, which lets it split a node that a
    # third of all rows share; the aggregate's own partitioning would forbid that
    per_text = per_text.select(F.concat("node", F.lit(b"")).alias("marked"), "marks")
    joined = texts.join(per_text, F.col("node") == F.col("marked"), "left").select("doc_id", "text", "marks")

    def call(batch, rows):
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        out["doc_id"] = batch.column("doc_id")
        for text, found in zip(rows, batch.column("marks").to_pylist()):
            kept = data = text.encode()
            spans = 0
            if found:
                edges = np.zeros(len(data) + 1, np.int32)
                np.add.at(edges, [m["start"] for m in found], 1)
                np.add.at(edges, [m["stop"] for m in found], -1)
                gone = np.cumsum(edges[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_kept else None)
        return out

    done = map_texts(joined, "text", call, _RESULT)
    return done if with_kept else done.drop("kept")

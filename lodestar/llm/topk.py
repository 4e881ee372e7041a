"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are held in blocks. A block has, for each dimension, its vectors in the order of that
component; the lists are sorted once, when the block is made. A query walks the lists of its
non-zero dimensions from the end that its sign prefers. Each round goes on in those lists where
the query's component times the list's value drops most, a little farther each time; vectors
met for the first time are scored in full. What no list has shown yet scores at most the sum,
over the dimensions, of the query's component times the list's value where the walk stands. The
walk stops when that bound is below the kth best score, or when the lists hold nothing unmet.
Ties keep it going, since a smaller id could still come. There is no other way to a result.

Queries are a stated set; they are packed into blocks, and each pair of a query block and a
vector block is one task's row. Each query block first walks one vector block; the kth scores
found there are real scores, so they go with the queries as their bounds to all other blocks.
What comes out is at most k rows per query and block, of which each query's best k are kept.

Defined results: null vectors, vectors with null or non-finite components and null ids take no
part; rows with the query's own id are never its candidates; repeated other rows count each;
queries meet only vectors of their own dimension; with fewer candidates than k all are
returned; vectors without components score 0; an empty table gives an empty result; extra
columns are left out. Vectors may be of any length: blocks are bounded in bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import DataFrameSchema, SharedTables, map_texts


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and its components floor(scale * x), for vectors that are whole and finite."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"),
    )


_PACKED = "block int, dim int, ids binary, matrix binary, lists binary"


def _packed(vectors: DataFrame, n_blocks: int, with_lists: bool) -> DataFrame:
    """Vectors dealt into blocks by a hash; a block's ids, matrix and sorted lists are one row per dimension."""
    schema = DataFrameSchema(_PACKED)

    def pack(key, table):
        block, dim = (k.as_py() for k in key)
        ids = table.column("vec_id").to_numpy()
        matrix = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        matrix = np.ascontiguousarray(matrix[order])
        row = [block, dim, ids[order].tobytes(), matrix.tobytes(), sorted_lists(matrix).tobytes() if with_lists else None]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema.arrow())], schema=schema.arrow())

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int")).withColumn("dim", F.size("v"))
    return dealt.groupBy("block", "dim").applyInArrow(pack, _PACKED)


def sorted_lists(matrix: np.ndarray) -> np.ndarray:
    """Per dimension the rows in ascending order of that component."""
    return np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32))


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """float64 products (fast) where all sums stay below 2**53, else int64."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float64 if bound < 2.0**53 else np.int64


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of rows in id order, ties to the earlier row."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        equal = np.flatnonzero(scores == kth)[: k - len(above)]
        keep = np.concatenate([above, equal])
        scores, rows = scores[keep], rows[keep]
    order = np.lexsort((rows, -scores))
    return scores[order], rows[order]


#: Lists that a round goes on in, and the entries it reads of each at first.
AT_ONCE, FIRST = 8, 16
#: Stands for the kth score of fewer than k.
LEAST = -(1 << 63)


def walk(q: np.ndarray, v: np.ndarray, lists: np.ndarray, unmet: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, rows, entries read) of one query's walk; rows that aren't `unmet` are no candidates.

    floor: a score that k vectors of other blocks are known to reach; what is below it may be left out.
    """
    n, dim = v.shape
    scores, rows = np.zeros(0, v.dtype), np.zeros(0, np.int64)
    used = np.flatnonzero(q)
    left, read = int(unmet.sum()), 0
    if not len(used):  # every vector scores 0; lists of zero weight tell nothing apart
        rows = np.flatnonzero(unmet)[:k]
        return np.zeros(len(rows), v.dtype), rows, 0
    weight, up = q[used], q[used] > 0
    at, step = np.zeros(len(used), np.int64), FIRST
    row_at = lambda i, depth: lists[used[i], np.where(up[i], n - 1 - depth, depth)]
    every = np.arange(len(used))
    now = weight * v[row_at(every, at), used]
    while left:
        bar = max(floor, int(scores[-1])) if len(scores) == k else floor
        if now.sum() < bar:
            break
        ahead = np.minimum(at + step, n - 1)
        drop = now - weight * v[row_at(every, ahead), used]
        drop[at >= n - 1] = -1
        some = np.argpartition(drop, -AT_ONCE)[-AT_ONCE:] if len(drop) > AT_ONCE else every
        parts = [lists[used[i], n - 1 - ahead[i] : n - at[i]] if up[i] else lists[used[i], at[i] : ahead[i] + 1] for i in some.tolist()]
        found = np.concatenate(parts)
        read += len(found)
        at[some] = ahead[some]
        now[some] = weight[some] * v[row_at(some, at[some]), used[some]]
        new = np.unique(found[unmet[found]])
        if len(new):
            unmet[new] = False
            left -= len(new)
            scores, rows = _best(np.concatenate([scores, v[new] @ q]), np.concatenate([rows, new]), k)
        step += step >> 1
    return scores, rows, read


def threshold_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int,
                     lists: np.ndarray | None = None, floors: np.ndarray | None = None) -> list[tuple]:
    """(query's place, rows, scores, entries read, rows met): each query's k best of a block. ids ascend."""
    kind = _exact(queries, matrix)
    q, v = queries.astype(kind), np.ascontiguousarray(matrix.astype(kind))
    lists = sorted_lists(matrix) if lists is None else lists
    out = []
    for i in range(len(q)):
        unmet = ids != query_ids[i]
        n = int(unmet.sum())
        scores, rows, read = walk(q[i], v, lists, unmet, k, LEAST if floors is None else int(floors[i]))
        out.append((i, rows, scores, read, n - int(unmet.sum())))
    return out


#: Bytes of the vectors of a block, and of a query block.
BLOCK_BYTES, QUERY_BYTES = 4 << 20, 1 << 19

_FOUND = "query_block int, dim int, query_id array<bigint>, vec_id array<bigint>, score array<bigint>, kth binary, read bigint, walks bigint, stopped bigint"


def _walked(met: DataFrame, k: int) -> DataFrame:
    """One row per pair of a query block and a block: what was found, each query's kth score, and the work done."""

    def search(batch, _):
        out = {name.split()[0]: [] for name in _FOUND.split(", ")}
        for row in batch.to_pylist():
            dim = row["dim"]
            of = lambda name: np.frombuffer(row[name], np.int64)  # noqa: B023, E731
            query_ids, ids = of("query_ids"), of("ids")
            floors = np.frombuffer(row["kth"], np.int64) if row["kth"] else None
            lists = np.frombuffer(row["lists"], np.int32).reshape(dim, len(ids))
            queries, matrix = of("queries").reshape(len(query_ids), dim), of("matrix").reshape(len(ids), dim)
            found = threshold_search(query_ids, queries, ids, matrix, k, lists, floors)
            kth = np.array([int(s[-1]) if len(s) == k else LEAST for _, _, s, _, _ in found], np.int64)
            values = {
                "query_block": row["query_block"], "dim": dim, "kth": kth.tobytes(), "walks": len(found),
                "query_id": np.concatenate([np.full(len(r), query_ids[i]) for i, r, *_ in found] or [[]]).astype(np.int64),
                "vec_id": np.concatenate([ids[r] for _, r, *_ in found] or [[]]).astype(np.int64),
                "score": np.concatenate([s for _, _, s, _, _ in found] or [[]]).astype(np.int64),
                "read": sum(r for *_, r, _ in found), "stopped": sum(m < len(ids) - int((ids == query_ids[i]).sum()) for i, *_, m in found),
            }
            for name, x in values.items():
                out[name].append(x)
        return out

    return map_texts(met, None, search, _FOUND)


def walks(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """What all walks found and the work they did, one row per pair of a query block and a vector block."""
    tables = SharedTables(vectors.sparkSession, "topk")
    whole = tables.write(quantised(vectors, id_col, vector_col), "vectors")
    asked = whole.where(is_query)
    n_bytes = F.coalesce(F.sum(8 * F.size("v").cast("bigint")), F.lit(0))
    n_blocks, n_query_blocks = (int(x.agg(n_bytes).first()[0]) // most + 1 for x, most in ((whole, block_bytes), (asked, query_bytes)))
    packed = tables.write(_packed(whole, n_blocks, True), "blocks")
    queries = tables.write(
        _packed(asked, n_query_blocks, False).select(F.col("block").alias("query_block"), "dim", F.col("ids").alias("query_ids"), F.col("matrix").alias("queries")),
        "queries",
    )
    tables.drop("vectors")
    first = F.pmod(F.col("query_block"), F.lit(n_blocks)).alias("block")
    before = tables.write(_walked(queries.select("*", first, F.lit(None).cast("binary").alias("kth")).join(packed, ["block", "dim"]), k), "first")
    if n_blocks == 1:
        return before
    bars = before.select("query_block", "dim", "kth")
    others = queries.join(bars, ["query_block", "dim"], "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    after = _walked(others.where(F.col("block") != F.pmod(F.col("query_block"), F.lit(n_blocks))).join(packed, ["block", "dim"]), k)
    return before.unionAll(after)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, **options) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best; is_query may use the column vec_id."""
    pairs = F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("x")
    best = walks(vectors, is_query, k, **options).select(pairs).select("x.query_id", "x.vec_id", "x.score")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The contract's query over a table `embeddings` in DuckDB.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 5
"""

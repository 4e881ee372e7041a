"""Centroid clustering by Lloyd's rounds with Elkan's bounds.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of the
distance to each of the k. A round calculates a distance only where neither the lower bound nor half
the distance between the two centroids lies strictly above the upper bound; a vector whose
upper bound is strictly below half the way from its centroid to the next one is left alone.
When centroids move, lower bounds fall and upper bounds rise by the moves. Squared distances are
exact integers; bounds are roots of them, rounded down or up, and pruning is strict, so a centroid
that ties with the own one is always looked at and the smaller number wins.

Vectors lie in blocks (`vectors`) with their bounds beside them. A round is a map over blocks that
writes the next table to the shared folder, with each block's sums per centroid; the sums, k x dim numbers each, are added up
by a tree of tasks. Only sums, centroids and moves reach the driver. The table of the round before is deleted when the
next one is there: a lost executor costs its tasks of one round.

Defined results: null vectors, those with null or non-finite components and those of another length
take no part; null ids are clustered but never start a centroid; of equal start hashes the lesser vector comes first;
repeated rows count each; fewer vectors than k start as many centroids; an empty table gives an empty result; extra columns
are left out. Components that pass 62 bits in sums or squares are handled as Python integers; what is
no long then is null.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import vectors as vec
from lodestar.llm.common import SharedTables

#: Relative room for the roundings of a root, a sum or a product of doubles.
ROOM = 2.0**-50


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def _root(d: np.ndarray, more: int) -> np.ndarray:
    d = np.asarray(d)
    if d.dtype == object:  # squares of Python's integers may be beyond doubles, roots are not
        return np.array([math.isqrt(x) + more for x in d.ravel()], np.float64).reshape(d.shape)
    return np.sqrt(d.astype(np.float64))


def root_up(d: np.ndarray) -> np.ndarray:
    return _root(d, 1) * (1 + ROOM)


def root_down(d: np.ndarray) -> np.ndarray:
    return _root(d, 0) * (1 - ROOM)


def floor32(x: np.ndarray) -> np.ndarray:
    """float32 values at most x."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def fresh_bounds(n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper and lower of vectors that nothing is known of."""
    return np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k), np.float32)


def moved(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold after the centroids moved by at most `moves`."""
    return (upper + moves[cluster]) * (1 + ROOM), floor32(np.maximum(lower.astype(np.float64) - moves, 0) * (1 - ROOM))


def assign(x: np.ndarray, centres: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves each vector to its nearest centroid, in place; how many distances to centroids were calculated."""
    k = len(centres)
    between = np.array([root_down(squared(centres, c)) / 2 for c in centres]).reshape(k, k)
    np.fill_diagonal(between, np.inf)
    rows = np.flatnonzero(~(between.min(axis=1)[cluster] > upper))
    if len(rows):
        near = ~((lower[rows] > upper[rows, None]) | (between[cluster[rows]] > upper[rows, None]))
        near[np.arange(len(rows)), cluster[rows]] = False
        rows = rows[near.any(axis=1)]
    best = squared(x[rows], centres[cluster[rows]])
    upper[rows], lower[rows, cluster[rows]] = root_up(best), floor32(root_down(best))
    done = len(rows)
    for c in range(k):
        own = cluster[rows]
        at = np.flatnonzero((own != c) & ~((lower[rows, c] > upper[rows]) | (between[own, c] > upper[rows])))
        d = squared(x[rows[at]], centres[c])
        done += len(at)
        lower[rows[at], c] = floor32(root_down(d))
        won = ((d < best[at]) | ((d == best[at]) & (c < own[at]))).astype(bool)
        at, d = at[won], d[won]
        cluster[rows[at]], best[at], upper[rows[at]] = c, d, root_up(d)
    return done


def sums_of(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """k x (dim + 1): per centroid the componentwise sums of its vectors, and their number."""
    out = np.zeros((k, x.shape[1] + 1), x.dtype)
    np.add.at(out[:, :-1], cluster, x)
    np.add.at(out[:, -1], cluster, 1)
    return out


def means(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """floor(sum / count) for centroids that have vectors; the others stay."""
    out = centres.copy()
    some = np.flatnonzero(sums[:, -1] > 0)
    out[some] = sums[some, :-1] // sums[some, -1:]
    return out


def starts(kept: DataFrame, k: int, dim: int, prefix: str, scale: int) -> list[list[int]]:
    """The k vectors of least sha256 of prefix and id, in that order."""
    rows = kept.where(F.col("vec_id").isNotNull() & (F.size("v") == dim))
    least = rows.orderBy(F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256), "v").limit(k)
    return [vec.integers(r["v"], scale) for r in least.select("v").toLocalIterator()]


def _added(table: DataFrame, column: str, shape: tuple[int, ...], wide: bool) -> np.ndarray:
    """The blocks' numbers, added up by a tree of tasks."""
    zero = np.zeros(shape, object if wide else np.int64)
    return table.select(column).rdd.treeAggregate(zero, lambda a, row: a + vec.read(row[0], shape, wide), lambda a, b: a + b)


_STATE = "n bigint, ids array<bigint>, kind string, columns binary, cluster binary, upper binary, lower binary, sums string, calculated bigint"
_FINAL = "ids array<bigint>, cluster array<int>, distance array<bigint>, inertia string"
_RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


class Clustering:
    """The rounds over one table; `calculated` has the number of distances of each round, `n` that of vectors."""

    def __init__(self, df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, prefix: str = "2:", scale: int = 256,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        self.tables = SharedTables(df.sparkSession, "centroids")
        kept = vec.whole(df, id_col, vector_col, scale)
        self.blocks = self.tables.write(vec.in_blocks(kept, dim, scale), "round-0")
        self.n, peak = vec.size_of(self.blocks)
        self.dim, self.wide = dim, vec.too_wide(peak, self.n, dim)
        self.centres = np.array(starts(kept, k, dim, prefix, scale), object if self.wide else np.int64).reshape(-1, dim)
        self.moves: np.ndarray | None = None
        self.calculated: list[int] = []
        for number in range(1, rounds + 1) if len(self.centres) else ():
            self._round(number)

    def _closed(self):
        """A block's vectors, clusters and bounds after an assignment to the present centroids."""
        centres, moves, dim, wide = self.centres, self.moves, self.dim, self.wide

        def call(row: dict):
            x = np.ascontiguousarray(vec.unpacked(row["kind"].as_py(), row["columns"].as_py(), dim, wide).T)
            if moves is None:
                cluster, upper, lower = fresh_bounds(len(x), len(centres))
            else:
                old = lambda name, kind: np.frombuffer(row[name].as_py(), kind)
                cluster = old("cluster", np.int32).copy()
                upper, lower = moved(cluster, old("upper", np.float64), old("lower", np.float32).reshape(len(x), -1), moves)
            done = assign(x, centres, cluster, upper, lower)
            return x, cluster, upper, lower, done

        return call

    def _round(self, number: int) -> None:
        closed, k = self._closed(), len(self.centres)

        def step(row: dict) -> dict:
            x, cluster, upper, lower, done = closed(row)
            known = {c: [row[c].as_py()] for c in ("n", "kind", "columns")}
            found = {"cluster": [cluster.tobytes()], "upper": [upper.tobytes()], "lower": [lower.tobytes()], "sums": [vec.written(sums_of(x, cluster, k))]}
            return known | found | {"ids": [row["ids"].as_py()], "calculated": [done]}

        self.blocks = self.tables.write(vec.each_block(self.blocks, step, _STATE), f"round-{number}")
        self.tables.drop(f"round-{number - 1}")
        after = means(self.centres, _added(self.blocks, "sums", (k, self.dim + 1), self.wide))
        self.moves = root_up(squared(after, self.centres))
        self.centres = after
        self.calculated.append(self.blocks.agg(F.sum("calculated")).first()[0])

    def result(self) -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
        closed, centres = self._closed(), self.centres
        k = len(centres)
        if not k:  # no vector has an id to start from
            return self.blocks.where("false").sparkSession.createDataFrame([], _RESULT)

        def last(row: dict) -> dict:
            x, cluster, *_ = closed(row)
            d = squared(x, centres[cluster])
            inertia = np.zeros(k, x.dtype)
            np.add.at(inertia, cluster, d)
            return {"ids": [row["ids"].as_py()], "cluster": [cluster.tolist()], "distance": [vec.longs(d).to_pylist()], "inertia": [vec.written(inertia)]}

        final = self.tables.write(vec.each_block(self.blocks, last, _FINAL), "final")
        by_cluster = [int(x) for x in _added(final, "inertia", (k,), True)]
        inertia = [vec.as_long(x) for x in by_cluster]
        total = vec.as_long(sum(by_cluster))
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]

        def rows(row: dict) -> dict:
            cluster = row["cluster"].values
            of = cluster.to_numpy()
            return {
                "vec_id": row["ids"].values, "cluster": cluster, "distance": row["distance"].values, "inertia": [total] * len(of),
                "cluster_inertia": [inertia[c] for c in of], "centroid_sha256": [digests[c] for c in of],
            }

        return vec.each_block(final.drop("inertia"), rows, _RESULT)


def cluster(df: DataFrame, **options) -> DataFrame:
    """Options as those of Clustering."""
    return Clustering(df, **options).result()


def oracle_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The contract's query over a table `embeddings` in DuckDB, every distance calculated."""

    def nearest(number: int) -> str:
        d = "list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"
        return f"a{number} AS MATERIALIZED (SELECT row, min({d} * {k} + cluster) AS best FROM v, c{number} GROUP BY row)"

    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (
  SELECT sha256('2:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))""",
    ]
    for r in range(rounds):
        parts.append(nearest(r))
        parts.append(f"""m{r + 1} AS (SELECT best % {k} AS cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n
  FROM a{r} JOIN v USING (row), range(1, {dim + 1}) t(i) GROUP BY ALL)""")
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM m{r + 1} GROUP BY cluster) USING (cluster))""")
    parts.append(nearest(rounds))
    return f"""WITH {", ".join(parts)},
r AS (SELECT vec_id, best % {k} AS cluster, best // {k} AS distance FROM a{rounds} JOIN v USING (row))
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM r JOIN c{rounds} USING (cluster)"""

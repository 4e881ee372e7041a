"""Vector code compression: product quantisation with one codebook for each part of a vector.

Vectors lie in columnar blocks (`vectors`). In each of the codebooks' rounds every task walks its
blocks: the distances of a part's n pieces to all entries grow dimension by dimension, the nearest
entries get the pieces by np.add.at in int64 tensors of sums and counts, and the tensors (parts x
entries x width, whatever the table's size) are merged by treeAggregate through a tree of tasks. The driver sees
the last few tensors and makes the next codebooks. The codes of the last ones are written as a table; errors per
label are a pre-aggregated sum of it.

Defined results: null vectors and those with null or non-finite components take no part, nor do
vectors of another length than that of the least vec_id that can be cut into the parts; null ids come
last; of equal ids the lesser vector comes first; repeated rows count each; fewer vectors than
entries start as many entries; an empty table gives an empty result; extra columns are left out. Components that
pass 62 bits in sums or squares are handled as Python integers; what is no long then is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import vectors as vec
from lodestar.llm.common import SharedTables

Tensors = tuple[np.ndarray, np.ndarray]


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column of a part; ties to the lower entry."""
    n, entries = columns.shape[1], len(book)
    distance = np.zeros((n, entries), columns.dtype)
    for values, of_entries in zip(columns, book.T):
        apart = values[:, None] - of_entries[None, :]
        distance += apart * apart
    entry = distance.argmin(axis=1)
    return entry, distance[np.arange(n), entry]


def added(tensors: Tensors | None, columns: np.ndarray, books: np.ndarray) -> Tensors:
    """The sums and counts of `tensors` and of a block's pieces, each under its nearest entry."""
    parts, entries, width = books.shape
    sums, counts = tensors or (np.zeros(books.shape, columns.dtype), np.zeros((parts, entries), columns.dtype))
    for p in range(parts):
        piece = columns[p * width : (p + 1) * width]
        entry, _ = nearest(piece, books[p])
        np.add.at(sums[p], entry, piece.T)
        np.add.at(counts[p], entry, 1)
    return sums, counts


def merged(a: Tensors | None, b: Tensors | None) -> Tensors | None:
    return a if b is None else b if a is None else (a[0] + b[0], a[1] + b[1])


def means(books: np.ndarray, tensors: Tensors | None) -> np.ndarray:
    """floor(sum / count) of each used entry; the others stay."""
    out = books.copy()
    if tensors:
        sums, counts = tensors
        used = counts > 0
        out[used] = sums[used] // counts[used][:, None]
    return out


def code_of(entries: np.ndarray) -> list[str]:
    """Two hex digits for each part, in part order, for the columns of a parts x n array."""
    return [bytes(column).hex() for column in entries.T.astype(np.uint8)]


class Codes:
    """The codebooks of one table (`books`, parts x entries x width) and the codes of its vectors."""

    def __init__(self, df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> None:
        if not 1 <= entries <= 256:
            raise ValueError("a code of two hex digits tells at most 256 entries apart")
        self.tables = SharedTables(df.sparkSession, "vectorcodes")
        kept = vec.whole(df, id_col, vector_col, scale, label_col)
        by_id = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "v")
        first = by_id.limit(1).select(F.size("v")).first()
        self.dim = first[0] if first else 0
        self.blocks = self.tables.write(vec.in_blocks(kept, self.dim, scale), "blocks") if self.dim else None
        n, peak = vec.size_of(self.blocks) if self.dim else (0, 0.0)
        self.wide = vec.too_wide(peak, n, self.dim)
        # entries x dim becomes parts x entries x width
        begin = [vec.integers(r["v"], scale) for r in by_id.where(F.size("v") == self.dim).limit(entries).select("v").toLocalIterator()]
        begin = np.array(begin, object if self.wide else np.int64).reshape(len(begin), parts, self.dim // parts)
        self.books = np.ascontiguousarray(begin.transpose(1, 0, 2))
        self.label_type = df.schema[label_col].dataType.simpleString()
        for _ in range(rounds if self.dim else 0):
            self.books = means(self.books, self._tensors())

    def _tensors(self) -> Tensors | None:
        books, dim, wide = self.books, self.dim, self.wide
        one = lambda tensors, row: added(tensors, vec.unpacked(row["kind"], bytes(row["columns"]), dim, wide), books)
        return self.blocks.select("kind", "columns").rdd.treeAggregate(None, one, merged)

    def coded(self) -> DataFrame:
        """vec_id, label, code and error of every vector."""
        books, dim, wide = self.books, self.dim, self.wide
        parts, _, width = books.shape
        ddl = f"vec_id bigint, label {self.label_type}, code string, error bigint"
        if not dim:
            return self.tables.spark.createDataFrame([], ddl)

        def code(row: dict) -> dict:
            columns = vec.unpacked(row["kind"].as_py(), row["columns"].as_py(), dim, wide)
            found = [nearest(columns[p * width : (p + 1) * width], books[p]) for p in range(parts)]
            error = sum(d for _, d in found)
            return {"vec_id": row["ids"].values, "label": row["kept"].values, "code": code_of(np.array([e for e, _ in found])), "error": vec.longs(error)}

        return vec.each_block(self.blocks, code, ddl)

    def digest(self) -> str:
        """sha256 of all entries' integers by part, entry and position, as text."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def result(self) -> DataFrame:
        """vec_id, code, error, label_error and codebooks_sha256 of every vector."""
        rows = self.tables.write(self.coded(), "coded")
        total = F.sum(F.col("error").cast("decimal(20,0)")).try_cast("bigint")
        by_label = self.tables.write(rows.groupBy("label").agg(total.alias("label_error")), "labels").withColumnRenamed("label", "of_label")
        return rows.join(by_label, rows["label"].eqNullSafe(by_label["of_label"]), "left").select(
            "vec_id", "code", "error", "label_error", F.lit(self.digest()).alias("codebooks_sha256")
        )


def compress(df: DataFrame, **options) -> DataFrame:
    """Options as those of Codes."""
    return Codes(df, **options).result()


def restored(code: str, books: np.ndarray) -> list[int]:
    """The integer vector that a code stands for."""
    return np.concatenate([book[entry] for entry, book in zip(bytes.fromhex(code), books)]).tolist()


def oracle_sql(parts: int = 16, entries: int = 64, rounds: int = 2, dim: int = 64) -> str:
    """The contract's query over a table `embeddings` of vectors of dim components in DuckDB, every distance calculated."""
    width = dim // parts

    def nearest_sql(number: int) -> str:
        d = " + ".join(f"(v[p * {width} + {j}] - c[{j}]) * (v[p * {width} + {j}] - c[{j}])" for j in range(1, width + 1))
        return f"a{number} AS MATERIALIZED (SELECT row, p, min(({d}) * {entries} + e) AS best FROM v, b{number} GROUP BY row, p)"

    sql = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"b0 AS MATERIALIZED (SELECT p, row AS e, v[p * {width} + 1 : (p + 1) * {width}] AS c FROM v, range({parts}) t(p) WHERE row < {entries})",
    ]
    for r in range(rounds):
        sql.append(nearest_sql(r))
        mean = ", ".join(f"(s{j} - ((s{j} % n) + n) % n) // n" for j in range(1, width + 1))
        sums = ", ".join(f"sum(v[p * {width} + {j}])::BIGINT AS s{j}" for j in range(1, width + 1))
        sql.append(f"m{r + 1} AS (SELECT p, best % {entries} AS e, count(*) AS n, {sums} FROM a{r} JOIN v USING (row) GROUP BY ALL)")
        sql.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM b{r} LEFT JOIN (SELECT p, e, [{mean}] AS m FROM m{r + 1}) USING (p, e))")
    sql.append(nearest_sql(rounds))
    return f"""WITH {", ".join(sql)},
r AS (SELECT row, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (row), h"""

"""Helpers shared by the training-data operators: shared tables, Arrow batches and hashing."""

from __future__ import annotations

import bisect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled by one call of a per-batch function; bounds a Python worker's memory.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset and all tasks run on this machine, as in tests, a local folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "_own", None)
    if own is None:
        own = shared_dir._own = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    return own


#: Spark's setting that deletes a query's shuffle files when it ends, instead of when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class SharedTables:
    """Parquet tables in the shared folder that cut lineage between the steps of one operator.

    A lost executor costs the reading tasks a re-read, never a recomputation from the start.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and return a DataFrame that reads it back. The write's shuffle files go with it: nothing reads them again."""
        conf = df.sparkSession.conf
        before = conf.get(SHUFFLES_GO, None)
        conf.set(SHUFFLES_GO, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no returned DataFrame reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch; Spark's default of 64 MB is much for workers that hold texts in several forms.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, unless they are set to something else."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", f"{64 << 20}b", str(64 << 20)):
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about SLICE_BYTES of text (one row at least)."""
    column = batch.column(text_col)
    if batch.num_rows == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    group = np.cumsum(lengths) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame, text_col: str | None, fn: Callable[[pa.RecordBatch, list[str]], dict] | None, schema: str, make: Callable | None = None,
    as_list: bool = True,
) -> DataFrame:
    """Apply fn to Arrow slices of df; texts are given as a list with None as "".

    Without text_col, fn gets whole batches and no texts.

    fn returns a dict of columns named as in the schema. With `make`, fn is made inside each
    task by make() (for state that should live as long as the task, as caches do).
    """
    bound_batches(df.sparkSession)
    target = DataFrameSchema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make() if make else fn
        arrow = target.arrow()
        for whole in batches:
            for part in slices(whole, text_col) if text_col else [whole]:
                texts = [x or "" for x in part.column(text_col).to_pylist()] if text_col and as_list else []
                columns = call(part, texts)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in arrow],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def map_slices(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Like map_texts with `make`, for functions that read the Arrow text column themselves."""

    def whole():
        call = make()
        return lambda batch, _: call(batch)

    return map_texts(df, text_col, None, schema, make=whole, as_list=False)


def text_digest(text: Column) -> Column:
    """128 bits of a text; null counts as empty. Never null, so that joins by it add no filter of their own."""
    return F.coalesce(F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")))), F.lit(b""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed so that no column of df bears them (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def by_place(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ..., and the new names of some: Spark's Arrow maps take no dots in names."""
    places = {c.lower(): f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [places[n.lower()] for n in names]


class DataFrameSchema:
    """A DDL schema that gives its Arrow form inside tasks."""

    def __init__(self, ddl: str) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        self._arrow = to_arrow_schema(_parse_datatype_string(ddl))

    def arrow(self) -> pa.Schema:
        return self._arrow


class Covered:
    """The union of some intervals; tells by binary search whether another one meets it."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start


def input_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id (as bigint `doc_id`) and text columns alone, so that extra columns can't clash."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads low-entropy integers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Maps words to 64-bit hashes, remembering up to `limit` words per task."""

    def __init__(self, limit: int = 400_000) -> None:
        import xxhash

        self.limit, self._of = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = self._of(word.encode())
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """64-bit hashes of the runs of k words, in text order; a shorter text is one shingle.

    An empty text has none.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n - width + 1 + j])
    return h

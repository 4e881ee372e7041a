"""Whole integer vectors in columnar blocks, for operators that pass over all vectors many times.

A block is one row: the ids (and a kept column) as arrays, and the components floor(scale * x) by
dimension, one dimension after another, in the narrowest kind that holds them. Blocks follow the
table's own partitions; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import DataFrameSchema, bound_batches

#: Vectors of a block.
BLOCK = 4096
#: Longs end here.
MOST_LONG = (1 << 63) - 1


def _finite(vector: Column, scale: int) -> Column:
    """No component is null or non-finite, nor its scaled value (which a double beyond 1e305 would be)."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))


def whole(df: DataFrame, id_col: str, vector_col: str, scale: int = 256, kept: str | None = None) -> DataFrame:
    """vec_id bigint, v and (if named) kept: the rows whose vector is there, with finite components alone."""
    vector = F.col(vector_col)
    columns = [F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("v")]
    return df.where(vector.isNotNull() & _finite(vector, scale)).select(*columns, *([F.col(kept).alias("kept")] if kept else []))


def integers(vector: list[float], scale: int = 256) -> list[int]:
    """floor(scale * x) of each component, exactly."""
    return [int(np.floor(np.float64(x) * scale)) for x in vector]


def _packed(values: np.ndarray) -> tuple[str, float, bytes]:
    """Kind, greatest absolute value and bytes of a dim x n array of whole numbers given as doubles."""
    peak = float(np.abs(values).max(initial=0))
    kind = "<i2" if peak < 1 << 15 else "<i4" if peak < 1 << 31 else "<f8"
    return kind, peak, np.ascontiguousarray(values).astype(kind).tobytes()


def unpacked(kind: str, columns: bytes, dim: int, wide: bool) -> np.ndarray:
    """The dim x n integers of a block: int64, or Python's own where these would not do."""
    values = np.frombuffer(columns, kind).reshape(dim, -1)
    return np.array([list(map(int, row)) for row in values.tolist()], object).reshape(values.shape) if wide else values.astype(np.int64)


def too_wide(peak: float, n: int, dim: int) -> bool:
    """Whether sums of n components, or squared distances of dim ones, may pass 62 bits."""
    return max(peak, 1.0) * n >= 2.0**62 or (2 * peak + 2) ** 2 * max(dim, 1) >= 2.0**62


def in_blocks(vectors: DataFrame, dim: int, scale: int = 256, size: int = BLOCK) -> DataFrame:
    """n, ids, kept (if given), kind, peak, columns: the vectors of `whole` with dim components, in blocks."""
    bound_batches(vectors.sparkSession)
    kept = [c for c in ("kept",) if c in vectors.columns]
    ddl = "n bigint, ids array<bigint>, " + "".join(f"kept array<{vectors.schema[c].dataType.simpleString()}>, " for c in kept) + "kind string, peak double, columns binary"
    schema = DataFrameSchema(ddl)

    def pack(batches):
        arrow = schema.arrow()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                n = part.num_rows
                flat = np.asarray(part.column("v").flatten(), dtype=np.float64).reshape(n, dim)
                kind, peak, columns = _packed(np.floor(flat * scale).T)
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(c)).cast(arrow.field(name).type) for c, name in (("vec_id", "ids"), *((c, c) for c in kept))]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *lists, pa.array([kind]), pa.array([peak]), pa.array([columns], pa.binary())], schema=arrow)

    return vectors.where(F.size("v") == dim).mapInArrow(pack, ddl)


def each_block(blocks: DataFrame, fn: Callable[[dict[str, pa.Scalar]], dict], ddl: str) -> DataFrame:
    """The rows that fn gives for each block: columns by name, as Arrow arrays, numpy arrays or lists."""
    bound_batches(blocks.sparkSession)
    schema = DataFrameSchema(ddl)

    def run(batches):
        arrow = schema.arrow()
        for batch in batches:
            for i in range(batch.num_rows):
                found = fn({name: batch.column(name)[i] for name in batch.schema.names})
                arrays = [c if isinstance(c := found[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return blocks.mapInArrow(run, ddl)


def size_of(blocks: DataFrame) -> tuple[int, float]:
    """How many vectors the blocks hold, and their greatest absolute component."""
    n, peak = blocks.agg(F.sum("n"), F.max("peak")).first()
    return n or 0, peak or 0.0


def longs(values: np.ndarray) -> pa.Array:
    """int64 values as they are; Python integers that aren't longs become null."""
    return pa.array(values) if values.dtype != object else pa.array([x if x <= MOST_LONG else None for x in values.tolist()], pa.int64())


def as_long(value: int) -> int | None:
    return value if value <= MOST_LONG else None


def written(numbers: np.ndarray) -> str:
    """Integers of any length as text; `read` is the way back."""
    return " ".join(map(str, numbers.ravel().tolist()))


def read(text: str, shape: tuple[int, ...], wide: bool) -> np.ndarray:
    return np.array(list(map(int, text.split())), object if wide else np.int64).reshape(shape)

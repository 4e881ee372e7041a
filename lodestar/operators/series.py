"""Long series in many tasks: places, sliding percentiles and averages at every step.

A series' rows get their places by a range sort, and are cut into ranges of places. A range is a
group of bounded size, however long its series is; what it needs of earlier ranges is an overlap of rows, or
one pair of numbers per range.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodestar.operators.shard import global_index, quoted
from lodestar.sources.scratch import written

#: Rows of a range.
RANGE = 1 << 16


def series_index(df: DataFrame, by: str, order: str, name: str = "i") -> DataFrame:
    """Adds each row's 0-based place in its series; no series is sorted in one task."""
    rows = global_index(df, [F.col(by), F.col(order)], "_at")
    first = rows.groupBy(F.col(by).alias("_by")).agg(F.min("_at").alias("_first"))
    return rows.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_by", "_first")


class Ordered:
    """Numbers in order, equal ones included, in lists of at most 2 * LOAD: adding, removing and finding
    the kth look at one list and the lengths of the others."""

    LOAD = 256

    def __init__(self, values: Iterable[float] = ()) -> None:
        values = sorted(values)
        self.lists = [values[i : i + self.LOAD] for i in range(0, len(values), self.LOAD)] or [[]]
        self.size = len(values)

    def _list(self, x: float) -> int:
        """The first list whose last value is x or more, or the last list."""
        lo, hi = 0, len(self.lists) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.lists[mid][-1] < x:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def add(self, x: float) -> None:
        i = self._list(x)
        bisect.insort(self.lists[i], x)
        self.size += 1
        if len(self.lists[i]) > 2 * self.LOAD:
            whole = self.lists[i]
            self.lists[i : i + 1] = [whole[: self.LOAD], whole[self.LOAD :]]

    def remove(self, x: float) -> None:
        i = self._list(x)
        del self.lists[i][bisect.bisect_left(self.lists[i], x)]
        self.size -= 1
        if not self.lists[i] and len(self.lists) > 1:
            del self.lists[i]

    def kth(self, k: int) -> float:
        for some in self.lists:
            if k < len(some):
                return some[k]
            k -= len(some)
        raise IndexError(k)

    def percentile(self, p: float) -> float:
        """Between the two nearest ranks, in proportion."""
        at = p * (self.size - 1)
        low = int(at)
        a = self.kth(low)
        return a if low == at else a + (self.kth(low + 1) - a) * (at - low)


class Rolling:
    """The capped percentile of the last `size` values, once there are as many; missing ones hold their place."""

    def __init__(self, size: int, percentile: float, most: float, ring: Iterable[float | None] = ()) -> None:
        self.size, self.p, self.most = size, percentile, most
        self.ring = deque(ring)
        self.ordered = Ordered(x for x in self.ring if x is not None)

    def push(self, x: float | None) -> float | None:
        if len(self.ring) == self.size and (old := self.ring.popleft()) is not None:
            self.ordered.remove(old)
        self.ring.append(x)
        if x is not None:
            self.ordered.add(x)
        return min(self.ordered.percentile(self.p), self.most) if self.ordered.size == self.size else None


def _whole(df: DataFrame) -> Column:
    """A row's columns as one, whatever their names."""
    return F.struct(*map(quoted, df.columns)).alias("row")


def _missing_to_none(column: pa.ChunkedArray) -> list[float | None]:
    return [None if x is None or x != x else x for x in column.to_pylist()]


def rolling_limit(df: DataFrame, by: str, order: str, value: str, size: int, percentile: float, most: float, range_rows: int = RANGE) -> DataFrame:
    """Adds `limit`: the percentile of a series' last `size` values, capped; null until there are as many.

    A row goes to its own range of places and to those later ones whose first windows reach back to it.
    Null and NaN values hold a place in the window and leave its limit null.
    """
    step = max(range_rows, size)
    place = F.col("_i")
    ranges = F.sequence(F.floor(place / step), F.floor((place + (size - 1)) / step))
    rows = series_index(df, by, order, "_i").select(_whole(df), F.col(by).alias("_by"), "_i", F.col(value).cast("double").alias("_x"))
    out = StructType([StructField("row", df.schema), StructField("limit", DoubleType())])

    def slide(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        rolling = Rolling(size, percentile, most)
        limits = [rolling.push(x) for x in _missing_to_none(table.column("_x"))]
        own = pa.array(np.asarray(table.column("_i")) // step == key[1].as_py())
        return table.select(["row"]).append_column("limit", pa.array(limits, pa.float64())).filter(own)

    return rows.withColumn("_range", F.explode(ranges)).groupBy("_by", "_range").applyInArrow(slide, out).select("row.*", "limit")


def affine_prefix(df: DataFrame, by: str, place: str, a: str, b: str, name: str, range_rows: int = RANGE) -> DataFrame:
    """Adds the state after each step of x -> a x + b, in order of `place` (0, 1, ... in each series), from 0.

    Maps compose to maps: each range is folded by itself, the ranges' maps are a shorter series of the same kind, and
    the state before a range goes through its rows' maps. Columns a and b must not be null.
    """
    columns = [StructField("row", df.schema), StructField("_by", df.schema[by].dataType), StructField("_i", LongType())]
    folded = StructType([*columns, *(StructField(c, DoubleType()) for c in ("_a", "_b"))])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        product, state, out_a, out_b = 1.0, 0.0, [], []
        for x, y in zip(table.column("_x").to_pylist(), table.column("_y").to_pylist()):
            product, state = product * x, state * x + y
            out_a.append(product)
            out_b.append(state)
        return table.select(["row", "_by", "_i"]).append_column("_a", pa.array(out_a, pa.float64())).append_column("_b", pa.array(out_b, pa.float64()))

    cut = F.floor(F.col("_i") / range_rows)
    maps = df.select(_whole(df), F.col(by).alias("_by"), F.col(place).cast("bigint").alias("_i"), F.col(a).alias("_x"), F.col(b).alias("_y"))
    rows = written(maps.withColumn("_range", cut).groupBy("_by", "_range").applyInArrow(fold, folded), "prefix").withColumn("_range", cut)
    last = rows.agg(F.max("_range")).first()[0]
    if not last:
        return rows.select("row.*", F.col("_b").alias(name))
    totals = rows.groupBy("_by", "_range").agg(F.max_by("_a", "_i").alias("x"), F.max_by("_b", "_i").alias("y"))
    before = affine_prefix(totals, "_by", "_range", "x", "y", "_before", range_rows).select(F.col("_by").alias("_of"), (F.col("_range") + 1).alias("_next"), "_before")
    joined = rows.join(before, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_next")), "left")
    return joined.select("row.*", (F.col("_a") * F.coalesce("_before", F.lit(0.0)) + F.col("_b")).alias(name))


def ema_steps(df: DataFrame, by: str, order: str, value: str, rate: float, range_rows: int = RANGE) -> DataFrame:
    """Adds `ema` after each step: e = rate e + (1 - rate) x, from the first value. Rows without a value are left out."""
    there = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = series_index(there, by, order, "_i")
    first = F.col("_i") == 0
    x = F.col(value).cast("double")
    maps = rows.withColumn("_x", F.when(first, 0.0).otherwise(rate)).withColumn("_y", F.when(first, x).otherwise((1 - rate) * x))
    return affine_prefix(maps, by, "_i", "_x", "_y", "ema", range_rows).drop("_i", "_x", "_y")

"""Nested records of any depth, as VARIANT values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.scratch import written


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0).isin(*kinds), F.lit(False))


def leaves(df: DataFrame, keys: list[str], record: str, separator: str = ".", enter_arrays: bool = False) -> DataFrame:
    """keys, path, leaf (a variant): what stands at the ends of each JSON record, however deep.

    Objects are opened level by level until none is left; a level is a table, so that its rows are parsed once. An array is a leaf;
    with enter_arrays it is opened like an object whose names are 0, 1, ... Empty objects have no leaves, a record that is no
    object is a leaf of the path '', and text that isn't JSON has none. A null in a record is a leaf whose value is null.
    """
    kinds = ("OBJECT", "ARRAY") if enter_arrays else ("OBJECT",)
    rows = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(record).alias("value")).where("value IS NOT NULL")
    done = None
    while True:
        rows = written(rows.withColumn("open", _is(F.col("value"), *kinds)), "level")
        ends = rows.where("not open").select(*keys, "path", F.col("value").alias("leaf"))
        done = ends if done is None else done.unionAll(ends)
        if rows.where("open").isEmpty():
            return done
        inside = df.sparkSession.tvf.variant_explode(F.col("value").outer())
        name = F.coalesce(F.col("inner.key"), F.col("inner.pos").cast("string"))
        path = F.when(F.col("outer.path") == "", name).otherwise(F.concat("outer.path", F.lit(separator), name))
        opened = rows.where("open").alias("outer").lateralJoin(inside.alias("inner"))
        rows = opened.select(*(F.col(f"outer.{k}") for k in keys), path.alias("path"), F.col("inner.value").alias("value"))


def number(leaf: str = "leaf") -> Column:
    """A leaf as a number; null if it is none."""
    return F.try_variant_get(leaf, "$", "double")


def leaf_tests(found: DataFrame, keys: list[str], test: Callable[[Column], Column]) -> DataFrame:
    """keys, some, every: whether any, and whether all, of a record's leaves pass; a leaf that can't be told fails."""
    passed = F.coalesce(test(F.col("leaf")), F.lit(False))
    return found.groupBy(*keys).agg(F.bool_or(passed).alias("some"), F.bool_and(passed).alias("every"))

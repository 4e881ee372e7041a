"""Task planning on a long model (key, view, resolution): required minus done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required_tasks(keys: DataFrame, views: list[int], resolutions: list[int]) -> DataFrame:
    """Every key with every view and resolution; the lists are constants, so nothing is joined."""
    return keys.withColumn("view_idx", F.explode(F.array(*map(F.lit, views)))).withColumn("resolution", F.explode(F.array(*map(F.lit, resolutions))))


def remaining_tasks(required: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return required.join(done.select(on).distinct(), on, "left_anti")


def all_done(df: DataFrame, key: str, view: str, done: Column, n_views: int) -> DataFrame:
    """Keys that are done in all of their first n views."""
    return (
        df.where(F.col(view).between(0, n_views - 1)).groupBy(key)
        .agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("all"), F.count_distinct(view).alias("views"))
        .where(F.col("all") & (F.col("views") == n_views)).select(key)
    )


def any_done(df: DataFrame, key: str, done: Column) -> DataFrame:
    return df.groupBy(key).agg(F.bool_or(F.coalesce(done, F.lit(False))).alias("any")).where("any").select(key)


def to_wide(df: DataFrame, key: str, view: str, views: list[int], value: Column, prefix: str) -> DataFrame:
    """One column per view, from an explicit list, so that the schema doesn't hang on the data."""
    return df.groupBy(key).agg(*(F.max(F.when(F.col(view) == v, value)).alias(f"{prefix}{v:02d}") for v in views))


def incomplete(required: DataFrame, done: DataFrame, key: str, on: list[str]) -> DataFrame:
    """Keys that lack any of their tasks, and how many."""
    return remaining_tasks(required, done, on).groupBy(key).agg(F.count("*").alias("missing"))

"""Key merges: column-wise first non-null with explicit precedence, in one shuffle.

Merging n tables pairwise costs n - 1 full outer joins. Here the tables are stacked with a
priority each and reduced by one grouped aggregate, which combines before the shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two tables with unique keys: the left value unless it is null."""
    columns = sorted({*left.columns, *right.columns} - {key})
    l, r = left.alias("l"), right.alias("r")
    pick = lambda c: (
        F.coalesce(f"l.{c}", f"r.{c}") if c in left.columns and c in right.columns else F.col(f"l.{c}" if c in left.columns else f"r.{c}")
    )
    joined = l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    return joined.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), *(pick(c).alias(c) for c in columns))


def merge_first(frames: list[DataFrame], key: str, existing_wins: bool = True) -> DataFrame:
    """Merge any number of tables by key: per column the first non-null value in table order.

    existing_wins False reverses the order: later tables beat earlier ones.
    """
    ordered = frames if existing_wins else frames[::-1]
    stacked = functools.reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("_priority", F.lit(i)) for i, f in enumerate(ordered))
    )
    return first_non_null(stacked, key, "_priority")


def first_non_null(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: per column the non-null value of least order. Drops the order column."""
    columns = sorted(set(df.columns) - {key, order})
    # the order carries along: `first(ignorenulls)` would depend on row arrival
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return df.groupBy(key).agg(*picks) if picks else df.select(key).distinct()


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def left_join_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join; columns of the right that the left has too get a suffix, the left's stay."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c != key and c in left.columns}
    return left.join(right.withColumnsRenamed(clash), key, "left")


def assign_if_absent(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """The column from a lookup, only if the table doesn't have it."""
    return df if column in df.columns else df.join(lookup.select(key, column), key, "left")


def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value per key: that of the greatest order (later duplicates win)."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def append_unknown(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows and the new ones whose key isn't known yet."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side: 'missing' on the right, or 'unexpected' there."""
    l, r = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "unexpected")
    return l.join(r, key, "full_outer").withColumn("side", side).where(F.col("side").isNotNull()).select(key, "side")


def coordinate_mismatch(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Coordinates that only one of two tables has, with the side that has it."""
    l, r = left.select(on).distinct().withColumn("_l", F.lit(1)), right.select(on).distinct().withColumn("_r", F.lit(1))
    return l.join(r, on, "full_outer").where("_l is null or _r is null").select(*on, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def zipped(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Positional join of two equally long arrays per key: (key, pos, a, b); unequal lengths are an error."""
    both = left.select(key, a).join(right.select(key, b), key)
    equal = F.when(F.size(a) == F.size(b), F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")))
    pairs = F.coalesce(equal, F.raise_error(F.concat(F.lit("arrays of unequal length for key "), F.col(key).cast("string"))))
    return both.select(key, F.posexplode(pairs).alias("pos", "x")).select(key, "pos", F.col("x.a").alias(a), F.col("x.b").alias(b))


def looked_up(df: DataFrame, table: DataFrame, on: str, key: str, column: str) -> DataFrame:
    """Adds the table's value for each row's key; null where it has none. Keys of the table are unique."""
    return df.join(table.select(F.col(key).alias(on), column), on, "left").select(*df.columns, column)


def merged_maps(a: str, b: str):
    """Two maps as one; a key in both is an error (Spark's default policy raises)."""
    return F.map_concat(a, b)


def first_existing(candidates: DataFrame, key: str, paths: str, files: DataFrame) -> DataFrame:
    """Per key the first of its candidate paths that is among the files."""
    rows = candidates.select(key, F.posexplode(paths).alias("pos", "path"))
    return rows.join(files.select("path"), "path", "left_semi").groupBy(key).agg(F.min_by("path", "pos").alias("path"))

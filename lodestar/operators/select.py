"""Selection: null-safe flags, column families, funnels and statistics."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_true(flag: str | Column) -> Column:
    """The flag is true; missing counts as not done."""
    return (F.col(flag) if isinstance(flag, str) else flag).eqNullSafe(F.lit(True))


def not_true(flag: str | Column) -> Column:
    """The flag is false or missing. A plain `!=` would lose the missing rows."""
    return ~is_true(flag)


def any_true(flags: list[str]) -> Column:
    return functools.reduce(operator.or_, map(is_true, flags))


def all_true(flags: list[str]) -> Column:
    return functools.reduce(operator.and_, map(is_true, flags))


def at_least(column: str, low: float) -> Column:
    """column >= low; NULL and NaN fail."""
    return F.coalesce((F.col(column) >= low) & ~F.isnan(F.col(column).cast("double")), F.lit(False))


def at_most(column: str, high: float) -> Column:
    """column <= high; NULL and NaN fail."""
    return F.coalesce((F.col(column) <= high) & ~F.isnan(F.col(column).cast("double")), F.lit(False))


def with_suffix(df: DataFrame, columns: list[str], resolution: int) -> DataFrame:
    """Columns named for a resolution: size -> size_256."""
    return df.withColumnsRenamed({c: f"{c}_{resolution}" for c in columns})


def without_suffix(df: DataFrame, resolution: int) -> DataFrame:
    """The inverse, for all columns of that resolution."""
    end = f"_{resolution}"
    return df.withColumnsRenamed({c: c.removesuffix(end) for c in df.columns if c.endswith(end)})


def if_column(df: DataFrame, column: str, then: Column, otherwise: Column | None = None) -> DataFrame:
    """Filter by `then` if the table has the column, else by `otherwise` (or not at all)."""
    if column in df.columns:
        return df.where(then)
    return df if otherwise is None else df.where(otherwise)


def family(df: DataFrame, part: str) -> list[str]:
    """Columns whose name holds `part` as a whole, set apart by underscores."""
    return [c for c in df.columns if f"_{part}_" in f"_{c}_"]


def bypass(names: Column, exempt: list[str], predicate: Column) -> Column:
    """Datasets named (in any letter case) skip the predicate."""
    return F.lower(names).isin(*[x.lower() for x in exempt]) | F.coalesce(predicate, F.lit(False))


def skip_listed(df: DataFrame, parts: list[str], skip: DataFrame, key: str) -> DataFrame:
    """Rows whose composite key a/b isn't listed."""
    own = F.concat_ws("/", *parts)
    return df.withColumn("_key", own).join(skip.select(F.col(key).alias("_key")), "_key", "left_anti").drop("_key")


def finite(array: str) -> Column:
    """All components are there and neither NaN nor infinite."""
    return F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def non_empty_objects(objects: str) -> Column:
    """Objects with at least one vertex and one face."""
    return F.filter(objects, lambda o: (F.size(o["vertices"]) > 0) & (F.size(o["faces"]) > 0))


def funnel(df: DataFrame, steps: list[tuple[str, Column]], by: list[str]) -> DataFrame:
    """Per group the rows left after each step, counted in one pass over the table."""
    passed, counts = F.lit(True), [F.count("*").alias("n_all")]
    for name, step in steps:
        passed = passed & F.coalesce(step, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n_{name}"))
    return df.groupBy(*by).agg(*counts)


def stage_statistics(df: DataFrame, counted: list[str], summed: list[str]) -> DataFrame:
    """One row: all rows, non-null counts of some columns and true counts of others."""
    return df.agg(
        F.count("*").alias("n_rows"), *(F.count(c).alias(f"n_{c}") for c in counted), *(F.count_if(is_true(c)).alias(f"sum_{c}") for c in summed)
    )


def first_available(df: DataFrame, choices: list[str]) -> Column:
    """Non-null count of the first column that the table has, else its row count."""
    for c in choices:
        if c in df.columns:
            return F.count(c)
    return F.count("*")


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break one with the names of the rules they break)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def visible(hidden_flags: list[str]) -> Column:
    """None of the flags hides the row; a missing flag doesn't."""
    return ~any_true(hidden_flags)

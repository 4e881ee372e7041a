"""Shards, permutations and packings.

A global row number would pull all rows through one task. Numbers are therefore given in two
levels: rows are range-sorted into parts, which are written and counted, and only the counts (one
row per part) are accumulated.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.sources.readers import exists
from lodestar.sources.scratch import written


#: Bits of the numbers that Spark gives within a partition.
_WITHIN = (1 << 33) - 1


def quoted(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order, written once, with each row's range and place in it.

    Ranges are drawn from a sample. Drawn twice, for counts and for rows, they need not be the same; so
    they are drawn once, and counts and rows read the table that came of it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.struct(*map(quoted, df.columns)).alias("row"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "ranges")
    return rows.select("row", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(_WITHIN)).alias("place"))


def _before(parts: DataFrame, value: str) -> DataFrame:
    """part, before: the sum of all earlier parts; one row per range goes through this window."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("before"))


def global_index(df: DataFrame, order: list[Column], name: str = "i") -> DataFrame:
    """Adds the row's 0-based place in a total order, without a one-task sort; equal rows get different places."""
    rows = _ranged(df, order)
    before = _before(rows.groupBy("part").agg(F.count("*").alias("n")), "n")
    return rows.join(before, "part").select("row.*", (F.col("before") + F.col("place")).alias(name))


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of the value up to and with each row, in two levels as global_index does."""
    rows = _ranged(df, order).withColumn("n", F.col("row")[value])
    before = _before(rows.groupBy("part").agg(F.sum("n").alias("n")), "n")
    within = F.sum("n").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(before, "part").select("row.*", (F.col("before") + F.col("within")).alias(name))


def contiguous_shard(index: Column, n: Column, world: int) -> Column:
    """The rank r whose slice [n*r//w, n*(r+1)//w) holds the index."""
    return F.floor(((index + 1) * world - 1) / n).cast("int")


def uniform_key(key: Column, seed: str) -> Column:
    """A portable random order: the MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))


def epoch_positions(index: Column, n: Column, world: int) -> tuple[Column, Column]:
    """(rank, place within the rank) of a strided epoch, for rows numbered in epoch order."""
    return F.pmod(index, F.lit(world)).cast("int"), F.floor(index / world).cast("bigint")


def epoch_padding(n: int, world: int) -> int:
    """How many of the first rows come again so that every rank has as many."""
    return -n % world


def lpt_pack(df: DataFrame, batch: str, item: str, load: str, bins: int, equal_size: bool = False) -> DataFrame:
    """Greedy longest-first packing of each batch into bins; batches are bounded by the caller.

    Ties go to the greater item first and to the bin of least (load, number). equal_size gives
    every bin as many items, if the batch divides evenly.
    """
    schema = f"{batch} {dict(df.dtypes)[batch]}, {item} {dict(df.dtypes)[item]}, {load} bigint, bin int"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([load, item], ascending=[False, False], kind="stable")
        most = -(-len(rows) // bins) if equal_size else len(rows)
        heap, sizes, where = [(0, b) for b in range(bins)], [0] * bins, []
        for x in rows[load]:
            filled, b = heap[0]
            sizes[b] += 1
            if sizes[b] < most:
                heapq.heapreplace(heap, (filled + x, b))
            else:  # full bins take no more
                heapq.heappop(heap)
            where.append(b)
        return rows.assign(bin=where)[[batch, item, load, "bin"]]

    return df.select(batch, item, F.col(load).cast("bigint").alias(load)).groupBy(batch).applyInPandas(pack, schema)


def balanced_epoch(df: DataFrame, key: str, load: str, seed: str, epoch: int, world: int, size: int) -> DataFrame:
    """key, i, batch, rank: one epoch, in which each global batch of world * size samples is packed by load.

    The epoch is a permutation of its own; its first samples come again at its end until every rank has as
    many. Every rank gets `size` samples of a batch, of about equal load; a last batch that isn't whole is left out.
    """
    rows = df.select(key, load, F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(epoch)), F.col(key).cast("string"))).alias("_u"))
    rows = global_index(rows, [F.col("_u"), F.col(key)], "_i").drop("_u")
    n = rows.count()
    total = n + epoch_padding(n, world)
    # a sample's places: its own, and that of the padding if it is among the first
    padded = rows.withColumn("i", F.explode(F.sequence("_i", F.lit(max(total - 1, 0)), F.lit(max(n, 1))))).drop("_i")
    whole = padded.withColumn("batch", F.floor(F.col("i") / (world * size))).where(F.col("batch") < total // (world * size))
    packed = lpt_pack(whole, "batch", "i", load, world, equal_size=True).withColumnRenamed("bin", "rank")
    return whole.select(key, "i").join(packed.select("i", "batch", "rank"), "i").select(key, "i", "batch", "rank")


def save_cursor(spark: SparkSession, path: str, step: int, rows: int) -> None:
    """The place of an endless walk as a table of one row; it replaces the one before."""
    epoch, place = divmod(step, max(rows, 1))
    spark.createDataFrame([(epoch, place)], "epoch bigint, place bigint").coalesce(1).write.mode("overwrite").json(path)


def saved_cursor(spark: SparkSession, path: str, rows: int) -> int:
    """The step to go on from; 0 without a saved one."""
    if not exists(spark, path):
        return 0
    epoch, place = spark.read.schema("epoch bigint, place bigint").json(path).first()
    return epoch * rows + place


def chosen_view(key: Column, seed: str, n: Column) -> Column:
    """One of n views per key, uniform and the same on every run."""
    return F.pmod(F.conv(F.substring(uniform_key(key, seed), 1, 15), 16, 10).cast("bigint"), n).cast("int")


def chosen_views(key: Column, seed: str, n: int, k: int) -> Column:
    """k different views of n per key: those whose digests come first."""
    views = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda v: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), v.cast("string"))).alias("u"), v.alias("v")))
    return F.array_sort(F.transform(F.slice(F.array_sort(views), 1, k), lambda s: s["v"]))


def latest_step(names: Column) -> Column:
    """The greatest step among checkpoint names such as denoiser_step0001000.pt (an aggregate)."""
    return F.max(F.regexp_extract(names, r"step(\d+)", 1).try_cast("bigint"))


def cycled(df: DataFrame, key: str, seed: str, start: int, count: int) -> DataFrame:
    """df with step, for steps [start, start + count) of an endless walk over epochs.

    Each epoch is a permutation of its own, so (epoch, place) = divmod(start, rows) is all that a
    resumed run needs. Only the epochs that the steps touch are dealt out.
    """
    n = df.count()
    if not n or count < 1:
        return df.withColumn("step", F.lit(None).cast("bigint")).where("false")
    first, last = start // n, (start + count - 1) // n
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(last))))
    rows = rows.withColumn("_u", F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.col(key).cast("string"))))
    rows = global_index(rows, [F.col("epoch"), F.col("_u"), F.col(key)], "step").withColumn("step", F.col("step") + first * n)
    return rows.where(F.col("step").between(start, start + count - 1)).drop("_u", "epoch")


def replaced(df: DataFrame, key: str, good: Column, seed: str) -> DataFrame:
    """key, used: a row that can't be used gives its place to a good one, drawn by seed and key; null if there is none."""
    rows = written(df.select(key, F.coalesce(good, F.lit(False)).alias("_good")), "replaced")
    there = global_index(rows.where("_good").select(F.col(key).alias("_other")), [F.col("_other")], "_at")
    n = rows.where("_good").count()
    bad = rows.where("not _good").withColumn("_at", chosen_view(F.col(key), seed, F.lit(max(n, 1))).cast("bigint"))
    kept = rows.where("_good").select(key, F.col(key).alias("used"))
    return kept.unionByName(bad.join(there, "_at", "left").select(key, F.col("_other").alias("used")))

from pyspark.sql import functions as F

from lodestar.operators import select, shard, tasks
from lodestar.sources.readers import nan_to_null


def test_missing_value_matrix(spark):
    df = spark.createDataFrame([(1, True, 6.0), (2, False, 4.0), (3, None, None), (4, None, float("nan"))], "i int, flag boolean, score double")
    keep = lambda c: sorted(r.i for r in df.where(c).collect())
    assert keep(select.is_true("flag")) == [1]
    assert keep(select.not_true("flag")) == [2, 3, 4]
    assert keep(select.at_least("score", 5)) == [1]
    assert [r.score for r in nan_to_null(df).orderBy("i").collect()] == [6.0, 4.0, None, None]


def test_families(spark):
    df = spark.createDataFrame([(True, None), (True, True), (None, None)], "a_256_x boolean, a_512_x boolean")
    assert df.where(select.any_true(df.columns)).count() == 2 and df.where(select.all_true(df.columns)).count() == 1
    assert select.family(df, "256") == ["a_256_x"] and select.family(df, "25") == []


def test_funnel_never_grows(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    row = select.funnel(df, [("a", F.col("id") > 10), ("b", F.col("id") % 2 == 0), ("c", F.lit(None).cast("boolean"))], ["g"]).collect()
    assert all(r.n_all >= r.n_a >= r.n_b >= r.n_c == 0 for r in row)


def test_shards_partition_exactly(spark):
    for n in (1, 7, 10, 23):
        for world in (1, 3, 4, 30):
            got = [r.s for r in spark.range(n).select(shard.contiguous_shard(F.col("id"), F.lit(n), world).alias("s")).collect()]
            want = [r for i in range(n) for r in range(world) if n * r // world <= i < n * (r + 1) // world]
            assert sorted(got) == want


def test_global_index_is_the_rank(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string")))
    rows = shard.global_index(df, [F.col("k")]).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(500)) and [r.k for r in rows] == sorted(r.k for r in rows)


def test_lpt_pack(spark):
    df = spark.createDataFrame([(0, i, load) for i, load in enumerate([8, 7, 6, 5, 4, 2])], "b int, i bigint, load bigint")
    got = shard.lpt_pack(df, "b", "i", "load", 2).groupBy("bin").agg(F.sum("load").alias("s"), F.count("*").alias("n")).collect()
    assert sorted(r.s for r in got) == [15, 17]
    equal = shard.lpt_pack(df, "b", "i", "load", 3, equal_size=True).groupBy("bin").count().collect()
    assert [r["count"] for r in equal] == [2, 2, 2]


def test_remaining_tasks(spark):
    need = tasks.required_tasks(spark.createDataFrame([("a",), ("b",)], "k string"), [0, 1], [256])
    done = spark.createDataFrame([("a", 0, 256)], "k string, view_idx int, resolution int")
    assert tasks.remaining_tasks(need, done, ["k", "view_idx", "resolution"]).count() == 3


def test_places_are_unique_with_other_columns_and_many_rows(spark):
    df = spark.range(1_000_000).select((F.hash("id") % 1000).alias("k"), "id", F.md5(F.col("id").cast("string")).alias("payload"))
    got = shard.global_index(df, [F.col("k"), F.col("id")])
    got.write.mode("overwrite").format("noop").save()
    assert got.agg(F.count_distinct("i"), F.min("i"), F.max("i"), F.count("*")).first() == (1_000_000, 0, 999_999, 1_000_000)
    assert got.where("i > 0").count() == 999_999 and got.orderBy("i").select("k").first()[0] == df.agg(F.min("k")).first()[0]


def test_running_sums_pass_part_bounds(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n"), F.lit("x").alias("part"))
    got = {r.id: r.s for r in shard.running_sum(df, [F.col("id")], "n", "s").collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total

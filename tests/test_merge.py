from pyspark.sql import functions as F

from lodestar.operators import merge


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def frames(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", None, "x"), ("c", 3, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("a", 9, "z"), ("b", 8, None), ("d", 7, "w")], "k string, n int, s string")
    return old, new


def test_existing_wins(spark):
    old, new = frames(spark)
    want = [("a", 1, "z"), ("b", 8, "x"), ("c", 3, "y"), ("d", 7, "w")]
    assert rows(merge.combine_first(old, new, "k"), "k", "n", "s") == want
    assert rows(merge.merge_first([old, new], "k"), "k", "n", "s") == want


def test_new_wins(spark):
    old, new = frames(spark)
    assert rows(merge.merge_first([old, new], "k", existing_wins=False), "k", "n", "s") == [("a", 9, "z"), ("b", 8, "x"), ("c", 3, "y"), ("d", 7, "w")]


def test_merge_is_idempotent_and_keeps_all_keys(spark):
    old, new = frames(spark)
    once = merge.merge_first([old, new], "k")
    assert rows(merge.merge_first([once, old, new], "k"), "k", "n", "s") == rows(once, "k", "n", "s")


def test_n_way_merge_is_one_shuffle(spark):
    old, new = frames(spark)
    plan = merge.merge_first([old, new, old.select("k", F.lit(1).alias("m"))], "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_first_non_null_takes_the_least_order(spark):
    df = spark.createDataFrame([("a", 2, 5, None), ("a", 1, None, "q"), ("a", 3, 7, "r")], "k string, at int, n int, s string")
    assert rows(merge.first_non_null(df, "k", "at"), "k", "n", "s") == [("a", 5, "q")]


def test_left_join_renames_only_the_right(spark):
    left = spark.createDataFrame([(1, True)], "k int, done boolean")
    right = spark.createDataFrame([(1, False)], "k int, done boolean")
    assert merge.left_join_suffix(left, right, "k", "_r").first().asDict() == {"k": 1, "done": True, "done_r": False}


def test_append_unknown_and_key_difference(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(merge.append_unknown(a, b, "k"), "k") == [(1,), (2,), (3,)]
    assert rows(merge.key_difference(a, b, "k"), "k", "side") == [(1, "missing"), (3, "unexpected")]

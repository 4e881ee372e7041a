import os
import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import ragged, records, shard, worker
from lodestar.sources import entity_files, readers


def make_slow():
    def slow(row):
        if row["k"] == 1:
            time.sleep(600)
        if row["k"] == 2:
            os._exit(9)
        if row["k"] == 3:
            raise KeyError("three")
        return None if row["k"] == 4 else {"pid": os.getpid()}

    return slow  # made here, so that it travels to workers by value


def test_a_hanging_row_costs_its_child_only():
    child = worker.Child(make_slow(), 0.3)
    try:
        first = child({"k": 0})
        assert first[1] is None and first[0]["pid"] != os.getpid() and child({"k": 5}) == first
        began = time.monotonic()
        assert child({"k": 1}) == (None, "TimeoutError: no result after 0.3 s") and time.monotonic() - began < 5
        second = child({"k": 0})
        assert second[1] is None and second != first
        assert child({"k": 2}) == (None, "ProcessError: the process ended with 9")
        assert child({"k": 3}) == (None, "KeyError: 'three'") and child({"k": 4}) == (None, None)
        last = child({"k": 0})[0]["pid"]
    finally:
        child.end()
    with pytest.raises(ProcessLookupError):
        os.kill(last, 0)


def test_rows_with_a_timeout(spark):
    rows = spark.range(40).select((F.col("id") % 10).alias("k"), "id")
    found = worker.per_row(rows, "id", make_slow(), "pid bigint", timeout=0.3).collect()
    assert sorted(r["id"] for r in found) == [i for i in range(40) if i % 10 != 4]
    errors = {i % 10: {r["error"] for r in found if r["id"] % 10 == i} for i in range(10)}
    assert errors == {i: {None} for i in (0, 5, 6, 7, 8, 9)} | {
        1: {"TimeoutError: no result after 0.3 s"}, 2: {"ProcessError: the process ended with 9"}, 3: {"KeyError: 'three'"}, 4: set()}


def test_hanging_rows_are_waited_for_together():
    children = worker.Children(make_slow(), 0.5)
    try:
        began = time.monotonic()
        rows = [{"k": k, "i": i} for i, k in enumerate([1, 0, 2, 1, 5, 3, 4] * 12)]
        done = [d for row in rows for d in children(row)] + list(children.rest())
        assert time.monotonic() - began < 6  # 24 rows of half a second
    finally:
        children.end()
    assert sorted(row["i"] for row, _, _ in done) == list(range(84)) and not children.silent
    errors = {1: "TimeoutError: no result after 0.5 s", 2: "ProcessError: the process ended with 9", 3: "KeyError: 'three'"}
    assert all(error == errors.get(row["k"]) for row, _, error in done)


def test_busy_rows_beside_one_another_have_their_time():
    def busy(row):
        until = time.process_time() + 0.15
        while time.process_time() < until:
            pass
        return row

    def pinned(row):
        os.sched_setaffinity(0, {0})  # all on one core
        return busy(row)

    children = worker.Children(pinned, 0.5)
    try:
        done = [d for i in range(16) for d in children({"i": i})] + list(children.rest())
    finally:
        children.end()
    assert sorted(found["i"] for _, found, error in done if error is None) == list(range(16))


RECORDS = [
    (1, '{"a":{"b":{"c":{"d":{"e":1}}}},"f":[1,{"g":2}],"h":{},"i":null,"x.y":true}'), (2, "3"), (3, "[]"), (4, "{}"), (5, "no json"), (6, None), (7, '{"a":{"b":[]}}'),
]


@pytest.mark.parametrize("enter", [False, True])
def test_leaves_at_any_depth(spark, enter):
    df = spark.createDataFrame(RECORDS, "id int, record string")
    found = records.leaves(df, ["id"], "record", enter_arrays=enter)
    got = sorted((r["id"], r["path"], r["leaf"]) for r in found.select("id", "path", F.to_json("leaf").alias("leaf")).collect())
    arrays = [(1, "f.0", "1"), (1, "f.1.g", "2")] if enter else [(1, "f", '[1,{"g":2}]'), (3, "", "[]"), (7, "a.b", "[]")]
    assert got == sorted([(1, "a.b.c.d.e", "1"), (1, "i", "null"), (1, "x.y", "true"), (2, "", "3"), *arrays])
    tests = records.leaf_tests(found, ["id"], lambda leaf: records.number() < 3)
    assert {r["id"]: (r["some"], r["every"]) for r in tests.collect() if r["id"] in (1, 2)} == {1: (True, False), 2: (False, False)}


def test_an_epoch_is_padded_and_balanced(spark):
    rows = [(i, (i * 37) % 11) for i in range(50)]
    found = shard.balanced_epoch(spark.createDataFrame(rows, "k bigint, load bigint"), "k", "load", "s", 0, 4, 4).collect()
    # 52 places after padding, of which three batches of 16 are whole
    assert sorted(r["i"] for r in found) == list(range(48))
    for b in range(3):
        loads, sizes = [0] * 4, [0] * 4
        for r in found:
            if r["batch"] == b:
                loads[r["rank"]] += rows[r["k"]][1]
                sizes[r["rank"]] += 1
        assert sizes == [4] * 4 and max(loads) - min(loads) <= 10
    few = shard.balanced_epoch(spark.createDataFrame(rows[:3], "k bigint, load bigint"), "k", "load", "s", 0, 8, 1).collect()
    assert sorted(r["i"] for r in few) == list(range(8)) and {r["k"] for r in few} == {0, 1, 2}
    assert shard.balanced_epoch(spark.createDataFrame([], "k bigint, load bigint"), "k", "load", "s", 0, 8, 1).count() == 0


def test_packing_takes_the_least_loaded_bin(spark):
    rows = [(0, i, load) for i, load in enumerate([9, 7, 6, 5, 4, 4])]
    df = spark.createDataFrame(rows, "b int, i int, load bigint")
    bins = lambda **o: {r["i"]: r["bin"] for r in shard.lpt_pack(df, "b", "i", "load", 3, **o).collect()}
    assert bins() == {0: 0, 1: 1, 2: 2, 3: 2, 5: 1, 4: 0}
    assert sorted(bins(equal_size=True).values()) == [0, 0, 1, 1, 2, 2]


def test_corners_that_are_not_there_have_no_weight(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 10.0), (0, 1, 0, 0, 20.0), (0, 1, 1, 0, 50.0)], "b int, x int, y int, z int, f double")
    points = spark.createDataFrame([(1, 0, 0.25, 0.0, 0.0), (2, 0, 0.5, 0.5, 0.0), (3, 0, -0.5, 0.0, 0.0), (4, 0, 5.0, 5.0, 5.0), (5, 1, 0.0, 0.0, 0.0), (6, 0, 1.0, 1.0, 0.0)],
                                   "k int, b int, px double, py double, pz double")
    got = {r["k"]: r["f"] for r in ragged.trilinear(points, cells, ["k"], "b", "f").collect()}
    assert got == {1: 12.5, 2: pytest.approx(80 / 3), 3: 10.0, 4: None, 5: None, 6: 50.0}


def test_only_broken_files_are_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k bigint, v string")
    good = readers.contents_of(spark, rows, str(tmp_path / "good"))
    none = readers.contents_of(spark, rows.where("false"), str(tmp_path / "none"))
    for folder, content in (("a", good), ("b", spark.range(1).select(F.lit(b"broken").alias("content"))), ("c", none)):
        entity_files.write_files(content.select(F.lit(f"{folder}/0+ä 1%.parquet").alias("name"), "content"), str(tmp_path / "parts"), "name", "content")
    found, skipped = readers.read_parts(spark, [str(tmp_path / "parts" / "*" / f) for f in "abc"], "k bigint, v string")
    assert [tuple(r) for r in found.collect()] == [(1, "a")]
    ((path, problem),) = [tuple(r) for r in skipped.collect()]
    assert path.endswith("/b/0+ä 1%.parquet") and problem.startswith("ArrowInvalid")


def test_a_cursor_is_saved_and_read(spark, tmp_path):
    path = str(tmp_path / "cursor")
    assert shard.saved_cursor(spark, path, 7) == 0
    for step in (3, 18):
        shard.save_cursor(spark, path, step, 7)
        assert shard.saved_cursor(spark, path, 7) == step


def test_numbers_for_rows_with_dotted_columns(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "`a.b` int, k int")
    found = shard.global_index(df, [F.col("k").desc()], "i")
    assert found.columns == ["a.b", "k", "i"] and {(r["k"], r["i"]) for r in found.collect()} == {(i, 19 - i) for i in range(20)}

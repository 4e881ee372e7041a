import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import series
from lodestar.streaming.series import run_to_files, series_statistics
from lodestar.streaming.state import BucketedState


def plain_limit(values, size, p, most):
    out = []
    for i in range(len(values)):
        last = [x for x in values[max(0, i - size + 1) : i + 1] if x is not None]
        out.append(min(float(np.percentile(last, p * 100)), most) if len(last) == size else None)
    return out


def plain_ema(values, rate):
    e, out = None, []
    for x in values:
        if x is not None:
            e = x if e is None else rate * e + (1 - rate) * x
        out.append(e)
    return out


def test_ordered_finds_every_rank():
    rng, held = random.Random(1), []
    ordered = series.Ordered()
    for _ in range(6000):
        if held and rng.random() < 0.45:
            x = held.pop(rng.randrange(len(held)))
            ordered.remove(x)
        else:
            x = rng.choice((rng.random(), float(rng.randrange(5))))
            held.append(x)
            ordered.add(x)
    assert [ordered.kth(k) for k in range(ordered.size)] == sorted(held)
    with pytest.raises(IndexError):
        ordered.kth(ordered.size)


@pytest.mark.parametrize("range_rows", [1, 64, 1 << 16])
def test_a_long_series_slides_in_several_tasks(spark, range_rows):
    rng = random.Random(2)
    values = {"a": [rng.random() if rng.random() > 0.01 else None for _ in range(900)], "b": [1.0] * 40, None: [float(i) for i in range(120)]}
    rows = [(k, i * 7 % 1009 + i * 1009, x, 1) for k, some in values.items() for i, x in enumerate(some)]
    df = spark.createDataFrame(rows, "s string, o long, v double, `a.b` int").repartition(5)
    found = series.rolling_limit(df, "s", "o", "v", 50, 0.95, 0.98, range_rows)
    assert found.columns == ["s", "o", "v", "a.b", "limit"]
    for k, some in values.items():
        got = [r["limit"] for r in sorted((r for r in found.collect() if r["s"] == k), key=lambda r: r["o"])] if range_rows == 64 else None
        if got is not None:
            assert got == pytest.approx(plain_limit(some, 50, 0.95, 0.98))
    # whatever the ranges, the same
    n, total = found.agg(F.count("limit"), F.round(F.sum("limit"), 9)).first()
    want = [x for some in values.values() for x in plain_limit(some, 50, 0.95, 0.98) if x is not None]
    assert n == len(want) and total == pytest.approx(sum(want))


@pytest.mark.parametrize("range_rows", [3, 50, 1 << 16])
def test_average_at_every_step_over_ranges_of_ranges(spark, range_rows):
    rng = random.Random(3)
    values = {"a": [rng.random() for _ in range(400)], None: [2.0, 4.0]}
    rows = [(k, i, x) for k, some in values.items() for i, x in enumerate(some)] + [("a", 1000, None), ("c", 1, None)]
    found = series.ema_steps(spark.createDataFrame(rows, "s string, o long, v double").repartition(3), "s", "o", "v", 0.97, range_rows).collect()
    for k, some in values.items():
        got = [r["ema"] for r in sorted((r for r in found if r["s"] == k), key=lambda r: r["o"])]
        assert got == pytest.approx(plain_ema(some, 0.97), rel=1e-12)
    assert len(found) == 402


def test_a_million_steps_keep_their_weight(spark):
    """One series of 10^6 steps in 16 tasks: no weight underflows, and the last steps count as they should."""
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("s").alias("s"), F.col("id").alias("o"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    found = series.ema_steps(df, "s", "o", "v", 0.999)
    last = [r["v"] for r in df.where("o >= 980000").orderBy("o").collect()]
    e = 0.0
    for x in last:
        e = 0.999 * e + 0.001 * x
    n, low, end = found.agg(F.count("*"), F.min("ema"), F.max_by("ema", "o")).first()
    assert n == 1_000_000 and low >= 0 and end == pytest.approx(e, rel=1e-6)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


SCHEMA = "user_id bigint, event_id bigint, ts timestamp, value double"


def test_state_outlives_restarts_and_a_replayed_batch(spark, tmp_path):
    """Rows in slices of time: ended after each, killed within one, and gone on from the checkpoint."""
    import datetime

    base = datetime.datetime(2024, 1, 1)
    rng = random.Random(4)
    rows, at = [], dict.fromkeys(range(3), 0)
    for _ in range(90):
        user = rng.randrange(3)
        at[user] += rng.choice((10, 20, 4000))
        rows.append((user, at[user], None if rng.random() < 0.1 else round(rng.random(), 3)))
    rows.sort(key=lambda r: r[1])
    whole = [(u, i, base + datetime.timedelta(seconds=s), x) for i, (u, s, x) in enumerate(rows)]
    path = str(tmp_path)

    def run(lost=False):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        found = series_statistics(stream, "user_id", "event_id", "ts", "value", 5, 0.9, 9.0, 0.8, 3600 * 1_000_000)
        if lost:  # after the state was changed, before the batch is done
            found = found.withColumn("ema", F.raise_error(F.lit("lost")).cast("double"))
        return run_to_files(spark, found, f"{path}/out", f"{path}/cp")

    for number, cut in enumerate((0, 30, 60)):
        spark.createDataFrame(whole[cut : cut + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if number == 1:  # a batch that fails on the way is run again from the state before it
            with pytest.raises(Exception, match="lost"):
                run(lost=True)
        run()
    found = {r["place"]: (r["ema"], r["limit"]) for r in spark.read.parquet(f"{path}/out").collect()}
    assert len(found) == 90 == spark.read.parquet(f"{path}/out").count()
    for user in range(3):
        own = [r for r in whole if r[0] == user]
        cuts = [0, *(i for i in range(1, len(own)) if (own[i][2] - own[i - 1][2]).total_seconds() > 3600), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            values = [r[3] for r in own[a:b]]
            want = list(zip(plain_ema(values, 0.8), plain_limit(values, 5, 0.9, 9.0)))
            for r, (ema, limit) in zip(own[a:b], want):
                got = found[r[1]]
                assert (got[0], got[1]) == (pytest.approx(ema) if ema is not None else None, pytest.approx(limit) if limit is not None else None)


def test_idle_state_is_freed_by_its_timer(spark, tmp_path):
    import datetime

    base = datetime.datetime(2024, 1, 1)
    path = str(tmp_path)
    for i, (user, hours) in enumerate(((1, 0), (2, 30), (2, 60))):
        spark.createDataFrame([(user, i, base + datetime.timedelta(hours=hours), 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        query = run_to_files(spark, series_statistics(stream, "user_id", "event_id", "ts", "value", 5, 0.9, 9.0, 0.8, 3600 * 1_000_000), f"{path}/out", f"{path}/cp")
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # the last series alone: its state and its timer's two rows


# --- the bucketed registry -----------------------------------------------------------------


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path), "k bigint, a double, b string", "k", buckets=16, most_deltas=2)
    assert state.read().count() == 0
    want = {}

    def fold(number, rows):
        state.fold(spark.createDataFrame(rows, "k bigint, a double, b string, o bigint"), number, "o")
        for k, a, b, _ in sorted(rows, key=lambda r: -r[3]):
            if k is not None:
                old = want.get(k, (None, None))
                want[k] = (old[0] if a is None else a, old[1] if b is None else b)
        assert {r["k"]: (r["a"], r["b"]) for r in state.read().collect()} == want

    fold(0, [(k, float(k), None, 0) for k in range(200)] + [(None, 1.0, "x", 0)])
    before = files(tmp_path)
    fold(1, [(7, None, "new", 0), (7, 5.0, "second", 1)])
    added = files(tmp_path) - before
    assert len(added) == 1 and before <= files(tmp_path)  # one bucket, one file
    touched = next(iter(added)).split("bucket=")[1].split("/")[0]
    fold(2, [(7, None, "newer", 0)])  # the third generation of that bucket: it alone is rewritten
    manifest = state.latest()
    assert len(manifest.buckets[touched]) == 1 and all(g == [0] for b, g in manifest.buckets.items() if b != touched)
    kept = {f for f in before if f"bucket={touched}/" not in f}
    assert kept <= files(tmp_path) and len(kept) == 15
    again = manifest.number
    state.fold(spark.createDataFrame([(7, 99.0, "replayed", 0)], "k bigint, a double, b string, o bigint"), 1, "o")
    assert state.latest().number == again and {r["k"]: (r["a"], r["b"]) for r in state.read().collect()} == want
    for number in range(3, 9):
        fold(number, [(7, float(number), None, 0), (number * 50, None, "far", 0)])
    assert len(os.listdir(tmp_path / "manifests")) <= 4 and kept & files(tmp_path)


def test_a_batch_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    state = BucketedState(spark, str(tmp_path), "k bigint, a double", "k", buckets=4)
    rows = lambda a: spark.createDataFrame([(k, a) for k in range(10)], "k bigint, a double")
    state.fold(rows(1.0), 0)
    with monkeypatch.context() as m:
        m.setattr(BucketedState, "_swap", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.fold(rows(2.0), 1)
    assert {r["a"] for r in state.read().collect()} == {1.0}
    state.fold(rows(3.0), 1)
    assert [r["a"] for r in state.read().collect()] == [3.0] * 10

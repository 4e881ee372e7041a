"""Streams and long series over `events`: state stores, incremental registries and windows of any width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import series
from lodestar.plans.base import Tables, query
from lodestar.sources.scratch import shared_folder
from lodestar.streaming.series import run_to_files, series_statistics
from lodestar.streaming.state import BucketedState

#: A user's series begins anew after this gap.
_IDLE_HOURS = 12


@query(f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL {_IDLE_HOURS} HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT user_id, event_id, list(value) OVER (w ROWS UNBOUNDED PRECEDING) AS every, count(*) OVER last AS n, quantile_cont(value, 0.95) OVER last AS p FROM s
      WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id), last AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS 3 PRECEDING))
SELECT user_id AS series, event_id AS place, round(list_reduce(every, lambda e, x: 0.9::DOUBLE * e + (1 - 0.9::DOUBLE) * x), 6)::DOUBLE AS ema,
       CASE WHEN n = 4 THEN round(least(p, 90.0), 6) END AS "limit" FROM r
""")
def streamed_series(t: Tables) -> DataFrame:
    """Events come in three slices of time; the stream ends after each and goes on from its checkpoint."""
    path = shared_folder(t.spark, "streamed")
    hours = F.unix_timestamp(F.col("ts").cast("timestamp"))
    low, high = t.events.agg(F.min(hours), F.max(hours)).first()
    if low is None:
        low = high = 0
    slices = t.events.withColumn("slice", F.least(F.lit(2), F.floor((hours - low) * 3 / max(high - low, 1))))
    for i in range(3):
        slices.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(t.events.schema).parquet(f"{path}/in")
        found = series_statistics(stream, "user_id", "event_id", "ts", "value", 4, 0.95, 90.0, 0.9, _IDLE_HOURS * 3_600_000_000)
        run_to_files(t.spark, found, f"{path}/out", f"{path}/checkpoint")
    out = t.spark.read.schema("series bigint, place bigint, ema double, limit double").parquet(f"{path}/out")
    return out.select("series", "place", F.round("ema", 6).alias("ema"), F.round("limit", 6).alias("limit"))


@query("""
WITH r AS (SELECT user_id, (4 - event_id % 5) * 1000000000000 + event_id AS age, CASE WHEN event_id % 3 <> 0 THEN value END AS value,
           CASE WHEN event_id % 4 <> 0 THEN event_type END AS event_type FROM events WHERE user_id IS NOT NULL)
SELECT user_id, arg_min(value, age) FILTER (WHERE value IS NOT NULL) AS value, arg_min(event_type, age) FILTER (WHERE event_type IS NOT NULL) AS event_type
FROM r GROUP BY user_id
""")
def incremental_registry(t: Tables) -> DataFrame:
    """Five batches of records; the third is run again after the fourth, and buckets are compacted on the way."""
    path, schema = shared_folder(t.spark, "registry"), "user_id bigint, value double, event_type string"
    part = lambda i: t.events.where(F.col("event_id") % 5 == i).select(
        "user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("event_type")
    )
    state = BucketedState(t.spark, f"{path}/state", schema, "user_id", buckets=8, most_deltas=2)
    for i in range(5):
        part(i).write.mode("append").parquet(f"{path}/in")
        state.stream(t.spark.readStream.schema(f"{schema}, event_id bigint").parquet(f"{path}/in"), f"{path}/checkpoint", "event_id")
        if i == 3:
            state.fold(part(2), 2, "event_id")
    return state.read()


@query("""
WITH r AS (SELECT event_type, event_id, count(value) OVER w AS n, quantile_cont(value, 0.95) OVER w AS p FROM events
           WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
SELECT event_type, event_id, CASE WHEN n = 1000 THEN round(least(p, 90.0), 6) END AS "limit" FROM r
""")
def rolling_p95_of_1000(t: Tables) -> DataFrame:
    rows = series.rolling_limit(t.events.select("event_type", "event_id", "value"), "event_type", "event_id", "value", 1000, 0.95, 90.0)
    return rows.select("event_type", "event_id", F.round("limit", 6).alias("limit"))


@query("""
WITH l AS (SELECT event_type, event_id, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS every FROM events)
SELECT event_type, event_id, round(list_reduce(every, lambda e, x: 0.9::DOUBLE * e + (1 - 0.9::DOUBLE) * x), 6)::DOUBLE AS ema FROM l
""")
def ema_every_step(t: Tables) -> DataFrame:
    out = series.ema_steps(t.events.select("event_type", "event_id", "value"), "event_type", "event_id", "value", 0.9)
    return out.select("event_type", "event_id", F.round("ema", 6).alias("ema"))

"""Training-run telemetry over `events`: value as loss, user_id as series, props as nested log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import flow, text
from lodestar.operators import telemetry as tm
from lodestar.plans.base import Tables, query
from lodestar.streaming import windows

_EDGES = ", ".join(repr(e) for e in tm.TIME_EDGES)


@query(f"""
WITH e AS (SELECT [{_EDGES}]::DOUBLE[] AS edges), r AS (SELECT value / 100 AS loss, (event_id % 101) / 100.0::DOUBLE AS t FROM events),
b AS (SELECT loss, len(list_filter(edges, lambda x: x <= t)) - 1 AS bin FROM r, e)
SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(loss), 6) AS loss FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY bin
""")
def time_bin_loss(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("value") / 100).alias("loss"), ((F.col("event_id") % 101) / 100.0).alias("t"))
    return tm.binned_loss(rows, "t", "loss").withColumn("loss", F.round("loss", 6))


_FLAT = """l AS (SELECT event_id, 'loss.' || event_type AS key, value FROM events UNION ALL
  SELECT event_id, 'props.k', (props->>'k')::DOUBLE FROM events WHERE props->>'k' IS NOT NULL)"""


def _log(t: Tables) -> DataFrame:
    """Nested records {"loss": {type: value}, "props": {...}}, flattened to entries."""
    record = F.to_json(F.struct(F.create_map("event_type", F.col("value")).alias("loss"), F.from_json("props", "map<string,double>").alias("props")))
    return t.events.select("event_id", F.explode(text.flat_entries(record)).alias("e")).select("event_id", "e.key", "e.value").where("value is not null")


@query(f"WITH {_FLAT} SELECT event_id, key, round(value, 6) AS value FROM l WHERE value IS NOT NULL")
def log_flatten(t: Tables) -> DataFrame:
    return _log(t).withColumn("value", F.round("value", 6))


@query(f'WITH {_FLAT} SELECT key, round(avg(value), 5) AS mean, round(min(value), 5) AS "min", round(max(value), 5) AS "max" FROM l WHERE value IS NOT NULL GROUP BY key')
def log_reduce(t: Tables) -> DataFrame:
    out = tm.log_means(_log(t), ["key"])
    return out.select("key", *(F.round(c, 5).alias(c) for c in ("mean", "min", "max")))


@query("""
WITH l AS (SELECT user_id AS step, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM events)
SELECT count(*) AS n, round(avg(value), 6) AS mean FROM l WHERE step NOT IN (SELECT step FROM l WHERE isnan(value))
""")
def log_drop_nan(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("step"), F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return tm.without_nan_steps(rows, "step").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""
WITH r AS (SELECT user_id, event_id, value, count(value) OVER w AS n, quantile_cont(value, 0.95) OVER w AS p FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, CASE WHEN n = 5 THEN round(least(p, 90.0), 6) END AS "limit" FROM r
""")
def rolling_p95_clip(t: Tables) -> DataFrame:
    rows = tm.rolling_limit(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value", 5, 0.95, 90.0)
    return rows.select("user_id", "event_id", F.round("limit", 6).alias("limit"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * pow(0.9, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 1 - 0.9 END), 6) AS ema FROM r GROUP BY user_id
""")
def ema_closed_form(t: Tables) -> DataFrame:
    return tm.ema(t.events, "user_id", "event_id", "value", 0.9).withColumn("ema", F.round("ema", 6))


@query("""
SELECT user_id, event_id, round(20 + sum(CASE WHEN value < 95 THEN 0.001::DOUBLE ELSE -1 END) OVER w, 6) AS scale,
       20 + sum(CASE WHEN value < 95 THEN 0.001::DOUBLE ELSE -1 END) OVER w < 0 AS aborted
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def grad_scale_walk(t: Tables) -> DataFrame:
    rows = tm.grad_scale(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") < 95, 0.001, 20.0)
    return rows.select("user_id", "event_id", F.round("scale", 6).alias("scale"), "aborted")


@query("""
WITH r AS (SELECT user_id, event_id, event_id * 0.5::DOUBLE AS elapsed FROM events),
s AS (SELECT user_id, event_id, (event_id - lag(event_id) OVER w) / nullif(elapsed - lag(elapsed) OVER w, 0) AS speed FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(speed, 6) AS speed, round((1000000 - event_id) / nullif(speed, 0), 6) AS eta FROM s
""")
def speed_eta(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", (F.col("event_id") * F.lit(0.5)).alias("elapsed"))
    out = tm.speed(rows, "user_id", "event_id", "elapsed", 1_000_000)
    return out.select("user_id", "event_id", F.round("speed", 6).alias("speed"), F.round("eta", 6).alias("eta"))


@query("SELECT event_type, round(regr_slope(value, event_id), 9) AS slope, round(regr_intercept(value, event_id), 6) AS intercept FROM events GROUP BY event_type")
def linear_fit(t: Tables) -> DataFrame:
    out = tm.linear_fit(t.events, ["event_type"], "value", "event_id")
    return out.select("event_type", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""
WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE - x[2]::DOUBLE) AS d
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, list_sum(list_transform(d, lambda x: x * x)) / len(d) AS mse, list_sum(list_transform(d, lambda x: abs(x))) / len(d) AS l1,
      list_sum(list_transform(d, lambda x: CASE WHEN abs(x) < 1 THEN 0.5 * x * x ELSE abs(x) - 0.5 END)) / len(d) AS smooth_l1 FROM p)
SELECT vec_id, round(mse, 6) AS mse, round(l1, 6) AS l1, round(smooth_l1, 6) AS smooth_l1, round(20 * log10(1 / sqrt(mse)), 5) AS psnr FROM m
""")
def mse_l1_psnr_smooth_l1(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    found = tm.pair_losses(F.col("a"), F.col("b"))
    return a.join(b, "vec_id").select("vec_id", *(F.round(v, 5 if k == "psnr" else 6).alias(k) for k, v in found.items()))


@query("""
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, (vec_id % 2)::DOUBLE AS y FROM embeddings),
s AS (SELECT *, 1 / (1 + exp(-x)) AS p FROM e)
SELECT label, round(avg(greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x)))), 6) AS bce,
       round(1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1), 6) AS dice, round(avg(0.5 * (x * x + exp(y) - y - 1)), 6) AS kl FROM s GROUP BY label
""")
def bce_dice_kl(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", F.explode("embedding").alias("x"), (F.col("vec_id") % 2).cast("double").alias("y")).withColumn("x", F.col("x").cast("double"))
    x, y, p = F.col("x"), F.col("y"), 1 / (1 + F.exp(-F.col("x")))
    dice = 1 - (2 * F.sum(p * y) + 1) / (F.sum(p) + F.sum(y) + 1)
    return rows.groupBy("label").agg(
        F.round(F.avg(tm.bce_with_logits(x, y)), 6).alias("bce"), F.round(dice, 6).alias("dice"), F.round(F.avg(tm.kl_to_unit(x, y)), 6).alias("kl")
    )


@query("SELECT event_id, least(1.0, (event_id + 1) / 1000.0)::DOUBLE AS lr, round(least(0.9, greatest(0.0, (value * 0.5 - 3) / (2 * 7))), 9)::DOUBLE AS ratio FROM events")
def warm_up_and_memory(t: Tables) -> DataFrame:
    ratio = flow.memory_ratio(F.col("value"), 0.5, F.lit(2), F.lit(3), F.lit(7), 0.9)
    return t.events.select("event_id", flow.warm_up(F.col("event_id"), 1000).alias("lr"), F.round(ratio, 9).alias("ratio"))


@query("""
SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL
""")
def events_hourly(t: Tables) -> DataFrame:
    """The batch form of the streaming aggregate (an extension beyond the reference)."""
    return windows.tumbling(t.events, "1 hour").select("event_type", "start", "n", F.round("total", 6).alias("total"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, grouping(event_type)::INTEGER AS all_types FROM events GROUP BY ROLLUP (CAST(ts AS DATE), event_type)")
def events_rollup(t: Tables) -> DataFrame:
    """Subtotals per day and over all (an extension beyond the reference)."""
    rows = t.events.withColumn("day", F.to_date("ts"))
    return rows.rollup("day", "event_type").agg(F.count("*").alias("n"), F.grouping("event_type").cast("int").alias("all_types"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k
""")
def event_sessions(t: Tables) -> DataFrame:
    """Runs of a user's events with gaps below half an hour (an extension beyond the reference)."""
    out = windows.sessions(t.events, "30 minutes")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")

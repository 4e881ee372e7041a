"""Training-run statistics: logs, rolling limits, averages and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Right-open bins between these edges; 1.0 itself falls into none. The sums
#: i * 0.1 in floating point, whose errors decide where 0.3, 0.6 and 0.7 fall.
TIME_EDGES = tuple(i * 0.1 for i in range(10)) + (1.0,)


def time_bin(t: Column) -> Column:
    """How many edges are at most t, less one: 0 to 9 in range, null outside."""
    n = sum(((t >= F.lit(e)).cast("int") for e in TIME_EDGES), F.lit(0)) - 1
    return F.when(n.between(0, 9), n)


def binned_loss(df: DataFrame, t: str, loss: str) -> DataFrame:
    rows = df.withColumn("bin", time_bin(F.col(t))).where("bin is not null")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(loss).alias("loss"))


def log_means(entries: DataFrame, by: list[str]) -> DataFrame:
    """Per key the mean, least and greatest value over the logs that have it."""
    return entries.groupBy(*by).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def without_nan_steps(entries: DataFrame, step: str) -> DataFrame:
    """Drops whole log steps that hold any NaN."""
    bad = entries.where(F.isnan("value")).select(step).distinct()
    return entries.join(bad, step, "left_anti")


def rolling_limit(df: DataFrame, by: str, order: str, value: str, size: int, percentile: float, most: float) -> DataFrame:
    """Adds the percentile of the last `size` values, capped; null until the buffer is full."""
    last = Window.partitionBy(by).orderBy(order).rowsBetween(-(size - 1), 0)
    p = F.least(F.percentile(value, F.lit(percentile)).over(last), F.lit(most))
    return df.withColumn("limit", F.when(F.count(value).over(last) == size, p))


def ema(df: DataFrame, by: str, order: str, value: str, rate: float) -> DataFrame:
    """Per series the exponential moving average e = rate e + (1 - rate) x, from the first value.

    In closed form the i-th of n values weighs (1 - rate) rate^(n - i), the first rate^(n - 1):
    one pass of sums instead of a recursion.
    """
    w = Window.partitionBy(by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(by))
    ranked = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
    weight = F.pow(F.lit(rate), F.col("_n") - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(1 - rate)
    return ranked.groupBy(by).agg(F.sum(weight * F.col(value)).alias("ema"))


def grad_scale(df: DataFrame, by: str, order: str, finite: Column, growth: float, start: float) -> DataFrame:
    """The log2 loss scale after each step: up by `growth` on finite gradients, down by 1 else."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(finite, F.lit(growth)).otherwise(F.lit(-1.0))
    return df.withColumn("scale", F.lit(start) + F.sum(step).over(w)).withColumn("aborted", F.col("scale") < 0)


def speed(df: DataFrame, by: str, step: str, elapsed: str, total: int) -> DataFrame:
    """Steps per second since the previous report and the seconds that remain."""
    w = Window.partitionBy(by).orderBy(step)
    rate = (F.col(step) - F.lag(step).over(w)) / F.nullif(F.col(elapsed) - F.lag(elapsed).over(w), F.lit(0.0))
    return df.withColumn("speed", rate).withColumn("eta", (F.lit(total) - F.col(step)) / F.nullif(F.col("speed"), F.lit(0.0)))


def linear_fit(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def pair_losses(a: Column, b: Column, beta: float = 1.0) -> dict[str, Column]:
    """Mean squared, absolute and smooth absolute error of two arrays, and PSNR for a peak of 1."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    mean = lambda f: F.aggregate(F.transform(d, f), F.lit(0.0), lambda s, x: s + x) / F.size(d)
    mse = mean(lambda x: x * x)
    smooth = mean(lambda x: F.when(F.abs(x) < beta, 0.5 * x * x / beta).otherwise(F.abs(x) - 0.5 * beta))
    return {"mse": mse, "l1": mean(F.abs), "smooth_l1": smooth, "psnr": 20 * F.log10(1 / F.sqrt(mse))}


def bce_with_logits(x: Column, y: Column) -> Column:
    """max(x, 0) - x y + log(1 + exp(-|x|)), stable for any logit."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def kl_to_unit(mean: Column, logvar: Column) -> Column:
    return 0.5 * (mean * mean + F.exp(logvar) - logvar - 1)


def norms(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the Euclidean norm over all its values."""
    return df.groupBy(*by).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def ranks_disagree(df: DataFrame, rank: str, norm: str, tolerance: float = 1e-3) -> DataFrame:
    """One row: whether any rank's norm is off from the first rank's by more than the tolerance."""
    first = F.min_by(norm, rank)
    spread = F.greatest(F.abs(F.max(norm) - first), F.abs(F.min(norm) - first))
    return df.agg(first.alias("reference"), (spread / first).alias("off"), (spread / first > tolerance).alias("disagree"))


def normal_angle(df: DataFrame, by: list[str], a: tuple[str, str, str], b: tuple[str, str, str]) -> DataFrame:
    """by, angle: mean angle in degrees between normals stored as colours in 0..1; -1 where none has a length."""
    u, v = ([F.col(c) * 2 - 1 for c in names] for names in (a, b))
    dot = lambda x, y: sum((p * q for p, q in zip(x, y)), F.lit(0.0))
    size = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (size + 1e-9)))
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(size > 1e-9, F.degrees(F.acos(cosine)))), F.lit(-1.0)).alias("angle"))


def parameter_counts(df: DataFrame, shape: str, trainable: str) -> DataFrame:
    """One row: the numbers of all and of trainable parameters of tensors given by their shapes."""
    n = F.aggregate(shape, F.lit(1).cast("bigint"), lambda s, x: s * x)
    return df.agg(F.sum(n).alias("n_params"), F.sum(F.when(F.col(trainable), n).otherwise(0)).alias("n_trainable"))

"""Sliding statistics over a stream: each series' ring buffer and average live in Spark's state store.

A series is one key of the store. Its state is read and written once a micro-batch; within the batch
its rows are taken in order. A gap of more than `idle` begins a series anew; a timer on event time
frees the state of series that have been silent for so long, which changes no result, since whatever comes later
comes after the gap. So results do not depend on how the stream was cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestar.operators.series import Rolling

_STATE = "ring array<double>, ema double, last bigint, timer bigint"
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SeriesProcessor(StatefulProcessor):
    """place, ema and limit of every row, as Rolling and the recursion e = rate e + (1 - rate) x give them."""

    def __init__(self, size: int, percentile: float, most: float, rate: float, idle_us: int) -> None:
        self.size, self.percentile, self.most, self.rate, self.idle = size, percentile, most, rate, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "place"], kind="stable")
        ring, ema, last, timer = self.state.get() if self.state.exists() else ([], None, None, None)
        rolling = Rolling(self.size, self.percentile, self.most, ring)
        averages, limits = [], []
        for at, x in zip(batch["at"].tolist(), batch["value"].tolist()):
            if last is not None and at - last > self.idle:
                rolling, ema = Rolling(self.size, self.percentile, self.most), None
            last = at
            x = None if x != x else x
            limits.append(rolling.push(x))
            if x is not None:
                ema = x if ema is None else self.rate * ema + (1 - self.rate) * x
            averages.append(ema)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (last + self.idle) // 1000 + 1
        self.handle.registerTimer(timer)
        self.state.update((list(rolling.ring), ema, last, timer))
        yield pd.DataFrame({"series": key[0], "place": batch["place"].to_numpy(), "ema": pd.array(averages, "Float64"), "limit": pd.array(limits, "Float64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def series_statistics(stream: DataFrame, by: str, order: str, ts: str, value: str, size: int, percentile: float, most: float, rate: float, idle_us: int,
                      late: str = "0 seconds") -> DataFrame:
    """series, place, ema and limit for each row of a stream; rows later than the watermark are dropped, as the store must."""
    when = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(by).alias("series"), F.col(order).alias("place"), when.alias("ts"), F.unix_micros(when).alias("at"), F.col(value).cast("double").alias("value"))
    types = dict(rows.dtypes)
    schema = f"series {types['series']}, place {types['place']}, ema double, limit double"
    processor = SeriesProcessor(size, percentile, most, rate, idle_us)
    return rows.withWatermark("ts", late).groupBy("series").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def run_to_files(spark: SparkSession, statistics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come in since the checkpoint, and ends; a later call goes on from there."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        query = statistics.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STORE[0])
        else:
            spark.conf.set(_STORE[0], before)
    return query

"""Incremental registry merge: new stage records are folded into a state table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestar.operators.merge import merge_first
from lodestar.sources.readers import exists


def fold_records(spark: SparkSession, new_records: str, schema: StructType, key: str, state: str, checkpoint: str) -> StreamingQuery:
    """Reads record files as they come; newer values beat older ones, per column, nulls never.

    A batch's state goes to a folder of its own number, written from that of the last batch
    before it. A batch that is run again after a failure writes the same folder from the same
    input, so records count once. The offsets in `checkpoint` take the place of moving files.
    """
    stream = spark.readStream.schema(schema).option("ignoreCorruptFiles", "true").parquet(new_records)

    def fold(batch: DataFrame, number: int) -> None:
        previous = f"{state}/batch={number - 1}"
        if number and not exists(spark, previous):
            raise FileNotFoundError(f"the state before batch {number} is lost: {previous}")
        frames = [spark.read.schema(schema).parquet(previous)] if number else []
        # of several records of a key in one batch the first non-null value counts, in row order
        rows = batch.withColumn("_row", F.monotonically_increasing_id())
        merged = merge_first([*frames, _first_rows(rows, key)], key, existing_wins=False)
        merged.select(*schema.names).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _first_rows(rows: DataFrame, key: str) -> DataFrame:
    from lodestar.operators.merge import first_non_null

    return first_non_null(rows, key, "_row")


def latest_state(spark: SparkSession, state: str) -> DataFrame:
    """The state after the last batch."""
    rows = spark.read.option("basePath", state).parquet(f"{state}/batch=*")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")

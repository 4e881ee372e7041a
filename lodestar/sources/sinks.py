"""Sinks: partitioned tables, stage parts, error lists and flat reports, by committing writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """A Parquet table, laid out by the columns that later reads prune on."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_part(df: DataFrame, path: str, ingest_ts: int) -> None:
    """A stage's new records under their ingest time; consuming them is a filter, not a move."""
    df.withColumn("ingest_ts", F.lit(ingest_ts)).write.mode("append").partitionBy("ingest_ts").parquet(path)


def write_log(entries: DataFrame, path: str, run: int) -> None:
    """A run's log entries (step, key, value); a run that writes again replaces what it wrote, and no other run's."""
    entries.select("step", "key", "value").write.mode("overwrite").parquet(f"{path}/run={run}")


def error_keys(results: DataFrame, key: str = "sha256") -> DataFrame:
    """Keys of the workers' results that carry an error."""
    return results.where(F.col("error").isNotNull()).select(key)


def as_metrics(one_row: DataFrame) -> DataFrame:
    """A one-row aggregate as (metric, value) rows."""
    names = one_row.columns
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))
    return one_row.select(F.explode(pairs).alias("m")).select("m.*")


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with a header; empty frames keep theirs."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def ply_lines(vertices: DataFrame, faces: DataFrame, key: str = "sha256") -> DataFrame:
    """key, ply: one ASCII PLY text per mesh; the counts come first, rows are in index order."""
    v = vertices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("v_idx", "x", "y", "z"))).alias("v"))
    f = faces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f_idx", "v0", "v1", "v2"))).alias("f"))
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["z"].cast("string"))
    face = lambda t: F.concat_ws(" ", F.lit("3"), t["v0"].cast("string"), t["v1"].cast("string"), t["v2"].cast("string"))
    no_faces = F.expr("CAST(array() AS array<struct<f_idx:int,v0:int,v1:int,v2:int>>)")
    meshes = v.join(f, key, "left").withColumn("f", F.coalesce("f", no_faces))
    header = F.array(
        F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.size("v").cast("string")),
        *(F.lit(f"property float {c}") for c in "xyz"), F.concat(F.lit("element face "), F.size("f").cast("string")),
        F.lit("property list uchar int vertex_indices"), F.lit("end_header"),
    )
    return meshes.select(key, F.array_join(F.concat(header, F.transform("v", point), F.transform("f", face)), "\n").alias("ply"))

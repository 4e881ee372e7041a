"""Queries over sources and sinks: tables are written, read again and compared; and the row worker."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import flow, geometry, text
from lodestar.operators import merge, ragged, select, worker
from lodestar.plans.base import Tables, query
from lodestar.sources import entity_files, readers, sinks
from lodestar.sources.scratch import shared_folder


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS score FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "csv")
    score = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    sinks.write_csv(t.customer.select("c_custkey", "c_name", score.alias("score")), path)
    return readers.read_table(t.spark, path, "c_custkey bigint, c_name string, score double")


@query("SELECT s_suppkey, s_name, true AS there FROM supplier")
def missing_tables(t: Tables) -> DataFrame:
    path, schema = shared_folder(t.spark, "optional"), "s_suppkey bigint, s_name string"
    sinks.write_table(t.supplier.select("s_suppkey", "s_name"), f"{path}/there")
    found = [readers.read_optional(t.spark, f"{path}/{name}", schema, "parquet").withColumn("there", F.lit(name == "there")) for name in ("there", "missing")]
    return found[0].unionByName(found[1])


@query("SELECT 'row' AS kind, s_suppkey AS id FROM supplier UNION ALL SELECT 'skipped b/part 0.parquet', 1")
def tolerant_parts(t: Tables) -> DataFrame:
    """A good part, a broken one of the same name, and a part without rows."""
    path, schema = shared_folder(t.spark, "parts"), "s_suppkey bigint, s_name string"
    rows = t.supplier.select("s_suppkey", "s_name").coalesce(1)
    contents = readers.contents_of(t.spark, rows, f"{path}/made/all"), readers.contents_of(t.spark, rows.where("false"), f"{path}/made/none")
    broken = t.spark.range(1).select(F.lit(b"no table").alias("content"))
    for folder, content in (("a", contents[0]), ("b", broken), ("c", contents[1])):
        entity_files.write_files(content.select(F.lit(f"{folder}/part 0.parquet").alias("name"), "content"), f"{path}/parts", "name", "content")
    found, skipped = readers.read_parts(t.spark, [f"{path}/parts/*/{folder}" for folder in "abc"], schema)
    told = skipped.groupBy(F.concat(F.lit("skipped "), F.regexp_extract("path", "[^/]+/[^/]+$", 0)).alias("kind")).agg(F.count("*").alias("id"))
    return found.select(F.lit("row").alias("kind"), F.col("s_suppkey").alias("id")).unionAll(told)


@query("""
WITH p AS (SELECT page_id, url, regexp_replace(split_part(url, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages)
SELECT 'k' || a.page_id::VARCHAR AS sha256, b.url AS local_path FROM p a JOIN p b USING (stem) WHERE a.stem <> ''
""")
def file_matches(t: Tables) -> DataFrame:
    name = F.element_at(F.split("url", "/"), -1)
    files = t.pages.select(F.col("url").alias("path"), readers.stem(name).alias("stem"))
    registry = t.pages.select(F.concat(F.lit("k"), "page_id").alias("sha256"), F.concat(F.lit("set/"), readers.stem(name), F.lit(".glb")).alias("file_identifier"))
    return readers.match_files(files, registry)


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_nationkey % 2 = 1)")
def keys_without_files(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "listing")
    sinks.write_table(t.supplier.where("s_nationkey % 2 = 1"), path, ("s_nationkey",))
    done = readers.listed_values(t.spark, path, "s_nationkey").select(F.col("s_nationkey").cast("int").alias("n_nationkey"))
    return t.nation.select("n_nationkey").join(done, "n_nationkey", "left_anti")


@query("SELECT DISTINCT 'file' AS spec, n_name AS key FROM nation UNION ALL SELECT 'list', unnest(['FRANCE', 'PERU'])")
def key_specs(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "keys")
    lines = t.nation.select(F.explode(F.array(F.concat(F.lit("  set/"), "n_name"), F.lit("# a comment"), F.lit(" "))).alias("value"))
    lines.write.text(path)
    keys = [readers.read_key_list(t.spark, path).select(F.lit("file").alias("spec"), "key"), readers.keys_of(t.spark, "FRANCE,PERU").select(F.lit("list").alias("spec"), "key")]
    return keys[0].unionAll(keys[1])


@query("""
SELECT page_id, v.view_idx::INTEGER AS view_idx, CASE WHEN v.view_idx = 1 THEN 0.5 ELSE page_id % 3 + 0.25 END::DOUBLE AS camera_angle_x
FROM pages, (VALUES (0), (1)) v(view_idx)
""")
def view_documents(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "documents")
    frame = lambda angle: F.struct(F.lit("a.png").alias("file_path"), angle.cast("double").alias("camera_angle_x"))
    rows = t.pages.select("page_id", (F.col("page_id") % 3 + 0.25).alias("camera_angle_x"), F.array(frame(F.lit(None)), frame(F.lit(0.5))).alias("frames"))
    rows.write.json(path)
    schema = "page_id bigint, camera_angle_x double, frames array<struct<file_path:string,camera_angle_x:double>>"
    return readers.frames_of(readers.nan_to_null(t.spark.read.schema(schema).json(path)), required=True).select("page_id", "view_idx", "camera_angle_x")


@query("SELECT o_orderkey, o_orderkey % 3 AS ingest_ts, o_orderkey % 3 > 0 AS fresh FROM orders")
def parts_consumed(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "stage")
    for ts in range(3):
        sinks.append_part(t.orders.where(F.col("o_orderkey") % 3 == ts).select("o_orderkey"), path, ts)
    fresh = readers.parts_after(t.spark, path, "o_orderkey bigint", 0).withColumn("fresh", F.lit(True))
    every = readers.parts_after(t.spark, path, "o_orderkey bigint", None)
    return every.join(fresh, ["o_orderkey", "ingest_ts"], "left").select("o_orderkey", "ingest_ts", F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_acctbal >= 100 AND c_acctbal <= 9000")
def bounds_drop_missing(t: Tables) -> DataFrame:
    gaps = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal"))
    rows = t.customer.withColumn("score", gaps)
    return rows.where(select.at_least("score", 100) & select.at_most("score", 9000)).select("c_custkey")


@query("""
SELECT 'has' AS which, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'falls back', doc_id FROM labels WHERE toxic = 1
UNION ALL SELECT 'neither', doc_id FROM labels
""")
def filter_if_column(t: Tables) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    rows = {"has": select.if_column(t.labels, "quality", good), "falls back": select.if_column(t.labels.drop("quality"), "quality", good, toxic), "neither": select.if_column(t.labels.drop("quality"), "quality", good)}
    one, two, three = (df.select(F.lit(name).alias("which"), "doc_id") for name, df in rows.items())
    return one.unionAll(two).unionAll(three)


@query("SELECT doc_id, quality AS quality_256, toxic AS toxic_256 FROM labels")
def renamed_by_resolution(t: Tables) -> DataFrame:
    there = select.with_suffix(t.labels, ["quality", "toxic"], 256)
    return select.with_suffix(select.without_suffix(there, 256), ["quality", "toxic"], 256)


@query("SELECT d.doc_id, coalesce(toxic, 0) AS toxic, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def default_if_missing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in (("toxic", 0), ("quality", -1))))


@query("SELECT (SELECT count(toxic) FROM labels) AS first, (SELECT count(quality) FROM labels) AS second, (SELECT count(*) FROM labels) AS rows")
def metric_fallback(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(select.first_available(df, ["toxic", "quality"]).alias(name))
    first, second, rows = one(t.labels, "first"), one(t.labels.drop("toxic"), "second"), one(t.labels.select("doc_id"), "rows")
    return first.withColumn("k", F.lit(1)).join(second.withColumn("k", F.lit(1)), "k").join(rows.withColumn("k", F.lit(1)), "k").drop("k")


@query("""
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS p, unnest(list_reverse(embedding))::DOUBLE AS q FROM embeddings)
SELECT label, round(avg((p - q) * (p - q)), 8) AS mse FROM e GROUP BY label
""")
def ragged_mse(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", "embedding", F.reverse("embedding").alias("target"))
    return ragged.mse_per_instance(rows, "label", "embedding", "target").withColumn("mse", F.round("mse", 8))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey, l_partkey % 10 + 1]) AS v_idx, unnest([0, 1, 2]) AS corner FROM lineitem)
SELECT l_orderkey, l_linenumber, corner, p_size AS x, p_retailprice AS y FROM f JOIN part ON p_partkey = v_idx
""")
def face_corners(t: Tables) -> DataFrame:
    vertices = t.part.select(F.col("p_partkey").alias("v_idx"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    faces = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("v0"), F.col("l_suppkey").alias("v1"), (F.col("l_partkey") % 10 + 1).alias("v2"))
    return ragged.corners(faces, vertices, ["l_orderkey", "l_linenumber"])


@query("""
WITH k AS (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN k % 10 <> 0 THEN k END AS k, CASE WHEN k % 10 = 0 THEN 'ValueError: a tenth' END AS error FROM k WHERE k IS NULL OR k % 7 <> 0
""")
def row_worker(t: Tables) -> DataFrame:
    def parse(row: dict) -> dict | None:
        k = json.loads(row["props"])["k"]
        if k % 7 == 0:
            return None
        if k % 10 == 0:
            raise ValueError("a tenth")
        return {"k": k}

    return worker.per_row(t.events.select("event_id", "props"), "event_id", parse, "k bigint")


@query("SELECT conv_id, turn, printf('view%02d', turn) AS name FROM conversations")
def view_names(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.view_name(F.col("turn")).alias("name"))


@query("SELECT l_orderkey, l_linenumber, round((l_linenumber + 0.5) / 8 - 0.5, 9) AS centre, round(1 / (1 + exp(-(l_discount * 1.5 + 0.25))), 9) AS t FROM lineitem")
def centres_and_times(t: Tables) -> DataFrame:
    centre, time = geometry.voxel_centre(F.col("l_linenumber"), 1 / 8, -0.5), flow.logit_normal(F.col("l_discount"), 0.25, 1.5)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(centre, 9).alias("centre"), F.round(time, 9).alias("t"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def point_lookups(t: Tables) -> DataFrame:
    return merge.looked_up(t.orders.select("o_orderkey", "o_custkey"), t.customer, "o_custkey", "c_custkey", "c_name")


@query("""
WITH n AS (SELECT max(event_id) AS n FROM events)
SELECT event_id AS step, event_type AS key, CASE WHEN event_id * 2 >= n THEN value + 1 ELSE value END AS value, (event_id * 2 >= n)::INTEGER AS run FROM events, n
""")
def log_appends(t: Tables) -> DataFrame:
    """Two runs append to a log; the second resumes before the end of the first, and writes twice."""
    path = shared_folder(t.spark, "log")
    n = t.events.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    entries = t.events.select(F.col("event_id").alias("step"), F.col("event_type").alias("key"), "value")
    sinks.write_log(entries.where(F.col("step") * 10 < n * 6), path, 0)
    resumed = entries.where(F.col("step") * 2 >= n).withColumn("value", F.col("value") + 1)
    for part in (resumed.where(F.col("step") * 10 < n * 8), resumed):
        sinks.write_log(part, path, 1)
    return readers.read_log(t.spark, path)

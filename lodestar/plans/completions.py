"""Queries for inverses, variants and hooks: the second half of operators that the other areas query in part."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import flow, geometry, text
from lodestar.operators import ragged, records, select, shard, tasks, worker
from lodestar.operators import telemetry as tm
from lodestar.plans.base import Tables, query
from lodestar.plans.sparse import _CELLS, _cells, _rounded
from lodestar.sources import datasets


def _doubles(name: str = "embedding"):
    return F.transform(name, lambda x: x.cast("double"))


@query("""
WITH p AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings)
SELECT vec_id, (i // 8)::INTEGER AS y, i % 8 AS x, round(v::DOUBLE, 6) AS value FROM p WHERE v > 0.1
""")
def sparse_from_dense(t: Tables) -> DataFrame:
    bright = F.transform("embedding", lambda x: F.when(x > 0.1, x).otherwise(0))
    return ragged.from_dense(t.embeddings.select("vec_id", bright.alias("v")), ["vec_id"], "v", 8).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"WITH {_CELLS} SELECT batch_id, x, y, z, f FROM c")
def unpatchify(t: Tables) -> DataFrame:
    patches = ragged.patches(_cells(t), 4).select("batch_id", "px", "py", "pz", "place", "f")
    return ragged.unpatched(patches, 4).select("batch_id", "x", "y", "z", "f")


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS i FROM embeddings),
m AS (SELECT label, i // 8 AS g, avg(v) AS mean, var_pop(v) AS var FROM e GROUP BY ALL)
SELECT vec_id, e.label AS label, list(round((v - mean) / sqrt(var + 0.00001), 5) + 0.0 ORDER BY i) AS f FROM e JOIN m ON m.label = e.label AND m.g = e.i // 8 GROUP BY vec_id, e.label
""")
def group_norm(t: Tables) -> DataFrame:
    out = ragged.group_norm(t.embeddings.select("vec_id", "label", "embedding"), "label", "embedding", 64, 8)
    return out.select("vec_id", "label", _rounded("embedding").alias("f"))


@query(f"""WITH {_CELLS}, s AS (SELECT batch_id, x - dx AS x, y - dy AS y, z - dz AS z, f / (1 + abs(dx) + 2 * abs(dy) + 4 * abs(dz) + (dx > 0)::INTEGER) AS v
  FROM c, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) d(dz))
SELECT batch_id, x::INTEGER AS x, y::INTEGER AS y, z::INTEGER AS z, round(sum(v), 4) AS f FROM s JOIN c USING (batch_id, x, y, z) GROUP BY ALL""")
def sparse_convolution(t: Tables) -> DataFrame:
    dx, dy, dz = F.col("dx"), F.col("dy"), F.col("dz")
    kernel = 1 / (1 + F.abs(dx) + 2 * F.abs(dy) + 4 * F.abs(dz) + (dx > 0).cast("int"))
    return ragged.convolved(_cells(t), "f", kernel).select("batch_id", "x", "y", "z", F.round("f", 4).alias("f"))


@query(f"""WITH {_CELLS}, w AS (SELECT *, ((batch_id::BIGINT * 9 + (x + 2) // 4) * 9 + (y + 2) // 4) * 9 + (z + 2) // 4 AS w, f / 100 AS g FROM c)
SELECT a.w, a.batch_id, a.x, a.y, a.z, round(sum(exp(a.g * b.g) * b.f) / sum(exp(a.g * b.g)), 4) AS out FROM w a JOIN w b ON a.w = b.w GROUP BY ALL""")
def windowed_attention(t: Tables) -> DataFrame:
    cells = _cells(t).withColumn("token", F.struct("batch_id", "x", "y", "z")).withColumns({"q": F.array(F.col("f") / 100), "v": F.array(F.col("f").cast("double"))})
    out = ragged.attention(ragged.window_codes(cells, 4, 2, 9), "window", "token", "q", "q", "v")
    return out.select(F.col("window").alias("w"), "token.*", F.round(F.element_at("out", 1), 4).alias("out"))


@query("""
WITH n AS (SELECT l_linenumber, l_discount * 2 - 1 AS a1, l_tax * 2 - 1 AS a2, l_quantity / 50 * 2 - 1 AS a3 FROM lineitem),
c AS (SELECT l_linenumber, a1 * a1 + a2 * a2 + a3 * a3 AS size, a1 * a2 + a2 * a3 + a3 * a1 AS dot FROM n)
SELECT l_linenumber, round(avg(degrees(acos(greatest(-1, least(1, dot / (size + 1e-9)))))), 5) AS angle FROM c GROUP BY l_linenumber
""")
def normal_angle(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linenumber", F.col("l_discount").cast("double").alias("p"), F.col("l_tax").cast("double").alias("q"), (F.col("l_quantity") / 50).cast("double").alias("r"))
    return tm.normal_angle(rows, ["l_linenumber"], ("p", "q", "r"), ("q", "r", "p")).withColumn("angle", F.round("angle", 5))


@query("SELECT sum(p_size * (p_partkey % 5 + 1))::BIGINT AS n_params, sum(CASE WHEN p_size % 2 = 0 THEN p_size * (p_partkey % 5 + 1) ELSE 0 END)::BIGINT AS n_trainable FROM part")
def parameter_counts(t: Tables) -> DataFrame:
    shapes = t.part.select(F.array(F.col("p_size").cast("bigint"), (F.col("p_partkey") % 5 + 1).cast("bigint")).alias("shape"), (F.col("p_size") % 2 == 0).alias("trainable"))
    return tm.parameter_counts(shapes, "shape", "trainable")


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), e AS (SELECT doc_id, e FROM documents, range(1, 3) t(e)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY e, md5('9|' || e::VARCHAR || '|' || doc_id::VARCHAR), doc_id) - 1 + (SELECT n FROM n) AS step FROM e)
SELECT doc_id, step::BIGINT AS step FROM r, n WHERE step >= n + n // 2 AND step < 2 * n + n // 2
""")
def epoch_cycle(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id")
    n = docs.count()
    return shard.cycled(docs, "doc_id", "9", n + n // 2, n)


@query("""
WITH g AS (SELECT doc_id AS used, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE n_chars >= 500)
SELECT doc_id, doc_id AS used FROM documents WHERE n_chars >= 500 UNION ALL
SELECT doc_id, used FROM documents JOIN g ON i = ('0x' || substr(md5('r|' || doc_id::VARCHAR), 1, 15))::BIGINT % (SELECT count(*) FROM g) WHERE n_chars < 500
""")
def replaced_samples(t: Tables) -> DataFrame:
    return shard.replaced(t.documents, "doc_id", F.col("n_chars") >= 500, "r")


@query("""
WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS p, b.embedding::DOUBLE[] AS n, list_reverse(a.embedding)::DOUBLE[] AS x, a.vec_id % 4 / 2.0 AS g, (a.vec_id % 9 + 1) / 10.0 AS t
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, x, g, 0.01 + 0.99 * t AS k, p, list_transform(list_zip(p, n), lambda e: g * e[1] + (1 - g) * e[2]) AS v FROM p),
z AS (SELECT *, list_transform(list_zip(x, p), lambda e: 0.99 * e[1] - k * e[2]) AS zp, list_transform(list_zip(x, v), lambda e: 0.99 * e[1] - k * e[2]) AS z FROM m),
f AS (SELECT *, 0.7 * list_stddev_samp(zp) / list_stddev_samp(z) + 0.3 AS f FROM z)
SELECT vec_id, CASE WHEN g = 1 OR g = 0 THEN list_transform(v, lambda e: round(e, 5) + 0.0) ELSE list_transform(list_zip(x, z), lambda e: round((0.99 * e[1] - e[2] * f) / k, 5) + 0.0) END AS v FROM f
""")
def cfg_rescale(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", _doubles().alias("p"), F.reverse(_doubles()).alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), _doubles().alias("n"))
    g, time = F.col("vec_id") % 4 / 2, (F.col("vec_id") % 9 + 1) / 10
    v = flow.guided_rescaled(F.col("x"), F.col("p"), F.col("n"), g, time, 0.01, 0.7)
    return a.join(b, "vec_id").select("vec_id", _rounded(v).alias("v"))


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, unnest(range(0, 32)) AS j FROM embeddings),
p AS (SELECT vec_id, j, v[2 * j + 1] AS x, v[2 * j + 2] AS y,
      CASE j // 10 WHEN 0 THEN vec_id % 16 WHEN 1 THEN label WHEN 2 THEN vec_id % 7 ELSE 0 END * pow(10000.0, -(j % 10) / 10.0) AS a FROM e),
r AS (SELECT vec_id, j, round(x * cos(a) - y * sin(a), 5) + 0.0 AS x, round(x * sin(a) + y * cos(a), 5) + 0.0 AS y FROM p)
SELECT vec_id, flatten(list([x, y] ORDER BY j)) AS v FROM r GROUP BY vec_id
""")
def rotary_phases(t: Tables) -> DataFrame:
    turned = flow.rotary(_doubles(), [F.col("vec_id") % 16, F.col("label"), F.col("vec_id") % 7], 64)
    return t.embeddings.select("vec_id", _rounded(turned).alias("v"))


@query(f"""WITH {_CELLS}, s AS (SELECT *, 1 + batch_id / 4.0 AS k FROM c)
SELECT batch_id, x, 31 - z AS y, y AS z, round(((x + 0.5) / 32 - 0.5) / k, 9) AS px, round(((31 - z + 0.5) / 32 - 0.5) / k, 9) AS py, round(((y + 0.5) / 32 - 0.5) / k, 9) AS pz FROM s""")
def truth_view(t: Tables) -> DataFrame:
    moved = geometry.truth_view(F.col("x"), F.col("y"), F.col("z"), 32)
    rows = _cells(t).select("batch_id", (1 + F.col("batch_id") / 4).alias("k"), *(c.alias(a) for c, a in zip(moved, "xyz")))
    return rows.select("batch_id", "x", "y", "z", *(F.round(geometry.scaled_centre(F.col(a), 32, F.col("k")), 9).alias(f"p{a}") for a in "xyz"))


@query("SELECT vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda e: round(e[1]::DOUBLE - (vec_id % 10 + 1) / 20.0 * e[2]::DOUBLE, 5) + 0.0) AS x FROM embeddings")
def euler_step(t: Tables) -> DataFrame:
    # times n / 20 and 0: each is the double nearest to it, so that no step is off by a last bit
    x = flow.euler(_doubles(), F.reverse(_doubles()), (F.col("vec_id") % 10 + 1) / 20, F.lit(0.0))
    return t.embeddings.select("vec_id", _rounded(x).alias("x"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 255, 9)::DOUBLE AS plain, round(l_quantity / 255 * 2 - 1, 9)::DOUBLE AS signed FROM lineitem")
def dequantise_u8(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(geometry.dequantise_u8(q), 9).alias("plain"), F.round(geometry.dequantise_u8(q, signed=True), 9).alias("signed"))


@query("SELECT event_id, list_transform(range(0, 8), lambda i: round(CASE WHEN i < 4 THEN sin(event_id % 50 * exp(-ln(10000) * i / 4)) ELSE cos(event_id % 50 * exp(-ln(10000) * (i - 4) / 4)) END, 6) + 0.0) AS emb FROM events")
def position_embedding(t: Tables) -> DataFrame:
    return t.events.select("event_id", _rounded(flow.sinusoidal(F.col("event_id") % 50, 8, cos_first=False), 6).alias("emb"))


@query("SELECT p_partkey, list_filter([0, 1], lambda i: CASE i WHEN 0 THEN p_size % 3 > 0 AND p_size % 2 > 0 ELSE p_size % 2 > 0 END) AS kept FROM part")
def non_empty_objects(t: Tables) -> DataFrame:
    ones = lambda n: F.array_repeat(F.lit(1), n.cast("int"))
    two, three = F.col("p_size") % 2, F.col("p_size") % 3
    one = lambda i, v, f: F.struct(F.lit(i).alias("id"), ones(v).alias("vertices"), ones(f).alias("faces"))
    rows = t.part.select("p_partkey", F.array(one(0, three, two), one(1, two, F.lit(2))).alias("objects"))
    return rows.select("p_partkey", F.transform(select.non_empty_objects("objects"), lambda o: o["id"]).alias("kept"))


@query("SELECT event_id, value < 10 OR user_id % 3 < 1 AS some, value < 10 AND user_id % 3 < 1 AS every FROM events")
def json_leaves(t: Tables) -> DataFrame:
    record = F.to_json(F.struct((F.col("value") - 9).alias("a"), F.struct((F.col("user_id") % 3).alias("b")).alias("c")))
    small = lambda x: x < 1
    return t.events.select("event_id", text.any_leaf(record, small).alias("some"), text.all_leaves(record, small).alias("every"))


@query("""
SELECT 'labelled' AS dataset, doc_id AS key FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 500 AND quality = 1
UNION ALL SELECT 'pages', page_id FROM pages
""")
def dataset_hooks(t: Tables) -> DataFrame:
    read = lambda name: lambda spark, folder: spark.read.parquet(f"{folder}/{name}.parquet")
    texts = datasets.Dataset(read("documents"), (lambda d: d.where("n_chars >= 500"),), lambda d: d.select(F.col("doc_id").alias("key")))
    labels = t.labels.where("quality = 1").select("doc_id")
    datasets.register("labelled", texts.refined(lambda d: d.join(labels, "doc_id", "left_semi")))
    datasets.register("pages", datasets.Dataset(read("pages"), collate=lambda d: d.select(F.col("page_id").alias("key"))))
    one, two = (datasets.named(n).samples(t.spark, t.folder).select(F.lit(n).alias("dataset"), "key") for n in ("labelled", "pages"))
    return one.unionByName(two)


@query("""
WITH r AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), e AS (
  SELECT conv_id, turn, unnest([{'path': 'a.turn', 'leaf': turn::VARCHAR}, {'path': 'a.b.role', 'leaf': role}, {'path': 'a.b.c.d.e.n', 'leaf': n::VARCHAR},
    {'path': 'a.b.c.list', 'leaf': '[' || turn || ',{"x":' || n || '}]'}, {'path': 'a.b.gone', 'leaf': NULL}, {'path': 'top', 'leaf': (n % 3)::VARCHAR}]) AS x FROM r)
SELECT conv_id, turn, x.path AS path, x.leaf AS leaf FROM e
""")
def deep_leaves(t: Tables) -> DataFrame:
    """Records six deep; arrays are leaves, empty objects have none."""
    n = F.length("text")
    b = F.concat(F.lit('{"role":'), F.to_json(F.array("role")).substr(F.lit(2), F.length(F.to_json(F.array("role"))) - 2), F.lit(',"empty":{},"gone":null,"c":{"list":['), F.col("turn"),
                 F.lit(',{"x":'), n, F.lit('}],"d":{"e":{"n":'), n, F.lit("}}}}"))
    record = F.concat(F.lit('{"a":{"turn":'), F.col("turn"), F.lit(',"b":'), b, F.lit('},"top":'), n % 3, F.lit("}"))
    found = records.leaves(t.conversations.select("conv_id", "turn", record.alias("record")), ["conv_id", "turn"], "record")
    return found.select("conv_id", "turn", "path", F.try_variant_get("leaf", "$", "string").alias("leaf"))


@query("""
WITH r AS (SELECT event_id, value AS a, user_id % 3 AS b, event_id % 4 AS c, event_id % 2 AS d FROM events)
SELECT event_id, a < 10 OR b < 1 OR c < 1 OR d < 1 AS some, a < 10 AND b < 1 AND c < 1 AND d < 1 AS every FROM r
""")
def deep_leaf_tests(t: Tables) -> DataFrame:
    """Numbers at four depths, one of them in an array."""
    value, k = F.col("value"), F.col("event_id")
    record = F.concat(F.lit('{"a":'), value - 9, F.lit(',"x":{"b":'), F.col("user_id") % 3, F.lit(',"y":{"z":['), k % 4, F.lit(',{"d":'), k % 2, F.lit("}]}}}"))
    found = records.leaves(t.events.where("value IS NOT NULL").select("event_id", record.alias("record")), ["event_id"], "record", enter_arrays=True)
    return records.leaf_tests(found, ["event_id"], lambda leaf: records.number() < 1)


@query("""
WITH k AS (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN event_id % 499 <> 7 AND event_id % 499 <> 13 THEN k END AS k,
  CASE event_id % 499 WHEN 7 THEN 'TimeoutError: no result after 0.5 s' WHEN 13 THEN 'ProcessError: the process ended with 3' END AS error FROM k
""")
def row_worker_timeout(t: Tables) -> DataFrame:
    """Some rows hang and some end their process; all others have their results."""

    def parse(row: dict) -> dict:
        if row["event_id"] % 499 == 7:
            time.sleep(3600)
        if row["event_id"] % 499 == 13:
            os._exit(3)
        return {"k": json.loads(row["props"])["k"]}

    return worker.per_row(t.events.select("event_id", "props"), "event_id", parse, "k bigint", timeout=0.5)


@query(f"""WITH {_CELLS}, k AS (SELECT dx, dy, dz, (CASE dx WHEN 1 THEN 0.25 ELSE 0.75 END * 0.5 * CASE dz WHEN 1 THEN 0.75 ELSE 0.25 END)::DOUBLE AS w FROM range(2) a(dx), range(2) b(dy), range(2) d(dz))
SELECT p.batch_id, p.x, p.y, p.z, round(sum(w * c.f) / sum(w), 5) AS f FROM c p, k JOIN c ON c.batch_id = p.batch_id AND c.x = p.x + dx AND c.y = p.y + dy AND c.z = p.z + dz GROUP BY ALL""")
def trilinear_query(t: Tables) -> DataFrame:
    """A cell's attribute a quarter, a half and three quarters of the way to the next cells."""
    cells = _cells(t)
    at = {"px": F.col("x") + 0.25, "py": F.col("y") + 0.5, "pz": F.col("z") + 0.75}
    points = cells.withColumns(at).select("batch_id", "x", "y", "z", *at)
    named = points.withColumn("k", F.struct("batch_id", "x", "y", "z")).select("k", "batch_id", *at)
    return ragged.trilinear(named, cells, ["k"], "batch_id", "f").select("k.*", F.round("f", 5).alias("f"))


@query("""
WITH k AS (SELECT DISTINCT conv_id FROM conversations), need AS (SELECT conv_id, v AS view_idx, r AS resolution FROM k, (VALUES (0), (1), (2)) a(v), (VALUES (256), (512)) b(r)),
done AS (SELECT DISTINCT conv_id, turn AS view_idx, CASE WHEN length(text) % 2 = 0 THEN 256 ELSE 512 END AS resolution FROM conversations)
SELECT conv_id, count(*) AS missing FROM need ANTI JOIN done USING (conv_id, view_idx, resolution) GROUP BY conv_id
""")
def incomplete_keys(t: Tables) -> DataFrame:
    need = tasks.required_tasks(t.conversations.select("conv_id").distinct(), [0, 1, 2], [256, 512])
    done = t.conversations.select("conv_id", F.col("turn").cast("int").alias("view_idx"), F.when(F.length("text") % 2 == 0, 256).otherwise(512).alias("resolution"))
    return tasks.incomplete(need, done, "conv_id", ["conv_id", "view_idx", "resolution"])


@query("""
SELECT vec_id, [embedding[1:13], embedding[14:26], embedding[27:39], embedding[40:52], embedding[53:64]]::DOUBLE[][] AS parts,
  list_concat(embedding[33:48], embedding[1:4])::DOUBLE[] AS joined FROM embeddings
""")
def channel_chunks(t: Tables) -> DataFrame:
    """Features in five chunks, the last one shorter; and a slice joined to another."""
    f = _doubles()
    return t.embeddings.select("vec_id", ragged.chunks(f, 5).alias("parts"), F.concat(F.slice(f, 33, 16), F.slice(f, 1, 4)).alias("joined"))


@query("""
WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value / 50 - 0.5 END AS x FROM events)
SELECT event_id, CASE WHEN isnan(x) THEN 0 ELSE trunc(greatest(0.0, least(1.0, x)) * 255) END::SMALLINT AS q FROM r
""")
def finite_bytes(t: Tables) -> DataFrame:
    """Values with NaN and infinities among them: NaN is 0, infinities are the ends."""
    k = F.col("event_id") % 5
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value") / 50 - 0.5)
    return t.events.select("event_id", geometry.quantise_u8(x).alias("q"))

"""Further queries: one for each smaller operator that the other areas don't already exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import flow
from lodestar.functions import geometry as g
from lodestar.operators import merge, ragged, select, shard
from lodestar.operators import telemetry as tm
from lodestar.plans.base import Tables, query
from lodestar.plans.geometry import _POINTS, _points, _round
from lodestar.plans.sparse import _CELLS, _cells, _rounded
from lodestar.sources.readers import importer_of


@query("""
WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS a, list(length(text) ORDER BY turn) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, i::INTEGER - 1 AS pos, a[i] AS role, b[i] AS size FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM a)
""")
def zip_join(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("bigint").alias("size"))))
    rows = t.conversations.groupBy("conv_id").agg(turns.alias("t"))
    roles, sizes = rows.select("conv_id", F.col("t.role").alias("role")), rows.select("conv_id", F.col("t.size").alias("size"))
    return merge.zipped(roles, sizes, "conv_id", "role", "size")


@query("SELECT conv_id, string_agg(printf('t%03d=', turn) || length(text)::VARCHAR, ', ' ORDER BY turn) AS sizes FROM conversations GROUP BY conv_id")
def map_merge(t: Tables) -> DataFrame:
    entry = F.struct(F.format_string("t%03d", "turn").alias("k"), F.length("text").cast("bigint").alias("v"))
    half = lambda odd: F.map_from_entries(F.collect_list(F.when(F.col("turn") % 2 == odd, entry)))
    joined = t.conversations.groupBy("conv_id").agg(half(0).alias("m0"), half(1).alias("m1")).withColumn("m", merge.merged_maps("m0", "m1"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return joined.select("conv_id", F.array_join(entries, ", ").alias("sizes"))


@query("""
WITH c AS (SELECT page_id, unnest([split_part(url, '/', -1), 'p' || (page_id % 5)::VARCHAR]) AS path, unnest([0, 1]) AS pos FROM pages)
SELECT page_id, arg_min(path, pos) AS path FROM c WHERE path IN ('p0', 'p3') GROUP BY page_id
""")
def first_existing_path(t: Tables) -> DataFrame:
    candidates = t.pages.select("page_id", F.array(F.substring_index("url", "/", -1), F.concat(F.lit("p"), (F.col("page_id") % 5).cast("string"))).alias("paths"))
    files = t.spark.createDataFrame([("p0",), ("p3",)], "path string")
    return merge.first_existing(candidates, "page_id", "paths", files)


@query("SELECT doc_id, list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'other' END], lambda x: x IS NOT NULL) AS broken FROM documents WHERE n_chars < 500 OR lang <> 'en'")
def reject_side(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", "lang")
    return select.split_rejects(rows, {"short": F.col("n_chars") >= 500, "other": F.col("lang") == "en"})[1].select("doc_id", "broken")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (toxic = 1) IS NOT TRUE AND (quality = 0) IS NOT TRUE")
def visible_rows(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", (F.col("toxic") == 1).alias("h1"), (F.col("quality") == 0).alias("h2")).where(select.visible(["h1", "h2"])).select("doc_id")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'gltf' WHEN 1 THEN 'fbx' END AS importer FROM part")
def import_dispatch(t: Tables) -> DataFrame:
    name = F.concat(F.lit("m."), F.element_at(F.array(F.lit("GLB"), F.lit("Fbx"), F.lit("txt")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return t.part.select("p_partkey", importer_of(name).alias("importer"))


@query("SELECT doc_id, (('0x' || substr(md5('s|' || doc_id::VARCHAR), 1, 15))::BIGINT % 6)::INTEGER AS view FROM documents")
def uniform_view(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", shard.chosen_view(F.col("doc_id"), "s", F.lit(6)).alias("view"))


@query("""
WITH v AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY md5('s|' || doc_id::VARCHAR || '|' || v::VARCHAR)) AS r FROM documents, range(0, 6) t(v))
SELECT doc_id, list(v::INTEGER ORDER BY v) AS views FROM v WHERE r <= 2 GROUP BY doc_id
""")
def two_views(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", shard.chosen_views(F.col("doc_id"), "s", 6, 2).alias("views"))


@query("SELECT max(o_orderkey) AS step FROM orders")
def latest_checkpoint(t: Tables) -> DataFrame:
    names = t.orders.select(F.format_string("denoiser_step%07d.pt", "o_orderkey").alias("name"))
    return names.agg(shard.latest_step(F.col("name")).alias("step"))


@query("SELECT user_id, round(sqrt(sum(value * value)), 6) AS norm FROM events GROUP BY user_id")
def gradient_norms(t: Tables) -> DataFrame:
    return tm.norms(t.events, ["user_id"], "value").withColumn("norm", F.round("norm", 6))


@query("""
WITH n AS (SELECT event_type, sqrt(sum(value * value)) AS norm FROM events GROUP BY event_type),
r AS (SELECT arg_min(norm, event_type) AS f, max(norm) AS hi, min(norm) AS lo FROM n)
SELECT round(f, 6) AS reference, round(greatest(abs(hi - f), abs(lo - f)) / f, 6) AS off, greatest(abs(hi - f), abs(lo - f)) / f > 0.001 AS disagree FROM r
""")
def rank_consistency(t: Tables) -> DataFrame:
    out = tm.ranks_disagree(tm.norms(t.events, ["event_type"], "value"), "event_type", "norm")
    return out.select(F.round("reference", 6).alias("reference"), F.round("off", 6).alias("off"), "disagree")


@query("SELECT event_id, value FROM (SELECT event_id, value FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, value FROM events WHERE user_id % 2 = 1) ORDER BY event_id LIMIT 64")
def gather_truncate(t: Tables) -> DataFrame:
    parts = [t.events.where(F.col("user_id") % 2 == r).select("event_id", "value") for r in (0, 1)]
    return parts[0].unionByName(parts[1]).orderBy("event_id").limit(64)


@query(f"WITH {_CELLS}, s AS (SELECT DISTINCT 10 - 3 * batch_id AS sample FROM c), n AS (SELECT sample, (row_number() OVER (ORDER BY sample) - 1)::INTEGER AS batch_id FROM s) SELECT sample, n.batch_id, x, y, z, f FROM c JOIN n ON 10 - 3 * c.batch_id = n.sample")
def collate_samples(t: Tables) -> DataFrame:
    rows = _cells(t).withColumn("sample", 10 - 3 * F.col("batch_id")).drop("batch_id")
    return ragged.collated(rows, "sample").select("sample", "batch_id", "x", "y", "z", "f")


@query(f"WITH {_CELLS} SELECT batch_id, x // 2 AS x, y // 2 AS y, z // 2 AS z, (4 * (x % 2) + 2 * (y % 2) + z % 2)::INTEGER AS c, f FROM c")
def pixel_unshuffle(t: Tables) -> DataFrame:
    return ragged.pixel_unshuffled(_cells(t).withColumn("c", F.lit(0)), 2).select("batch_id", "x", "y", "z", "c", "f")


@query(f"WITH {_CELLS} SELECT batch_id, x, y, z, 0 AS c, f FROM c")
def pixel_shuffle(t: Tables) -> DataFrame:
    return ragged.pixel_shuffled(ragged.pixel_unshuffled(_cells(t).withColumn("c", F.lit(0)), 2), 2).select("batch_id", "x", "y", "z", "c", "f")


@query(f"WITH {_CELLS} SELECT batch_id, x // 4 AS px, y // 4 AS py, z // 4 AS pz, (16 * (x % 4) + 4 * (y % 4) + z % 4)::INTEGER AS place, f FROM c")
def patchify(t: Tables) -> DataFrame:
    return ragged.patches(_cells(t), 4).select("batch_id", "px", "py", "pz", "place", "f")


@query("""
WITH e AS (SELECT vec_id // 8 AS seq, vec_id AS tok, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.seq, a.tok, exp(list_dot_product(a.v, b.v) / 8) AS w, b.v FROM e a JOIN e b ON a.seq = b.seq),
u AS (SELECT seq, tok, w, unnest(v) AS x, unnest(range(0, 64)) AS i FROM s),
m AS (SELECT seq, tok, i, round(sum(w * x) / sum(w), 5) + 0.0 AS y FROM u GROUP BY seq, tok, i)
SELECT seq, tok, list(y ORDER BY i) AS out FROM m GROUP BY seq, tok
""")
def attention_by_sequence(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 8).alias("seq"), F.col("vec_id").alias("tok"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = ragged.attention(rows, "seq", "tok", "v", "v", "v")
    return out.select("seq", "tok", _rounded("out").alias("out"))


@query("SELECT event_id, list_transform(range(0, 8), lambda i: round(CASE WHEN i < 4 THEN cos(event_id % 50 * exp(-ln(10000) * i / 4)) ELSE sin(event_id % 50 * exp(-ln(10000) * (i - 4) / 4)) END, 6) + 0.0) AS emb FROM events")
def time_embedding(t: Tables) -> DataFrame:
    emb = flow.sinusoidal(F.col("event_id") % 50, 8)
    return t.events.select("event_id", _rounded(emb, 6).alias("emb"))


@query(f"""WITH {_POINTS}, q AS (SELECT mesh, i, (x + 1) * 4 - 0.5 AS px, (y + 1) * 4 - 0.5 AS py FROM p),
c AS (SELECT mesh, i, greatest(0, least(7, floor(px) + dx)) AS cx, greatest(0, least(7, floor(py) + dy)) AS cy,
      CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END * CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END AS w
      FROM q, range(0, 2) a(dx), range(0, 2) b(dy))
SELECT mesh, i, round(sum(w * sqrt(cx + 10 * cy)), 5) AS v FROM c GROUP BY mesh, i""")
def bilinear_sample(t: Tables) -> DataFrame:
    pixels = ragged.full_grid(t.spark, (8, 8, 1)).select(F.col("x").alias("px"), F.col("y").alias("py"), F.sqrt((F.col("x") + 10 * F.col("y")).cast("double")).alias("v"))
    at = _points(t).select("mesh", "i", F.explode(g.bilinear_weights(F.col("x"), F.col("y"), 8, 8)).alias("c")).select("mesh", "i", "c.px", "c.py", "c.w")
    return at.join(pixels, ["px", "py"]).groupBy("mesh", "i").agg(F.round(F.sum(F.col("w") * F.col("v")), 5).alias("v"))


@query("SELECT p_partkey, [2.0 * p_size, 0, 0, 0, 0, -2.0 * p_size, 0, 0, 0, 0, round(100 / 99.0, 6), round(100 / -99.0, 6), 0, 0, 1, 0]::DOUBLE[] AS m FROM part")
def clip_matrix(t: Tables) -> DataFrame:
    m = g.projection_matrix(F.col("p_size").cast("double"), F.col("p_size").cast("double"), F.lit(0.5), F.lit(0.5), 1.0, 100.0)
    return t.part.select("p_partkey", _rounded(m, 6).alias("m"))


@query("SELECT l_orderkey, l_linenumber, round(abs(l_discount - l_tax), 9) AS a, round(CASE WHEN greatest(l_discount, l_tax) > 0 THEN abs(l_discount - l_tax) / greatest(l_discount, l_tax) ELSE 0 END, 9) AS r FROM lineitem")
def tolerances(t: Tables) -> DataFrame:
    a, b = F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(g.absolute_error(a, b), 9).alias("a"), F.round(g.relative_error(a, b), 9).alias("r"))


@query(f"""WITH {_POINTS}, b AS (SELECT mesh, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM p GROUP BY mesh)
SELECT mesh, i, round((x - cx) / e, 10) + 0.0 AS x, round((y - cy) / e, 10) + 0.0 AS y FROM p JOIN b USING (mesh) WHERE e > 0""")
def scene_normalise(t: Tables) -> DataFrame:
    return _round(g.scene_normalised(_points(t), ["mesh"]), ["mesh", "i"], "x", "y", digits=10)


@query(f"WITH {_POINTS} SELECT mesh, i, round(-y / sqrt(x * x + y * y + z * z), 5) + 0.0 AS nx, round(x / sqrt(x * x + y * y + z * z), 5) + 0.0 AS ny FROM p WHERE sqrt(x * x + y * y + z * z) > 0.001")
def normal_transform(t: Tables) -> DataFrame:
    v = (F.col("x"), F.col("y"), F.col("z"))
    rows = _points(t).where(F.sqrt(sum((c * c for c in v), F.lit(0.0))) > 0.001)
    n = g.unit_vector(tuple(g.rotate([[0, -1, 0], [1, 0, 0], [0, 0, 1]], v)))
    return _round(rows.select("mesh", "i", n[0].alias("nx"), n[1].alias("ny")), ["mesh", "i"], "nx", "ny", digits=5)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size > 20 THEN 'BLEND' WHEN p_size % 2 = 0 THEN 'OPAQUE' ELSE 'MASK' END AS mode, CASE WHEN p_size % 5 = 0 THEN 2 ELSE p_size % 5 END AS mat FROM part")
def material_fixups(t: Tables) -> DataFrame:
    mode = g.blend_mode(F.when(F.col("p_size") % 2 == 0, "OPAQUE").otherwise("MASK"), F.col("p_size") > 20)
    mat = g.material_index(F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size") % 5), F.array(*map(F.lit, "abc")))
    return t.part.select("p_partkey", mode.alias("mode"), mat.cast("int").alias("mat"))

"""Queries over files of one entity each: they are written, committed, read by format and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.base import Tables, query
from lodestar.sources import arrays, entity_files, meshes, pictures, readers, sinks
from lodestar.sources.scratch import shared_folder


def _voxels(t: Tables) -> DataFrame:
    """Vectors as voxels of their labels' entities."""
    return t.embeddings.select(
        F.concat(F.lit("e"), F.coalesce(F.col("label").cast("string"), F.lit("none"))).alias("name"),
        (F.col("vec_id") % 16).alias("x"), (F.floor(F.col("vec_id") / 16) % 16).alias("y"), F.floor(F.col("vec_id") / 256).alias("z"), "embedding",
    )


_VOXELS = "v AS (SELECT 'e' || coalesce(label::VARCHAR, 'none') AS name, vec_id % 16 AS x, vec_id // 16 % 16 AS y, vec_id // 256 AS z, embedding FROM embeddings)"


@query(f"""
WITH {_VOXELS} SELECT name, row_number() OVER (PARTITION BY name ORDER BY x, y, z) - 1 AS pos, x::INTEGER AS x, y::INTEGER AS y, z::INTEGER AS z,
  embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, round(list_sum(list_transform(embedding, lambda f: f::DOUBLE)), 6) AS total FROM v
""")
def npz_voxels(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "npz")
    arrays.write_voxels(_voxels(t), path, "name", "embedding")
    f = F.col("feats")
    total = F.aggregate(f, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return arrays.read_voxels(t.spark, path).select("name", "pos", "x", "y", "z", f[0].cast("double").alias("first"), f[63].cast("double").alias("last"), F.round(total, 6).alias("total"))


@query(f"WITH {_VOXELS} SELECT name, count(*) AS n, min(x)::INTEGER AS x_min, max(z)::INTEGER AS z_max FROM v GROUP BY name")
def vxz_voxels(t: Tables) -> DataFrame:
    """Counts come from headers; the ends come from a read of the coordinates without the features."""
    path = shared_folder(t.spark, "vxz")
    arrays.write_voxels(_voxels(t), path, "name", "embedding", kind="vxz")
    ends = arrays.read_voxels(t.spark, path, ["name", "x", "z"]).groupBy("name").agg(F.min("x").alias("x_min"), F.max("z").alias("z_max"))
    return arrays.count_voxels(t.spark, path).join(ends, "name")


#: Lines of a supplier are the vertices of its mesh, in order of their keys; every vertex but the last two begins a face.
_MESHES = """v AS (SELECT l_suppkey, row_number() OVER w - 1 AS v_idx, count(*) OVER (PARTITION BY l_suppkey) AS n, l_quantity, l_discount, l_tax, l_linenumber
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_shipdate))"""


_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def _meshes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Vertices by one sort of the lines; faces follow from their number, which is a count that combines before its shuffle."""
    line = F.col("l_linenumber")
    v = t.lineitem.withColumn("v_idx", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_ORDER)) - 1).select(
        "l_suppkey", "v_idx", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), (line * 30).alias("red"), (line * 20).alias("green"),
        (255 - line).alias("blue"), line.alias("metallic"), (line * 2).alias("roughness"), F.lit(255).alias("alpha"),
    )
    sizes = t.lineitem.groupBy("l_suppkey").agg(F.count("*").cast("int").alias("n")).where("n > 2")
    at = F.col("f_idx")
    quad = (at % 5 == 0) & (at + 3 < F.col("n"))
    corners = F.when(quad, F.array(at, at + 1, at + 2, at + 3)).otherwise(F.array(at, at + 1, at + 2))
    return v, sizes.select("l_suppkey", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 3)).alias("f_idx")).select("l_suppkey", "f_idx", corners.alias("corners"))


def _written(t: Tables, extra: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    path = shared_folder(t.spark, "meshes")
    rows = meshes.ply_payloads(*_meshes(t), "l_suppkey", extra)
    entity_files.write_files(rows.withColumn("name", F.concat(F.lit("supplier"), "l_suppkey", F.lit(".ply"))), path, "name", "ply")
    key = F.regexp_extract("path", r"supplier(\d+)\.ply$", 1).cast("bigint").alias("l_suppkey")
    return tuple(df.select(key, "*").drop("path") for df in meshes.read_meshes(t.spark, path))


@query(f"""
WITH {_MESHES} SELECT l_suppkey, v_idx::INTEGER AS v_idx, round(l_quantity, 4) AS x, round(l_discount, 4) AS y, round(l_tax, 4) AS z,
  (l_linenumber * 30)::INTEGER AS red, (l_linenumber * 20)::INTEGER AS green, (255 - l_linenumber)::INTEGER AS blue FROM v
""")
def coloured_meshes(t: Tables) -> DataFrame:
    vertices, _ = _written(t, meshes.COLOUR)
    p = F.col("properties")
    return vertices.select("l_suppkey", "v_idx", *(F.round(p[c], 4).alias(c) for c in "xyz"), *(p[c].cast("int").alias(c) for c in meshes.COLOUR))


@query(f"""
WITH {_MESHES}, f AS (SELECT l_suppkey, v_idx, v_idx % 5 = 0 AND v_idx + 3 < n AS quad FROM v WHERE v_idx + 2 < n),
c AS (SELECT l_suppkey, v_idx, 0 AS part, [v_idx, v_idx + 1, v_idx + 2] AS c FROM f UNION ALL SELECT l_suppkey, v_idx, 1, [v_idx, v_idx + 2, v_idx + 3] FROM f WHERE quad)
SELECT l_suppkey, v_idx::INTEGER AS f_idx, part::INTEGER AS part, c[1]::INTEGER AS v0, c[2]::INTEGER AS v1, c[3]::INTEGER AS v2,
  (SELECT sum(l_linenumber * 2) FROM v m WHERE m.l_suppkey = c.l_suppkey AND m.v_idx = c[1])::INTEGER AS roughness FROM c
""")
def pbr_meshes(t: Tables) -> DataFrame:
    vertices, faces = _written(t, meshes.PBR)
    parts = faces.select("l_suppkey", "f_idx", F.posexplode(meshes.triangles(F.col("corners"))).alias("part", "c"))
    rough = vertices.select("l_suppkey", F.col("v_idx").alias("v0"), F.col("properties")["roughness"].cast("int").alias("roughness"))
    return parts.select("l_suppkey", "f_idx", "part", *(F.col("c")[i].alias(f"v{i}") for i in range(3))).join(rough, ["l_suppkey", "v0"])


#: Vectors as images of 8 x 8 pixels: bytes of red, green, blue and alpha; alpha is 0 or 255.
_IMAGES = """px AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, CASE WHEN v > 0.1 THEN 255 ELSE 0 END AS a,
  [floor(least(greatest(v * 400 + 128, 0), 255)), (i * 3)::DOUBLE, (vec_id % 256)::DOUBLE] AS c
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings))"""


@query(f"""
WITH {_IMAGES},
b AS (SELECT vec_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px WHERE a > 0 GROUP BY vec_id),
q AS (SELECT vec_id, trunc((x0 + x1) / 2.0 - greatest(x1 - x0, y1 - y0) / 2.0)::INTEGER AS l, trunc((y0 + y1) / 2.0 - greatest(x1 - x0, y1 - y0) / 2.0)::INTEGER AS t,
  trunc((x0 + x1) / 2.0 + greatest(x1 - x0, y1 - y0) / 2.0)::INTEGER AS r, trunc((y0 + y1) / 2.0 + greatest(x1 - x0, y1 - y0) / 2.0)::INTEGER AS d FROM b),
n AS (SELECT DISTINCT r - l AS n FROM q UNION SELECT DISTINCT d - t FROM q),
u AS (SELECT n, i, j, (j + 0.5 - (i + 0.5) * n / 5.0) / greatest(n / 5.0, 1.0) AS u FROM n, range(5) a(i), range(16) b(j) WHERE j < n),
k AS (SELECT n, i, j, CASE WHEN u = 0 THEN 1.0::DOUBLE WHEN abs(u) < 3 THEN sin(pi() * u) / (pi() * u) * sin(pi() * u / 3) / (pi() * u / 3) ELSE 0.0 END AS w FROM u),
m AS (SELECT n, i, j, w / sum(w) OVER (PARTITION BY n, i) AS w FROM k),
s AS (SELECT q.vec_id, mx.i AS i, my.i AS j, ch, sum(mx.w * my.w * CASE ch WHEN 3 THEN px.a ELSE px.c[ch + 1] END) AS v
  FROM q JOIN px USING (vec_id) JOIN m mx ON mx.n = r - l AND mx.j = px.x - l JOIN m my ON my.n = d - t AND my.j = px.y - t, range(4) c(ch)
  GROUP BY q.vec_id, mx.i, my.i, ch),
f AS (SELECT vec_id, i, j, ch, least(greatest(v, 0), 255) / 255 AS v FROM s)
SELECT c.vec_id, (c.ch * 25 + c.j * 5 + c.i)::INTEGER AS place, round(c.v * a.v, 6) AS value FROM f c JOIN f a USING (vec_id, i, j) WHERE a.ch = 3 AND c.ch < 3
""")
def conditioning_images(t: Tables) -> DataFrame:
    """Images are written as PNG files, read, cropped to what is visible, resized to 5 x 5 and multiplied by alpha."""
    path = shared_folder(t.spark, "images")
    v = lambda x: x.cast("double")
    byte = lambda x: F.floor(F.least(F.greatest(v(x) * 400 + 128, F.lit(0.0)), F.lit(255.0)))
    pixel = lambda x, i: F.array(byte(x), (i * 3).cast("bigint"), F.col("vec_id") % 256, F.when(v(x) > 0.1, F.lit(255)).otherwise(F.lit(0)).cast("bigint"))
    images = t.embeddings.select("vec_id", F.flatten(F.transform("embedding", pixel)).alias("pixels"))
    named = pictures.png_files(images, "vec_id", "pixels", 8).withColumn("name", F.concat(F.lit("image"), "vec_id", F.lit(".png")))
    entity_files.write_files(named, path, "name", "png")
    found = pictures.conditioning_images(entity_files.files_below(t.spark, path, "*.png"), 5)
    fine = F.when(F.col("error").isNull(), F.col("pixels")).otherwise(F.raise_error("error").cast("array<double>"))
    rows = found.select(F.regexp_extract("path", r"image(\d+)\.png$", 1).cast("bigint").alias("vec_id"), F.posexplode(fine).alias("place", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query(f"""
WITH {_MESHES} SELECT 'vertex' AS kind, l_suppkey, v_idx::INTEGER AS idx, round(l_quantity, 4) AS a, round(l_discount, 4) AS b, round(l_tax, 4) AS c FROM v
UNION ALL SELECT 'face', l_suppkey, v_idx::INTEGER, v_idx, v_idx + 1, v_idx + 2 FROM v WHERE v_idx + 2 < n
""")
def ascii_meshes(t: Tables) -> DataFrame:
    """Meshes of triangles are written as text, one file each, and read again."""
    path = shared_folder(t.spark, "ascii")
    points, faces = _meshes(t)
    three = faces.select("l_suppkey", "f_idx", *(F.col("corners")[i].alias(f"v{i}") for i in range(3)))
    lines = sinks.ply_lines(points.withColumn("v_idx", F.col("v_idx").cast("int")), three.withColumn("f_idx", F.col("f_idx").cast("int")).select("l_suppkey", "f_idx", *(F.col(f"v{i}").cast("int").alias(f"v{i}") for i in range(3))), "l_suppkey")
    entity_files.write_files(lines.withColumn("name", F.concat(F.lit("supplier"), "l_suppkey", F.lit(".ply"))), path, "name", "ply")
    vertices, triangles = readers.read_ply_ascii(t.spark, path, "*.ply")
    key = F.regexp_extract("path", r"supplier(\d+)\.ply$", 1).cast("bigint").alias("l_suppkey")
    one = vertices.select(F.lit("vertex").alias("kind"), key, F.col("v_idx").alias("idx"), *(F.round(x, 4).alias(n) for x, n in zip("xyz", "abc")))
    two = triangles.select(F.lit("face").alias("kind"), key, F.col("f_idx").alias("idx"), *(F.col(f"v{i}").cast("double").alias(n) for i, n in enumerate("abc")))
    return one.unionByName(two)

"""Geometry, colour and flow queries; points come from line items, features from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import flow
from lodestar.functions import geometry as g
from lodestar.operators import images
from lodestar.plans.base import Tables, query
from lodestar.plans.sparse import _rounded

_POINTS = """p AS (SELECT l_orderkey AS mesh, l_linenumber AS i, (l_partkey % 1000) / 500.0::DOUBLE - 1 AS x, (l_suppkey % 100) / 50.0::DOUBLE - 1 AS y,
  l_quantity / 25.0::DOUBLE - 1 AS z FROM lineitem)"""


def _points(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("mesh"), F.col("l_linenumber").alias("i"), ((F.col("l_partkey") % 1000) / 500.0 - 1).alias("x"),
        ((F.col("l_suppkey") % 100) / 50.0 - 1).alias("y"), (F.col("l_quantity") / 25.0 - 1).alias("z"),
    )


def _round(df: DataFrame, keep: list[str], *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, *((F.round(c, digits) + 0.0).alias(c) for c in columns))


@query(f"""WITH {_POINTS} SELECT mesh, round(min(x), 6) + 0.0 AS min_x, round(max(x), 6) + 0.0 AS max_x, round((min(x) + max(x)) / 2, 6) + 0.0 AS centre_x,
round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) + 0.0 AS extent FROM p GROUP BY mesh""")
def bbox_extent(t: Tables) -> DataFrame:
    return _round(g.bounding_box(_points(t), ["mesh"]), ["mesh"], "min_x", "max_x", "centre_x", "extent")


@query(f"WITH {_POINTS} SELECT mesh, round(max(greatest(abs(x), abs(y), abs(z))), 6) AS most, round(0.49999 / max(greatest(abs(x), abs(y), abs(z))), 6) AS scale FROM p GROUP BY mesh HAVING max(greatest(abs(x), abs(y), abs(z))) > 0")
def abs_max_scale(t: Tables) -> DataFrame:
    most = _points(t).groupBy("mesh").agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))).alias("most")).where("most > 0")
    return _round(most.withColumn("scale", 0.49999 / F.col("most")), ["mesh"], "most", "scale")


@query(f"""WITH {_POINTS}, c AS (SELECT mesh, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM p GROUP BY mesh)
SELECT mesh, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))), 6) + 0.0 AS radius FROM p JOIN c USING (mesh) GROUP BY mesh""")
def sphere_radius(t: Tables) -> DataFrame:
    box = g.bounding_box(_points(t), ["mesh"])
    d = F.sqrt(sum((F.pow(F.col(a) - F.col(f"centre_{a}"), 2) for a in "xyz"), F.lit(0.0)))
    return _round(_points(t).join(box, "mesh").groupBy("mesh").agg(F.max(d).alias("radius")), ["mesh"], "radius")


@query("SELECT l_orderkey, l_linenumber, trunc(greatest(0.0, least(1.0, l_discount * 12)) * 255)::SMALLINT AS q FROM lineitem")
def quantize_u8(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", g.quantise_u8(F.col("l_discount") * 12).alias("q"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 96 - floor(l_discount * 96), 6) AS o FROM lineitem")
def voxel_offsets(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(g.voxel_offset(F.col("l_discount"), 96), 6).alias("o"))


@query("""
WITH RECURSIVE r AS (SELECT event_id AS i, event_id AS rest, 0.0::DOUBLE AS v, 0.5::DOUBLE AS unit FROM events
  UNION ALL SELECT i, rest // 2, v + (rest % 2) * unit, unit / 2 FROM r WHERE rest > 0)
SELECT i, i % 256 / 256.0::DOUBLE AS u, max(v) AS v FROM r GROUP BY i
""")
def hammersley_views(t: Tables) -> DataFrame:
    """Events as views: the first coordinate over rounds of 256, the second over all."""
    i = F.col("event_id")
    return t.events.select(i.alias("i"), g.hammersley(i % 256, 256)[0].alias("u"), g.hammersley(i, 256)[1].alias("v"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS u, l_tax * 12 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(v * 2 * pi(), 6) AS yaw, round(acos(1 - 2 * CASE WHEN u < 0.25 THEN 2 * u ELSE 2.0 / 3 * u + 1.0 / 3 END) - pi() / 2, 6) + 0.0 AS pitch FROM r
""")
def sphere_views(t: Tables) -> DataFrame:
    yaw, pitch = g.sphere_direction(F.col("l_discount") * 10, F.col("l_tax") * 12)
    # rounding may carry the last step just past 1
    return _round(t.lineitem.select("l_orderkey", "l_linenumber", yaw.alias("yaw"), pitch.alias("pitch")), ["l_orderkey", "l_linenumber"], "yaw", "pitch")


@query("""
SELECT p_partkey, round(2 * asin(sqrt(3) / 2 / (1 + p_size)), 6) AS fov, round(512 / tan(asin(sqrt(3) / 2 / (1 + p_size))), 5) AS focal FROM part
""")
def camera_fov_focal(t: Tables) -> DataFrame:
    fov = g.fov_of_radius(1 + F.col("p_size"))
    return t.part.select("p_partkey", F.round(fov, 6).alias("fov"), F.round(g.focal_pixels(fov, 1024), 5).alias("focal"))


@query(f"""WITH {_POINTS}, d AS (SELECT mesh, i, x, y, -(z - 3) + 1e-8 AS depth FROM p), q AS (SELECT mesh, i, x / depth * 400 + 256 AS u, -y / depth * 400 + 256 AS v, depth FROM d)
SELECT mesh, i, round(u, 5) AS u, round(v, 5) AS v, round(depth, 5) AS depth, depth > 0 AND u >= 0 AND u < 512 AND v >= 0 AND v < 512 AS inside FROM q""")
def pinhole_project(t: Tables) -> DataFrame:
    found = g.project_pinhole(F.col("x"), F.col("y"), F.col("z") - 3, 400.0, 512, 512)
    return _round(_points(t).select("mesh", "i", *(v.alias(k) for k, v in found.items())), ["mesh", "i", "inside"], "u", "v", "depth", digits=5)


@query(f"WITH {_POINTS} SELECT mesh, i, round(-y, 6) + 0.0 AS ax, round(x, 6) + 0.0 AS ay, round(z, 6) + 0.0 AS az FROM p")
def view_align(t: Tables) -> DataFrame:
    # a camera turned a quarter about z, with both fixed rotations the identity
    turn, one = [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    out = g.rotate(g.view_align(one, turn, one, one), (F.col("x"), F.col("y"), F.col("z")))
    return _round(_points(t).select("mesh", "i", *(c.alias(f"a{a}") for a, c in zip("xyz", out))), ["mesh", "i"], "ax", "ay", "az")


@query(f"""WITH {_POINTS}, w AS (SELECT mesh, i, x, y, z, lead(x) OVER o AS bx, lead(y) OVER o AS by_, lead(z) OVER o AS bz,
  lead(x, 2) OVER o AS cx, lead(y, 2) OVER o AS cy, lead(z, 2) OVER o AS cz FROM p WINDOW o AS (PARTITION BY mesh ORDER BY i, x, y, z)),
n AS (SELECT mesh, i, x, y, z, (by_ - y) * (cz - z) - (bz - z) * (cy - y) AS nx, (bz - z) * (cx - x) - (bx - x) * (cz - z) AS ny, (bx - x) * (cy - y) - (by_ - y) * (cx - x) AS nz FROM w WHERE cx IS NOT NULL),
u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM n WHERE sqrt(nx * nx + ny * ny + nz * nz) > 1e-3)
SELECT mesh, i, round(abs(nx / l * x + ny / l * y + nz / l * z), 5) + 0.0 AS away, round(abs(nx / l), 5) + 0.0 AS ax FROM u""")
def face_normals(t: Tables) -> DataFrame:
    w = Window.partitionBy("mesh").orderBy("i", "x", "y", "z")
    corners = [[F.col(a) if k == 0 else F.lead(a, k).over(w) for a in "xyz"] for k in range(3)]
    rows = _points(t).select("mesh", "i", *(c.alias(f"{n}{a}") for n, p in zip("abc", corners) for a, c in zip("xyz", p))).where("cx is not null")
    n = g.face_normal(*([F.col(f"{k}{a}") for a in "xyz"] for k in "abc"))
    e = [[F.col(f"{k}{a}") - F.col(f"a{a}") for a in "xyz"] for k in "bc"]
    area = F.sqrt(
        F.pow(e[0][1] * e[1][2] - e[0][2] * e[1][1], 2) + F.pow(e[0][2] * e[1][0] - e[0][0] * e[1][2], 2) + F.pow(e[0][0] * e[1][1] - e[0][1] * e[1][0], 2)
    )
    away = sum((x * F.col(f"a{a}") for x, a in zip(n, "xyz")), F.lit(0.0))
    # the normal itself is signed by `away`, which may be zero up to rounding: its size is compared
    out = rows.where(area > 1e-3).select("mesh", "i", F.abs(away).alias("away"), F.abs(n[0]).alias("ax"))
    return _round(out, ["mesh", "i"], "away", "ax", digits=5)


@query(f"WITH {_POINTS} SELECT mesh, i, round(-x, 6) + 0.0 AS ex, round(-z, 6) + 0.0 AS ey, round(-y, 6) + 0.0 AS ez FROM p")
def axis_export(t: Tables) -> DataFrame:
    out = g.export_axes(F.col("x"), F.col("y"), F.col("z"))
    return _round(_points(t).select("mesh", "i", *(c.alias(f"e{a}") for a, c in zip("xyz", out))), ["mesh", "i"], "ex", "ey", "ez")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 9 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, x * (2.51 * x + 0.03) / (x * (2.43 * x + 0.59) + 0.14))), 6) AS film,
       round(pow(greatest(0.0, least(1.0, x)), 1 / 2.2), 6) AS gamma, round(CASE WHEN x <= 0.0031308 THEN 12.92 * x ELSE 1.055 * pow(x, 1 / 2.4) - 0.055 END, 6) AS srgb FROM x
""")
def tone_curves(t: Tables) -> DataFrame:
    x = F.col("l_discount") * 9
    rows = t.lineitem.select("l_orderkey", "l_linenumber", g.aces(x).alias("film"), g.gamma(x).alias("gamma"), g.linear_to_srgb(x).alias("srgb"))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("film", "gamma", "srgb")))


def _pairs(t: Tables) -> DataFrame:
    """Each embedding with its successor as noise, and a time in [0, 1]."""
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    a = t.embeddings.select("vec_id", "label", as_double("embedding").alias("x0"), ((F.col("vec_id") % 11) / 10.0).alias("t"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), as_double("embedding").alias("eps"))
    return a.join(b, "vec_id")


_PAIRS = """p AS (SELECT a.vec_id, a.label, list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS z, (a.vec_id % 11) / 10.0::DOUBLE AS t
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


@query(f"""WITH {_PAIRS} SELECT vec_id, list_transform(z, lambda x: round((1 - t) * x[1] + (0.001::DOUBLE + (1 - 0.001::DOUBLE) * t) * x[2], 5) + 0.0) AS xt,
list_transform(z, lambda x: round((1 - 0.001::DOUBLE) * x[2] - x[1], 5) + 0.0) AS v, list_transform(z, lambda x: round(x[1], 5) + 0.0) AS back FROM p""")
def diffuse_velocity(t: Tables) -> DataFrame:
    s = 0.001
    rows = _pairs(t).withColumn("xt", flow.diffuse(F.col("x0"), F.col("eps"), F.col("t"), s)).withColumn("v", flow.velocity(F.col("x0"), F.col("eps"), s))
    # features are floats: to their precision what is recovered is the feature itself, without the last bits that the way there and back adds
    back = F.transform(flow.recovered_x0(F.col("xt"), F.col("v"), F.col("t"), s), lambda x: x.cast("float").cast("double"))
    return rows.select("vec_id", _rounded("xt").alias("xt"), _rounded("v").alias("v"), _rounded(back).alias("back"))


@query(f"""WITH {_PAIRS}, g AS (SELECT *, CASE WHEN t BETWEEN 0.5 AND 0.9 THEN 7.5::DOUBLE ELSE 1.0 END AS g FROM p)
SELECT vec_id, list_transform(z, lambda x: round(CASE WHEN g = 1 THEN x[1] ELSE g * x[1] + (1 - g) * x[2] END, 5) + 0.0) AS v FROM g""")
def cfg_blend(t: Tables) -> DataFrame:
    rows = _pairs(t).withColumn("g", flow.gate(F.col("t"), 0.5, 0.9, 7.5))
    return rows.select("vec_id", _rounded(flow.guided(F.col("x0"), F.col("eps"), F.col("g"))).alias("v"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, (l_quantity % 13)::INTEGER AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, i, round(5.0 * (1 - i / 12.0) / (1 + 4.0 * (1 - i / 12.0)), 9)::DOUBLE AS t FROM r""")
def euler_schedule(t: Tables) -> DataFrame:
    """Lines at the steps 0 to 12 of a schedule."""
    i = (F.col("l_quantity") % 13).cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", i.alias("i"), F.round(flow.schedule(i, 12, 5.0), 9).alias("t"))


@query("""
WITH u AS (SELECT label, ('0x' || substr(md5('cfg|' || label::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT label FROM embeddings))
SELECT vec_id, label, u.u < 0.3 AS dropped, list_transform(embedding, lambda x: CASE WHEN u.u < 0.3 THEN 0.0 ELSE x::DOUBLE END) AS kept FROM embeddings JOIN u USING (label)
""")
def cfg_dropout(t: Tables) -> DataFrame:
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("cfg"), F.col("label").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    batches = t.embeddings.select("label").distinct().withColumn("dropped", u < 0.3)
    rows = t.embeddings.join(batches, "label")
    return rows.select("vec_id", "label", "dropped", F.transform("embedding", lambda x: F.when(F.col("dropped"), 0.0).otherwise(x.cast("double"))).alias("kept"))


def _blurred(rows: str, axis: str, other: str) -> str:
    """Sums along one axis of 8 pixels, zeros outside."""
    sums = ", ".join(f"sum(w * {c}) AS {c}" for c in ("a", "b", "aa", "bb", "ab"))
    return f"SELECT vec_id, {other}, {axis} + d AS {axis}, {sums} FROM {rows}, k WHERE {axis} + d BETWEEN 0 AND 7 GROUP BY vec_id, {other}, {axis} + d"


@query(f"""
WITH k AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-d * d / 4.5::DOUBLE) AS w FROM range(-5, 6) t(d))),
e AS (SELECT x.vec_id, unnest(x.embedding)::DOUBLE AS a, unnest(y.embedding)::DOUBLE AS b, unnest(range(64)) AS i FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM e),
h AS ({_blurred("p", "x", "y")}), v AS ({_blurred("h", "y", "x")})
SELECT vec_id, round(avg((2 * a * b + 1e-4::DOUBLE) * (2 * (ab - a * b) + 9e-4::DOUBLE) / ((a * a + b * b + 1e-4::DOUBLE) * (aa - a * a + bb - b * b + 9e-4::DOUBLE))), 6) AS ssim FROM v GROUP BY vec_id
""")
def ssim(t: Tables) -> DataFrame:
    """Structural similarity of small grey images drawn from the embeddings, in Arrow batches."""
    a = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return images.ssim(a.join(b, "vec_id"), "vec_id", "a", "b", 8).withColumn("ssim", F.round("ssim", 6))


def _directions(n: int, squarings: int) -> str:
    """CTEs d0 to d<n-1> (q, one row each): leading directions of the Gram matrix g (a list of rows), each by squaring what the ones before have left."""
    out = ["g0 AS (SELECT g AS m FROM g)"]
    for r in range(n):
        out.append(f"p{r}_0 AS (SELECT m FROM g{r})")
        for k in range(squarings):
            size = "list_sum(list_transform(m, lambda a: list_dot_product(a, a)))"
            out.append(f"p{r}_{k + 1} AS MATERIALIZED (SELECT list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / {size})) AS m FROM p{r}_{k})")
        # every row of the power is a multiple of the direction; the one of greatest length is taken
        out.append(f"""l{r} AS (SELECT row FROM (SELECT unnest(m) AS row FROM p{r}_{squarings}) ORDER BY list_dot_product(row, row) DESC LIMIT 1),
s{r} AS (SELECT list_transform(row, lambda x: x / sqrt(list_dot_product(row, row))) AS q FROM l{r}),
d{r} AS MATERIALIZED (SELECT list_transform(q, lambda x: x * sign(list_extract(q, list_position(list_transform(q, lambda y: abs(y)), list_max(list_transform(q, lambda y: abs(y))))))) AS q FROM s{r}),
w{r} AS (SELECT q, m, list_dot_product(list_transform(m, lambda a: list_dot_product(a, q)), q) AS size FROM d{r}, g{r}),
g{r + 1} AS MATERIALIZED (SELECT list_transform(list_zip(m, q), lambda a: list_transform(list_zip(a[1], q), lambda b: b[1] - size * a[2] * b[2])) AS m FROM w{r})""")
    return ",\n".join(out)


@query(f"""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (vec_id) GROUP BY ALL),
g AS MATERIALIZED (SELECT list(row ORDER BY i) AS g FROM (SELECT i, list(v ORDER BY j) AS row FROM c GROUP BY i)), {_directions(3, 14)},
s AS (SELECT vec_id, [list_dot_product(v, d0.q), list_dot_product(v, d1.q), list_dot_product(v, d2.q)] AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d0, d1, d2),
u AS (SELECT vec_id, unnest(s) AS s, unnest(range(3)) AS i FROM s),
z AS (SELECT vec_id, i, (s - min(s) OVER (PARTITION BY i)) / nullif(max(s) OVER (PARTITION BY i) - min(s) OVER (PARTITION BY i), 0) AS z FROM u)
SELECT vec_id, list(round(coalesce(z, 0), 5) + 0.0 ORDER BY i) AS colour FROM z GROUP BY vec_id
""")
def pca_color(t: Tables) -> DataFrame:
    """Three leading directions of the features as colours in 0..1."""
    out = images.pca_colours(t.embeddings, "vec_id", "embedding")
    return out.withColumn("colour", _rounded("colour"))


@query("""
WITH p AS (SELECT vec_id, unnest(embedding) AS a, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings),
b AS (SELECT vec_id, min(i % 8) FILTER (WHERE a > 0.25) AS x0, max(i % 8) FILTER (WHERE a > 0.25) AS x1,
      min(i // 8) FILTER (WHERE a > 0.25) AS y0, max(i // 8) FILTER (WHERE a > 0.25) AS y1 FROM p GROUP BY vec_id)
SELECT vec_id, x0, x1, y0::BIGINT AS y0, y1::BIGINT AS y1, (CASE WHEN x0 IS NULL THEN 8 ELSE least(x0, y0, 7 - x1, 7 - y1) END)::BIGINT AS border,
       x0 IS NOT NULL AND least(x0, y0, 7 - x1, 7 - y1) <= 0 AS touches, x0 IS NULL OR least(x0, y0, 7 - x1, 7 - y1) > 1 AS too_far FROM b
""")
def alpha_boxes(t: Tables) -> DataFrame:
    """The bounding box of each small image's bright pixels and its distance to the border."""
    return images.alpha_box(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", 8, 0.25, far=1)

"""Sparse and ragged tensor queries; voxels come from line items, features from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import geometry
from lodestar.operators import merge, ragged, shard
from lodestar.plans.base import Tables, query

_VOXELS = """v AS (SELECT (l_orderkey % 4)::INTEGER AS batch_id, (l_partkey % 32)::INTEGER AS x, (l_suppkey % 32)::INTEGER AS y,
  ((l_orderkey // 4 + l_linenumber) % 32)::INTEGER AS z, l_quantity AS f FROM lineitem)"""
_CELLS = _VOXELS + ", c AS (SELECT batch_id, x, y, z, sum(f) AS f FROM v GROUP BY ALL)"


def _voxels(t: Tables) -> DataFrame:
    z = F.pmod(F.floor(F.col("l_orderkey") / 4) + F.col("l_linenumber"), F.lit(32))
    return t.lineitem.select(
        (F.col("l_orderkey") % 4).cast("int").alias("batch_id"), (F.col("l_partkey") % 32).cast("int").alias("x"),
        (F.col("l_suppkey") % 32).cast("int").alias("y"), z.cast("int").alias("z"), F.col("l_quantity").alias("f"),
    )


def _cells(t: Tables) -> DataFrame:
    return _voxels(t).groupBy("batch_id", "x", "y", "z").agg(F.sum("f").alias("f"))


def _rounded(arr, digits: int = 5):
    # scaled, rounded and scaled back in doubles, as the SQL rounds; F.round(x, digits) goes by the shortest decimal form, which may be a tie where x isn't
    # + 0.0 turns a rounded -0.0 into 0.0
    return F.transform(arr, lambda x: F.round(x * 10.0**digits) / 10.0**digits + 0.0)


@query(f"WITH {_VOXELS} SELECT batch_id, x // 4 AS x, y // 4 AS y, z // 4 AS z, round(avg(f), 6) AS f FROM v GROUP BY ALL")
def voxel_pool_mean(t: Tables) -> DataFrame:
    return ragged.pooled(_voxels(t), 4, ["f"], "mean").withColumn("f", F.round("f", 6))


@query(f"WITH {_VOXELS} SELECT batch_id, x // 4 AS x, y // 4 AS y, z // 4 AS z, max(f) AS f FROM v GROUP BY ALL")
def voxel_pool_max(t: Tables) -> DataFrame:
    return ragged.pooled(_voxels(t), 4, ["f"], "max")


@query(f"""WITH {_VOXELS}, d AS (SELECT DISTINCT batch_id, x // 8 AS x, y // 8 AS y, z // 8 AS z FROM v)
SELECT *, ((batch_id::BIGINT * 4 + x) * 4 + y) * 4 + z AS code, row_number() OVER (ORDER BY batch_id, x, y, z) - 1 AS inverse FROM d""")
def voxel_distinct_inverse(t: Tables) -> DataFrame:
    cells = ragged.distinct_cells(_voxels(t), 8).withColumn("code", ragged.linear_code(4))
    return shard.global_index(cells, [F.col("code")], "inverse")


@query(f"WITH {_VOXELS} SELECT DISTINCT batch_id, x // 2 AS x, y // 2 AS y, z // 2 AS z FROM v")
def occupancy_downsample(t: Tables) -> DataFrame:
    return ragged.distinct_cells(_voxels(t), 2)


def _reduced(t: Tables, name: str) -> DataFrame:
    rows = t.embeddings.select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return ragged.reduced(rows, "v", "label").select("label", F.round(name, 6).alias(name))


_PARTS = "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"{_PARTS} SELECT label, round(avg(v), 6) AS mean FROM e GROUP BY label")
def segment_mean(t: Tables) -> DataFrame:
    return _reduced(t, "mean")


@query(f"{_PARTS} SELECT label, round(sum(v), 6) AS sum FROM e GROUP BY label")
def segment_sum(t: Tables) -> DataFrame:
    return _reduced(t, "sum")


@query(f"{_PARTS} SELECT label, round(stddev_pop(v), 6) AS std_pop FROM e GROUP BY label")
def segment_std_pop(t: Tables) -> DataFrame:
    return _reduced(t, "std_pop")


@query("SELECT l_orderkey, round(product(1 + l_discount), 6) AS prod FROM lineitem GROUP BY l_orderkey")
def segment_prod(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", (1 + F.col("l_discount")).alias("v"))
    return ragged.reduced(rows, "v", "l_orderkey").select("l_orderkey", F.round("prod", 6).alias("prod"))


@query("""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, (sum(n) OVER (ORDER BY conv_id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY conv_id))::BIGINT AS stop FROM n
""")
def ragged_layout(t: Tables) -> DataFrame:
    return ragged.layout(t.conversations, "conv_id")


@query("""
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS slot, length(text) AS size FROM conversations),
s AS (SELECT conv_id, unnest(range(0, (SELECT max(slot) + 1 FROM r))) AS slot FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, slot::INTEGER AS slot, size, size IS NOT NULL AS mask FROM s LEFT JOIN r USING (conv_id, slot)
""")
def pad_to_dense(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    return ragged.padded(rows, "conv_id", "turn", "size")


@query(f"WITH {_VOXELS} SELECT max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM v")
def spatial_shape(t: Tables) -> DataFrame:
    return ragged.extent(_voxels(t))


@query(f"""WITH {_VOXELS} SELECT batch_id, x // 2 AS x, y // 2 AS y, z // 2 AS z, bit_or(1 << (x % 2 + 2 * (y % 2) + 4 * (z % 2)))::INTEGER AS mask
FROM v GROUP BY batch_id, x // 2, y // 2, z // 2""")
def subdivision_mask(t: Tables) -> DataFrame:
    return ragged.subdivision(_voxels(t))


@query(f"WITH {_CELLS} SELECT batch_id, x, y, z FROM c")
def unpool_children(t: Tables) -> DataFrame:
    return ragged.subdivided(ragged.subdivision(_voxels(t))).select("batch_id", "x", "y", "z")


_SLOTS = ", ".join(f"coalesce(max(f) FILTER (WHERE x % 2 = {s & 1} AND y % 2 = {s >> 1 & 1} AND z % 2 = {s >> 2}), 0)" for s in range(8))


@query(f"""WITH {_CELLS} SELECT batch_id, x // 2 AS x, y // 2 AS y, z // 2 AS z, [{_SLOTS}] AS feats FROM c GROUP BY batch_id, x // 2, y // 2, z // 2""")
def space_to_channel(t: Tables) -> DataFrame:
    return ragged.space_to_channel(_cells(t).withColumn("feats", F.array("f")), "feats", 1)


@query(f"WITH {_CELLS} SELECT batch_id, x, y, z, f FROM c")
def channel_to_space(t: Tables) -> DataFrame:
    packed = ragged.space_to_channel(_cells(t).withColumn("feats", F.array("f")), "feats", 1)
    masks = ragged.subdivision(_voxels(t))
    back = ragged.channel_to_space(packed.join(masks, ["batch_id", "x", "y", "z"]), "feats", 1, "mask")
    return back.select("batch_id", "x", "y", "z", F.col("feats")[0].alias("f"))


@query(f"""WITH {_CELLS}, w AS (SELECT *, ((batch_id::BIGINT * 6 + (x + 4) // 8) * 6 + (y + 4) // 8) * 6 + (z + 4) // 8 AS code FROM c)
SELECT code AS window, count(*) AS n FROM w GROUP BY code""".replace("AS window", 'AS "window"'))
def window_partition(t: Tables) -> DataFrame:
    return ragged.window_lengths(ragged.window_codes(_cells(t), 8, 4, 6))


@query("""
SELECT vec_id, label AS batch_id FROM embeddings WHERE label IS NOT NULL AND vec_id % 2 = 0
UNION ALL SELECT vec_id, label + 10 FROM embeddings WHERE label IS NOT NULL AND vec_id % 2 = 1
""")
def sparse_cat_batch(t: Tables) -> DataFrame:
    rows = t.embeddings.where("label is not null").select("vec_id", F.col("label").alias("batch_id"))
    return ragged.concat_batches([rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")], [10, 10])


@query("SELECT vec_id, list_concat(embedding[1:2], embedding[63:64]) AS feats FROM embeddings")
def sparse_cat_feat(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.slice("embedding", 1, 2).alias("feats"))
    b = t.embeddings.select("vec_id", F.slice("embedding", 63, 2).alias("feats"))
    return ragged.concat_features(a, b, ["vec_id"], "feats")


@query("""SELECT vec_id, w.place::INTEGER AS label FROM embeddings JOIN (VALUES (3, 0), (1, 1), (3, 2)) w(label_, place) ON label = label_""")
def batch_select(t: Tables) -> DataFrame:
    return ragged.select_batches(t.embeddings.select("vec_id", "label"), [3, 1, 3], "label")


@query(f"""WITH {_CELLS}, g AS (SELECT b.batch_id, x.x, y.y, z.z FROM (SELECT DISTINCT batch_id FROM c) b, range(0, 8) x(x), range(0, 8) y(y), range(0, 8) z(z)),
s AS (SELECT batch_id, x // 4 AS x, y // 4 AS y, z // 4 AS z, sum(f) AS f FROM c GROUP BY ALL)
SELECT g.batch_id, g.x::INTEGER AS x, g.y::INTEGER AS y, g.z::INTEGER AS z, coalesce(f, 0) AS f FROM g LEFT JOIN s ON g.batch_id = s.batch_id AND g.x = s.x AND g.y = s.y AND g.z = s.z""")
def dense_scatter(t: Tables) -> DataFrame:
    sparse = _cells(t).groupBy("batch_id", *(ragged.cell(a, 4).alias(a) for a in "xyz")).agg(F.sum("f").alias("f"))
    return ragged.dense(sparse, (8, 8, 8), "f")


@query(f"WITH {_CELLS} SELECT a.batch_id, a.x, a.y, a.z, b.f FROM c a JOIN c b ON b.batch_id = a.batch_id AND b.x = a.x AND b.y = a.y AND b.z = a.z WHERE (a.x + a.y + a.z) % 2 = 0")
def dense_gather(t: Tables) -> DataFrame:
    return ragged.gathered(_cells(t), _cells(t).where("(x + y + z) % 2 = 0"), ["batch_id", "x", "y", "z"])


@query(f"""WITH {_CELLS}, a AS (SELECT DISTINCT batch_id, x, y, z FROM c WHERE x % 5 <> 0), b AS (SELECT DISTINCT batch_id, x, y, z FROM c WHERE y % 5 <> 0)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def coord_mismatch(t: Tables) -> DataFrame:
    c = _cells(t)
    return merge.coordinate_mismatch(c.where("x % 5 <> 0"), c.where("y % 5 <> 0"), ["batch_id", "x", "y", "z"])


@query(f"""WITH {_CELLS} SELECT a.batch_id, a.x AS from_x, a.y AS from_y, a.z AS from_z, b.x, b.y, b.z
FROM c a JOIN range(-1, 2) i(dx) ON true JOIN range(-1, 2) j(dy) ON true JOIN range(-1, 2) k(dz) ON true
JOIN c b ON b.batch_id = a.batch_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz""")
def neighbor_pairs(t: Tables) -> DataFrame:
    return ragged.neighbours(_cells(t))


@query("""
WITH m AS (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
v AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY label)
SELECT vec_id, label, list_transform(embedding, lambda x, i: round(x::DOUBLE + m[i], 5) + 0.0) AS feats FROM embeddings JOIN v USING (label)
""")
def batch_broadcast_add(t: Tables) -> DataFrame:
    means = ragged.pooled_arrays(t.embeddings, ["label"], "embedding").withColumnRenamed("embedding", "mean")
    rows = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("feats"))
    return ragged.broadcast_add(rows, means, "feats", "mean", "label").select("vec_id", "label", _rounded("feats").alias("feats"))


@query("SELECT vec_id, list_transform(embedding, lambda x, i: round((x::DOUBLE - i / 64.0) / (1 + i / 64.0), 5) + 0.0) AS feats FROM embeddings")
def channel_standardize(t: Tables) -> DataFrame:
    feats = F.transform("embedding", lambda x: x.cast("double"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i / 64.0)
    out = ragged.standardised(feats, steps, F.transform(steps, lambda s: 1 + s))
    return t.embeddings.select("vec_id", _rounded(out).alias("feats"))


@query("""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
m AS (SELECT vec_id, e, list_sum(e) / len(e) AS m FROM s),
v AS (SELECT vec_id, list_transform(e, lambda x: x - m) AS c FROM m),
w AS (SELECT vec_id, c, list_sum(list_transform(c, lambda x: x * x)) / len(c) AS var FROM v)
SELECT vec_id, list_transform(c, lambda x: round(x / sqrt(var + 1e-5), 5) + 0.0) AS feats FROM w
""")
def layer_norm(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", _rounded(ragged.layer_norm(F.col("embedding"))).alias("feats"))


@query("""
SELECT l_orderkey, l_linenumber, packed, (packed & 1) <> 0 AS b0, ((packed >> 1) & 1) <> 0 AS b1, ((packed >> 2) & 1) <> 0 AS b2 FROM
(SELECT l_orderkey, l_linenumber, ((l_returnflag = 'R')::INTEGER + 2 * (l_linestatus = 'O')::INTEGER + 4 * (l_quantity > 25)::INTEGER)::INTEGER AS packed FROM lineitem)
""")
def bit_pack_roundtrip(t: Tables) -> DataFrame:
    packed = geometry.pack_bits(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 25)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", packed.alias("packed"))
    return rows.select("*", *(geometry.unpack_bit(F.col("packed"), i).alias(f"b{i}") for i in range(3)))


@query(f"""WITH {_VOXELS}, r AS (SELECT unnest(range(1536, 1023, -128)) AS resolution),
q AS (SELECT DISTINCT resolution, batch_id, round_even((x + 0.5) / 32 * (resolution / 16 - 1), 0)::INTEGER AS x, round_even((y + 0.5) / 32 * (resolution / 16 - 1), 0)::INTEGER AS y,
      round_even((z + 0.5) / 32 * (resolution / 16 - 1), 0)::INTEGER AS z FROM v, r),
n AS (SELECT resolution, count(*) AS n FROM q GROUP BY resolution)
SELECT resolution::INTEGER AS resolution, n FROM n WHERE n < 40000 OR resolution = 1024 ORDER BY resolution DESC LIMIT 1""")
def cell_budget_search(t: Tables) -> DataFrame:
    return ragged.budget_search(_voxels(t), 32, 1536, 40_000)


@query("SELECT l_orderkey, l_linenumber, trunc((l_partkey % 64 + 0.5) / 64 * (1024 // 16))::INTEGER AS cell FROM lineitem")
def cell_quantize_trunc(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", geometry.cell_truncated(F.col("l_partkey") % 64, 64, 1024).alias("cell"))


@query("SELECT l_orderkey, l_linenumber, round_even((l_partkey % 64 + 0.5) / 64 * (1024 // 16 - 1), 0)::INTEGER AS cell FROM lineitem")
def cell_quantize_even(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", geometry.cell_half_even(F.col("l_partkey") % 64, 64, 1024).alias("cell"))

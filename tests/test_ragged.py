import math

from pyspark.sql import functions as F

from lodestar.functions import flow, geometry
from lodestar.functions import text as names
from lodestar.operators import ragged
from lodestar.operators import telemetry as tm


def voxels(spark, points):
    return spark.createDataFrame([(0, *p, float(i)) for i, p in enumerate(points)], "batch_id int, x int, y int, z int, f double")


def test_pool_then_unpool_keeps_the_children(spark):
    points = [(0, 0, 0), (1, 0, 1), (5, 4, 3), (2, 2, 2), (3, 3, 3)]
    df = voxels(spark, points)
    back = ragged.subdivided(ragged.subdivision(df)).select("x", "y", "z")
    assert sorted(map(tuple, back.collect())) == sorted(points)


def test_space_to_channel_round_trip(spark):
    df = voxels(spark, [(0, 0, 0), (1, 0, 1), (5, 4, 3)]).withColumn("feats", F.array("f", F.lit(1.0)))
    packed = ragged.space_to_channel(df, "feats", 2)
    assert {len(r.feats) for r in packed.collect()} == {16}
    back = ragged.channel_to_space(packed.join(ragged.subdivision(df), ["batch_id", "x", "y", "z"]), "feats", 2, "mask")
    key = lambda r: (r.x, r.y, r.z, tuple(r.feats))
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))


def test_negative_cells_floor(spark):
    assert ragged.pooled(voxels(spark, [(-1, 0, 0)]), 2, ["f"]).first().x == -1


def test_absent_batches(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "batch_id int, v double")
    out = {r.batch_id: r for r in ragged.reduced(df, "v", batches=spark.createDataFrame([(1,), (2,)], "batch_id int")).collect()}
    assert (out[2].sum, out[2].prod, out[2].mean) == (0.0, 1.0, None) and out[1].std_pop == 1.0


def test_linear_code_round_trip(spark):
    df = voxels(spark, [(3, 1, 2), (7, 7, 7)]).withColumn("code", ragged.linear_code(8))
    out = df.select("x", "y", "z", *(c.alias(f"d{k}") for k, c in ragged.from_linear_code(F.col("code"), 8).items()))
    assert all((r.x, r.y, r.z) == (r.dx, r.dy, r.dz) for r in out.collect())


def test_flow_inverse(spark):
    row = spark.createDataFrame([([1.0, 2.0], [0.5, -1.0], 0.3)], "x array<double>, e array<double>, t double")
    row = row.withColumn("xt", flow.diffuse(F.col("x"), F.col("e"), F.col("t"), 0.01)).withColumn("v", flow.velocity(F.col("x"), F.col("e"), 0.01))
    back = row.select(flow.recovered_x0(F.col("xt"), F.col("v"), F.col("t"), 0.01).alias("b")).first().b
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(back, [1.0, 2.0]))


def test_time_bins_are_right_open(spark):
    ts = [0.0, 0.1, 0.3, 0.6, 0.7, 1.0]
    got = [r.b for r in spark.createDataFrame([(t,) for t in ts], "t double").select(tm.time_bin(F.col("t")).alias("b")).collect()]
    assert got == [0, 1, 2, 5, 6, None]


def test_quantise_truncates_and_rounds_to_even(spark):
    row = spark.range(1).select(
        geometry.quantise_u8(F.lit(0.999)).alias("q"), geometry.quantise_u8(F.lit(float("nan"))).alias("n"),
        geometry.cell_half_even(F.lit(2), 1, 32).alias("e"), names.range_list(F.lit("3,1-2,3")).alias("r"),
    ).first()
    assert (row.q, row.n, row.e, row.r) == (254, 0, 2, [1, 2, 3])


def test_halton_base_three(spark):
    got = [r.v for r in spark.range(4).select(geometry.radical_inverse(F.col("id"), 3).alias("v")).collect()]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, [0, 1 / 3, 2 / 3, 1 / 9]))


def test_ema_closed_form_is_the_recursion(spark):
    values, e = [3.0, 1.0, 4.0, 1.0, 5.0], 3.0
    for v in values[1:]:
        e = 0.9 * e + 0.1 * v
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, i int, v double")
    assert math.isclose(tm.ema(df, "s", "i", "v", 0.9).first().ema, e)


def test_no_python_where_expressions_do(spark):
    plan = ragged.pooled(voxels(spark, [(0, 0, 0)]), 2, ["f"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

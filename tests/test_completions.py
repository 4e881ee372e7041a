import pytest
from pyspark.sql import functions as F

import __spark_entry__

from lodestar.functions import flow, text
from lodestar.functions import geometry as g
from lodestar.operators import images, ragged, shard
from lodestar.operators import telemetry as tm
from lodestar.sources import datasets


def test_unpatched_is_the_inverse(spark):
    df = spark.createDataFrame([(x, y, z) for x in range(5) for y in range(3) for z in range(4)], "x int, y int, z int")
    back = ragged.unpatched(ragged.patches(df, 2), 2)
    assert sorted(map(tuple, back.select("x", "y", "z").collect())) == sorted(map(tuple, df.collect()))


def test_images_without_bright_pixels_are_far(spark):
    df = spark.createDataFrame([(1, [0.0] * 6), (2, [0.0] * 5 + [1.0])], "k int, p array<double>")
    rows = {r.k: r for r in images.alpha_box(df, "k", "p", 3, 0.5).collect()}
    assert (rows[1].x0, rows[1].border, rows[1].touches, rows[1].too_far) == (None, 3, False, True)
    assert (rows[2].x0, rows[2].border, rows[2].touches, rows[2].too_far) == (2, 0, True, False)


def test_epochs_follow_one_another(spark):
    df = spark.range(10).withColumn("payload", F.lit("x"))
    rows = shard.cycled(df, "id", "s", 15, 12).collect()
    assert sorted(r.step for r in rows) == list(range(15, 27))
    assert {r.id for r in shard.cycled(df, "id", "s", 20, 10).collect()} == set(range(10))
    assert shard.cycled(df.where("false"), "id", "s", 0, 5).count() == 0


def test_replacement(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, ok boolean")
    assert {r.i: r.used for r in shard.replaced(df, "i", F.col("ok"), "s").collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.used for r in shard.replaced(df, "i", F.lit(False), "s").collect()} == {None}


def test_angle_without_normals(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 0.0)], "i int, a double, b double")
    angle = {r.i: r.angle for r in tm.normal_angle(df, ["i"], ("a",) * 3, ("b",) * 3).collect()}
    assert angle[1] == -1 and angle[2] == pytest.approx(180, abs=0.01)


def test_rotation_keeps_lengths(spark):
    v = flow.rotary(F.array(*(F.lit(float(i)) for i in range(8))), [F.lit(3), F.lit(5)], 8)
    out = spark.range(1).select(v.alias("v")).first().v
    assert [out[i] ** 2 + out[i + 1] ** 2 for i in (0, 2, 4, 6)] == pytest.approx([1, 13, 41, 85])


def test_unknown_dataset():
    with pytest.raises(KeyError, match="no dataset 'nothing'"):
        datasets.named("nothing")


def test_normals_look_away_from_the_origin(spark):
    c = lambda *v: [F.lit(float(x)) for x in v]
    for corners in ((c(0, 0, 2), c(1, 0, 2), c(0, 1, 2)), (c(0, 0, 2), c(0, 1, 2), c(1, 0, 2))):
        assert spark.range(1).select(*g.face_normal(*corners)).first() == (0.0, 0.0, 1.0)
    below = spark.range(1).select(*g.face_normal(c(0, 0, -2), c(1, 0, -2), c(0, 1, -2))).first()
    assert below[2] == -1.0


def test_leaves_of_records(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 5}}'), (2, '{"a": 7}'), (3, "{}")], "i int, r string")
    small = lambda x: x < 3
    rows = df.select("i", text.any_leaf(F.col("r"), small).alias("some"), text.all_leaves(F.col("r"), small).alias("every")).collect()
    assert {r.i: (r.some, r.every) for r in rows} == {1: (True, False), 2: (False, False), 3: (False, True)}


def both(spark, folder, name, rows, column):
    """A vector query's arrays by vec_id, as Spark and as its SQL give them."""
    import duckdb

    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    got = {r["vec_id"]: r[column] for r in __spark_entry__.queries()[name](spark, str(folder)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    sql = __spark_entry__.oracle_sql()[name]
    return got, dict(db.execute(f"SELECT vec_id, {column} FROM ({sql})").fetchall())


def test_features_at_a_tie_round_as_in_sql(spark, tmp_path):
    # (x - 61 / 64) / (125 / 64) is -0.519125, and that times 100,000 is below a half in doubles
    got, want = both(spark, tmp_path, "channel_standardize", [(1, [0.0] * 60 + [-0.060791015625] + [0.0] * 3, 0)], "feats")
    assert want[1][60] == -0.51912 and got == want


def test_euler_steps_at_a_tie_round_as_in_sql(spark, tmp_path):
    # by the step: 0.4 and not 0.35 + 0.05; by the rounding: 0.128125 either way
    pairs = {7: (0.13548928499221802, -0.18471428751945496), 8: (0.16284313797950745, 0.07715141773223877), 2: (-0.06859005987644196, -0.18643373250961304)}
    got, want = both(spark, tmp_path, "euler_step", [(k, list(pair), 0) for k, pair in pairs.items()], "x")
    assert [want[k][0] for k in pairs] == [0.20938, 0.12812, -0.04063] and got == want


def test_diffused_features_at_a_tie_round_as_in_sql(spark, tmp_path):
    # xt and v: in decimals a tie, in doubles above it; back: x0 is a tie itself, and comes back without a last bit off
    xt, v, back = (0.005284679122269154, -0.10285230726003647), (0.051480721682310104, 0.15100672841072083), (-0.109375, -0.11459928005933762)
    rows = [(k + i, [pair[i]], 0) for k, pair in ((2, xt), (8, v), (14, back)) for i in (0, 1)]
    for column, k, value in (("xt", 2, -0.01642), ("v", 8, 0.09938), ("back", 14, -0.10938)):
        got, want = both(spark, tmp_path / column, "diffuse_velocity", rows, column)
        assert want[k] == [value] and got == want
    # blended features are rounded by the same step
    got, want = both(spark, tmp_path / "blend", "cfg_blend", [(5, [0.13334466516971588], 0), (6, [-1.7272508978649626e-09], 0)], "v")
    assert want == {5: [1.00008]} and got == want


def test_colours_of_nearly_equal_directions_are_as_in_sql(spark, tmp_path):
    # the first two sizes differ by 0.01 %: fourteen squarings, as the SQL has them, leave the two mixed
    axes = [[0.600036, 0.800048, 0.0, 0.0], [-0.8, 0.6, 0.0, 0.0], [0.0, 0.0, 0.5, 0.0], [0.0, 0.0, 0.0, 0.25]]
    rows = [(4 * k + i, [x * s for x in axis], 0) for k, s in enumerate((1.0, -0.5, 0.3)) for i, axis in enumerate(axes)]
    got, want = both(spark, tmp_path / "mixed", "pca_color", rows, "colour")
    assert want[1][0] > 0.35 and got == want
    # equal ones, where any directions would do
    got, want = both(spark, tmp_path / "equal", "pca_color", [(i, [float(i == j) for j in range(6)], 0) for i in range(6)], "colour")
    assert got == want
    assert {r.id: r.colour for r in images.pca_colours(spark.createDataFrame([(1, [0.0, 0.0])], "id int, f array<double>"), "id", "f").collect()} == {1: [0.0] * 3}

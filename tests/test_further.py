import struct

import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as g
from lodestar.operators import ragged, select, shard
from lodestar.sources import readers


def test_binary_ply(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<fffB", *p, 7) for p in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)))
    (tmp_path / "q.ply").write_bytes(head + body + struct.pack("<Biii", 3, 0, 1, 2) + struct.pack("<Biiii", 4, 0, 1, 2, 3))
    rows = readers.read_ply_binary(spark, str(tmp_path / "q.ply")).orderBy("kind", "idx", "part").collect()
    assert [(r.idx, r.part, r.a, r.b, r.c) for r in rows if r.kind == "face"] == [(0, 0, 0, 1, 2), (1, 0, 0, 1, 2), (1, 1, 0, 2, 3)]
    assert [(r.a, r.b) for r in rows if r.kind == "vertex"] == [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_verified_files(spark, tmp_path):
    (tmp_path / "abc").write_bytes(b"abc")
    (tmp_path / "other").write_bytes(b"x")
    known = spark.createDataFrame([("ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",)], "sha256 string")
    assert [r.path.rsplit("/", 1)[1] for r in readers.verified_files(spark, str(tmp_path), known).collect()] == ["abc"]


def test_rejects_partition_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "i int, v int")
    good, bad = select.split_rejects(df, {"known": F.col("v").isNotNull(), "positive": F.col("v") > 0})
    assert [r.i for r in good.collect()] == [1]
    assert {r.i: r.broken for r in bad.collect()} == {2: ["known", "positive"], 3: ["positive"]}


def test_views_are_distinct_and_stable(spark):
    rows = spark.range(200).select(shard.chosen_views(F.col("id"), "s", 5, 3).alias("v"), shard.chosen_view(F.col("id"), "s", F.lit(5)).alias("one")).collect()
    assert all(len(set(r.v)) == 3 and r.v == sorted(r.v) for r in rows) and {r.one for r in rows} == set(range(5))


def test_pixel_shuffle_is_the_inverse(spark):
    df = spark.createDataFrame([(x, y, z, c) for x in range(4) for y in range(2) for z in range(2) for c in range(2)], "x int, y int, z int, c int")
    back = ragged.pixel_shuffled(ragged.pixel_unshuffled(df, 2), 2)
    assert sorted(map(tuple, back.select("x", "y", "z", "c").collect())) == sorted(map(tuple, df.collect()))


def test_attention_of_one_token_is_its_value(spark):
    df = spark.createDataFrame([(0, 0, [1000.0], [1000.0], [2.0, 3.0])], "b int, t int, q array<double>, k array<double>, v array<double>")
    assert ragged.attention(df, "b", "t", "q", "k", "v").first().out == [2.0, 3.0]


def test_relative_error_and_importers(spark):
    row = spark.range(1).select(
        g.relative_error(F.lit(0.0), F.lit(0.0)).alias("zero"), g.relative_error(F.lit(1.0), F.lit(2.0)).alias("half"),
        readers.importer_of(F.lit("a.b.GLB")).alias("glb"), readers.importer_of(F.lit("a.txt")).alias("none"),
    ).first()
    assert (row.zero, row.half, row.glb, row.none) == (0.0, 0.5, "gltf", None)


def test_duplicate_map_keys_are_an_error(spark):
    from lodestar.operators import merge

    df = spark.createDataFrame([({"a": 1}, {"a": 2})], "m map<string,int>, n map<string,int>")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        df.select(merge.merged_maps("m", "n")).collect()

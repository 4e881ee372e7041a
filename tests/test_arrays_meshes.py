import io

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from lodestar.sources import arrays, meshes
from lodestar.sources.entity_files import write_files


class Counting(io.BytesIO):
    """Counts the bytes that are read."""

    n = 0

    def read(self, size=-1):
        data = super().read(size)
        self.n += len(data)
        return data


def voxels(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return {"coords": rng.integers(0, 100, (n, 3)).astype(np.int32), "feats": rng.random((n, d)).astype(np.float32)}


@pytest.mark.parametrize("kind", ["npz", "vxz"])
def test_counts_and_columns_read_no_more_than_they_need(spark, kind):
    whole = voxels(20_000, 16)
    data = arrays.packed(kind, whole)
    read = {}
    for columns in ("name string, pos bigint", "name string, x int", "feats array<float>", arrays.SCHEMA):
        stream, schema = Counting(data), _parse_datatype_string(columns)
        rows = list(arrays._Reader("/nowhere", schema)._rows(f"/a/e1.{kind}", stream, arrays.to_arrow_schema(schema)))
        read[columns] = stream.n
        assert sum(r.num_rows for r in rows) == 20_000 and all(r.schema.names == schema.names for r in rows)
        if "x int" in columns:
            assert np.concatenate([np.asarray(r.column("x")) for r in rows]).tolist() == whole["coords"][:, 0].tolist()
        if "feats" in columns:
            assert np.allclose(np.concatenate([np.asarray(r.column("feats").flatten()) for r in rows]), whole["feats"].ravel())
    assert read["name string, pos bigint"] < 20_000 < len(data) / 10
    assert read["name string, x int"] < len(data) / 3 and read["feats array<float>"] < len(data)


def test_files_are_dealt_by_their_bytes():
    found = [("a", 70), ("b", 10), ("c", 10), ("d", 90), ("e", 1)]
    small = arrays.LEAST_BYTES
    assert [p.paths for p in arrays.dealt(found, 2 * small)] == [["a", "b"], ["c", "d"], ["e"]]
    assert [p.paths for p in arrays.dealt([("a", 9 * small), ("b", 1)], 2 * small)] == [["a"], ["b"]]


@pytest.mark.parametrize("kind", ["npz", "vxz"])
def test_voxels_come_back_from_their_files(spark, tmp_path, kind):
    rows = [(f"e{i % 3}", i % 4, i, -i, [float(i), 0.5]) for i in range(50)]
    df = spark.createDataFrame(rows, "name string, x int, y int, z int, f array<double>")
    arrays.write_voxels(df, str(tmp_path), "name", "f", kind)
    found = arrays.read_voxels(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 1
    assert sorted((r["name"], r["x"], r["y"], r["z"], list(r["feats"])) for r in found.collect()) == sorted((n, x, y, z, f) for n, x, y, z, f in rows)
    for name in ("e0", "e1", "e2"):
        own = found.where(F.col("name") == name).orderBy("pos").collect()
        assert [r["pos"] for r in own] == list(range(len(own))) and [(r["x"], r["y"]) for r in own] == sorted((r["x"], r["y"]) for r in own)
    assert {r["name"]: r["n"] for r in arrays.count_voxels(spark, str(tmp_path)).collect()} == {"e0": 17, "e1": 17, "e2": 16}
    assert spark.read.format("voxel_files").schema("pos bigint").load(str(tmp_path)).count() == 50
    with pytest.raises(Exception, match="no column w"):
        spark.read.format("voxel_files").schema("w int").load(str(tmp_path)).count()


def test_an_empty_folder_has_no_voxels(spark, tmp_path):
    assert arrays.read_voxels(spark, str(tmp_path)).count() == 0


def test_a_file_that_is_no_container_is_an_error(spark, tmp_path):
    (tmp_path / "a.vxz").write_bytes(b"something else")
    with pytest.raises(Exception, match="not a voxel container"):
        arrays.read_voxels(spark, str(tmp_path)).count()


# --- meshes --------------------------------------------------------------------------------


@pytest.mark.parametrize("extra", [(), meshes.COLOUR, meshes.COLOUR_ALPHA, meshes.PBR])
def test_a_mesh_comes_back_as_it_was(spark, tmp_path, extra):
    points = [("m1", i, i + 0.5, -1.0 * i, 0.25, *((7 * i + j) % 256 for j in range(len(extra)))) for i in range(6)] + [("m2", 0, 1.0, 2.0, 3.0, *([9] * len(extra)))]
    faces = [("m1", 0, [0, 1, 2]), ("m1", 1, [2, 3, 4, 5]), ("m1", 2, [5, 4, 3])]
    v = spark.createDataFrame(points, "key string, v_idx int, x double, y double, z double" + "".join(f", {c} int" for c in extra)).repartition(3)
    f = spark.createDataFrame(faces, "key string, f_idx int, corners array<int>").repartition(2)
    rows = meshes.ply_payloads(v, f, "key", extra).withColumn("name", F.concat("key", F.lit(".ply")))
    write_files(rows, str(tmp_path), "name", "ply")
    vertices, corners = meshes.read_meshes(spark, str(tmp_path))
    name = F.regexp_extract("path", r"(m\d)\.ply", 1).alias("key")
    got = sorted((r["key"], r["v_idx"], *(r["properties"][c] for c in ("x", "y", "z", *extra))) for r in vertices.select(name, "v_idx", "properties").collect())
    assert got == sorted(points)
    assert sorted((r["key"], r["f_idx"], list(r["corners"])) for r in corners.select(name, "f_idx", "corners").collect()) == faces
    parts = corners.select("f_idx", F.explode(meshes.triangles(F.col("corners"))).alias("c")).collect()
    assert sorted((r["f_idx"], list(r["c"])) for r in parts) == [(0, [0, 1, 2]), (1, [2, 3, 4]), (1, [2, 4, 5]), (2, [5, 4, 3])]


def test_a_header_tells_what_a_file_holds():
    data = meshes.ply_bytes(np.array([[1.0, 2.0, 3.0, 255]]), [], ("red",))
    assert data.startswith(b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\n") and b"property uchar red\nelement face 0\n" in data
    assert meshes.parsed(data)["vertex"][0]["red"].tolist() == [255]
    with pytest.raises(ValueError):
        meshes.parsed(data.replace(b"binary_little_endian", b"ascii"))


def test_a_face_of_five_corners_is_an_error_as_triangles(spark):
    five = spark.range(1).select(F.explode(meshes.triangles(F.array(*(F.lit(i) for i in range(5))))))
    with pytest.raises(Exception, match="a face of 5 corners"):
        five.collect()


def test_a_read_of_vertices_passes_no_faces_and_packing_makes_no_lists(spark, tmp_path):
    n = 3000
    v = spark.range(n).select(F.lit("m1").alias("key"), F.col("id").alias("v_idx"), *(F.col("id").cast("double").alias(c) for c in "xyz"))
    f = spark.range(n - 4).select(F.lit("m1").alias("key"), F.col("id").alias("f_idx"), F.slice(F.array(*(F.col("id") + i for i in range(5))), 1, (3 + F.col("id") % 3).cast("int")).alias("corners"))
    rows = meshes.ply_payloads(v, f.unionByName(f.limit(1).withColumn("key", F.lit("none"))), "key")
    plan = rows._jdf.queryExecution().toString()
    assert "collect_list" not in plan  # no mesh as an array of arrays in the JVM, and so none as Python lists
    assert [r["key"] for r in rows.select("key").collect()] == ["m1"]
    write_files(rows.withColumn("name", F.concat("key", F.lit(".ply"))), str(tmp_path), "name", "ply")
    vertices, corners = meshes.read_meshes(spark, str(tmp_path))
    assert vertices._jdf.queryExecution().toString().count("corners") == 0
    assert vertices.where("properties['z'] = v_idx").count() == n
    assert {r["f_idx"]: list(r["corners"]) for r in corners.collect()} == {i: list(range(i, i + 3 + i % 3)) for i in range(n - 4)}

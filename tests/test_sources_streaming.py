import os

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.sources import readers, sinks
from lodestar.streaming import ingest, windows


def test_lists_and_optional_tables(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("\n# note\nset/k1\nk2 \nset/k1\n")
    assert sorted(r.key for r in readers.read_key_list(spark, str(tmp_path / "keys.txt")).collect()) == ["k1", "k2"]
    assert readers.read_optional(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    assert sorted(r.key for r in readers.keys_of(spark, "a,b").collect()) == ["a", "b"]
    (tmp_path / "t.csv").write_text("a,score\n1,NaN\n2,3.5\n")
    assert [r.score for r in readers.read_table(spark, str(tmp_path / "t.csv"), "a int, score double").orderBy("a").collect()] == [None, 3.5]


def test_listing_matches_registry(spark, tmp_path):
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw/m1.glb").write_bytes(b"x")
    (tmp_path / "raw/m2.txt").write_bytes(b"x")
    registry = spark.createDataFrame([("h1", "set/m1.glb"), ("h2", "set/m2.glb")], "sha256 string, file_identifier string")
    found = readers.match_files(readers.list_files(spark, str(tmp_path / "raw"), ".glb"), registry).collect()
    assert [(r.sha256, r.local_path.endswith("raw/m1.glb")) for r in found] == [("h1", True)]


def test_ply_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 1.0, 0.0)], "sha256 string, v_idx int, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2)], "sha256 string, f_idx int, v0 int, v1 int, v2 int")
    (tmp_path / "m.ply").write_text(sinks.ply_lines(v, f).first().ply)
    vertices, faces = readers.read_ply_ascii(spark, str(tmp_path / "m.ply"))
    assert [tuple(r)[1:] for r in vertices.orderBy("v_idx").collect()] == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)]
    assert [tuple(r)[1:] for r in faces.collect()] == [(0, 0, 0, 1, 2)]


def test_ascii_ply_by_other_writers(spark, tmp_path):
    head = "ply\nformat ascii 1.0\ncomment by hand\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    text = head + "0 0  0\n1\t0 0 \n -1e0 1 0\nnan 2 0.5\n3 0 1 2\n4 0 1 2 3\n"
    (tmp_path / "a.ply").write_text(text)
    (tmp_path / "b.ply").write_bytes(text.replace("\n", "\r\n").encode())
    for name in "ab":
        vertices, faces = readers.read_ply_ascii(spark, str(tmp_path / f"{name}.ply"))
        assert [str(tuple(r)[1:]) for r in vertices.orderBy("v_idx").collect()] == ["(0, 0.0, 0.0, 0.0)", "(1, 1.0, 0.0, 0.0)", "(2, -1.0, 1.0, 0.0)", "(3, nan, 2.0, 0.5)"]
        assert sorted(tuple(r)[1:] for r in faces.collect()) == [(0, 0, 0, 1, 2), (1, 0, 0, 1, 2), (1, 1, 0, 2, 3)]
    os.makedirs(tmp_path / "deep/er")
    (tmp_path / "deep/er/c.ply").write_text(text)
    (tmp_path / "deep/_SUCCESS").write_text("")
    assert readers.read_ply_ascii(spark, str(tmp_path / "deep"), "*.ply")[0].count() == 4
    # the lines of a file are not joined again, nor matched one by one
    assert "array_join" not in vertices._jdf.queryExecution().toString()


def test_frames_fall_back_to_the_document(spark):
    df = spark.createDataFrame([("{\"camera_angle_x\": 0.5, \"frames\": [{\"file_path\": \"a\"}, {\"file_path\": \"b\", \"camera_angle_x\": 0.7}]}",)], "j string")
    doc = df.select(F.from_json("j", f"{readers.TRANSFORMS}, camera_angle_x double").alias("d")).select("d.*")
    assert [(r.view_idx, r.camera_angle_x) for r in readers.frames_of(doc).collect()] == [(0, 0.5), (1, 0.7)]


def test_incremental_merge(spark, tmp_path):
    schema = StructType.fromDDL("sha256 string, done boolean, size bigint")
    new, state, at = (str(tmp_path / x) for x in ("new", "state", "checkpoint"))
    for i, rows in enumerate([[("a", True, None), ("b", None, 2)], [("a", False, 5), ("b", None, None), ("c", True, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(new)
        ingest.fold_records(spark, new, schema, "sha256", state, at).awaitTermination()
    got = {r.sha256: (r.done, r.size) for r in ingest.latest_state(spark, state).collect()}
    assert got == {"a": (False, 5), "b": (None, 2), "c": (True, 1)}


def test_stream_and_table_agree(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(path)
    folder = tmp_path / "events"
    folder.mkdir()
    os.symlink(path, folder / "events.parquet")
    query = (
        windows.tumbling(spark.readStream.schema(table.schema).parquet(str(folder)), "1 hour").writeStream
        .format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    key = lambda r: (r.event_type, str(r.start), r.n)
    assert sorted(map(key, spark.table("hourly").collect())) == sorted(map(key, windows.tumbling(table, "1 hour").collect()))

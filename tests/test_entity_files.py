import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.sources import entity_files


def below(path):
    return sorted(os.path.join(d, f).removeprefix(f"{path}/") for d, _, names in os.walk(path) for f in names if not f.startswith("_"))


def test_one_file_for_each_row_and_for_each_name(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"set{i % 3}/e{i}.txt", f"text {i}") for i in range(20)], "i int, name string, text string")
    entity_files.write_files(rows, str(tmp_path / "a"), "name", "text")
    found = entity_files.files_below(spark, str(tmp_path / "a"), "*.txt").select(F.col("content").cast("string")).collect()
    assert sorted(r[0] for r in found) == sorted(f"text {i}" for i in range(20))
    pieces = rows.withColumn("name", F.concat(F.lit("f"), (F.col("i") % 4).cast("string"), F.lit(".txt")))
    entity_files.write_files(pieces, str(tmp_path / "b"), "name", "text", order="i")
    found = {r["path"].rpartition("/")[2]: bytes(r["content"]).decode() for r in entity_files.files_below(spark, str(tmp_path / "b"), "*.txt").collect()}
    assert found == {f"f{k}.txt": "".join(f"text {i}" for i in range(k, 20, 4)) for k in range(4)}
    assert not [d for d in os.listdir(tmp_path / "b") if d.startswith("_temporary")]


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    def fails(batches):
        for batch in batches:
            yield batch
            if 7 in batch.column("i").to_pylist():
                raise RuntimeError("a lost task")

    path = str(tmp_path / "a")
    rows = spark.range(0, 40, 1, 4).select(F.col("id").alias("i"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("name"), F.lit("x").alias("text"))
    with pytest.raises(Exception, match="a lost task"):
        entity_files.write_files(rows.mapInArrow(fails, rows.schema), path, "name", "text")
    assert below(path) == []
    entity_files.write_files(rows, path, "name", "text")
    assert len(below(path)) == 40


def test_an_attempt_that_is_not_committed_leaves_no_file(tmp_path, monkeypatch):
    import pyspark

    class Task:
        attempt = 0

        @classmethod
        def get(cls):
            return cls

        partitionId = staticmethod(lambda: 0)

        @classmethod
        def taskAttemptId(cls):
            cls.attempt += 1
            return cls.attempt

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    batch = pa.RecordBatch.from_pylist([{"name": "e", "content": b"x"}])
    writer = entity_files._Files(str(tmp_path), False)
    writer.write(iter([batch]))  # a speculative attempt whose result is not taken
    kept = writer.write(iter([batch]))
    assert below(tmp_path) and all(f.startswith("_temporary") for f in below(tmp_path))
    writer.commit([kept, None])
    assert below(tmp_path) == [f"part-00000-{writer.run}/e"]
    again = entity_files._Files(str(tmp_path), True)
    again.commit([again.write(iter([batch]))])
    assert below(tmp_path) == [f"part-00000-{again.run}/e"]
    given_up = entity_files._Files(str(tmp_path), True)
    given_up.abort([given_up.write(iter([batch]))])
    assert below(tmp_path) == [f"part-00000-{again.run}/e"]
    with pytest.raises(FileNotFoundError):  # still running after the abort
        given_up.write(iter([batch]))
    again = entity_files._Files(str(tmp_path), False)
    for names in (["../e"], ["/e"], [None], ["a", "b", "a"]):
        rows = pa.RecordBatch.from_pylist([{"name": n, "content": b"x"} for n in names], pa.schema([("name", pa.string()), ("content", pa.binary())]))
        with pytest.raises(ValueError):
            again.write(iter([rows]))
    assert len(below(tmp_path)) == 1

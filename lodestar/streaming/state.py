"""A registry that takes batches of records: key buckets of base and delta files under a manifest.

A batch adds one delta to each bucket that its keys fall in; other buckets are not read nor
written. A manifest names the folders of every bucket, oldest first, and the last batch
folded in. It is written beside the earlier ones and moved into place, so readers see a batch
whole or not at all, and a batch that is run again is known by its number. A bucket of many deltas is
rewritten as one, alone. Folders that neither of the last two manifests names are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType, _parse_datatype_string

from lodestar.operators.merge import first_non_null
from lodestar.sources.entity_files import opened


@dataclass
class Manifest:
    number: int = -1
    batch: int = -1
    #: Generations of each bucket, oldest first.
    buckets: dict[str, list[int]] = field(default_factory=dict)


class BucketedState:
    """schema holds the key and the columns; of a column's values the newest that is not null counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, most_deltas: int = 8) -> None:
        self.spark, self.path, self.key, self.n, self.most = spark, path.rstrip("/"), key, buckets, most_deltas
        self.schema: StructType = _parse_datatype_string(schema)

    def _files(self) -> tuple[fs.FileSystem, str]:
        return opened(self.path)

    def _manifests(self) -> list[Manifest]:
        """Those there are, oldest first."""
        system, root = self._files()
        found = system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        out = []
        for x in sorted((x for x in found if x.extension == "json"), key=lambda x: x.base_name):
            with system.open_input_stream(x.path) as stream:
                out.append(Manifest(**json.loads(stream.read())))
        return out

    def latest(self) -> Manifest:
        return (self._manifests() or [Manifest()])[-1]

    def _swap(self, new: Manifest) -> None:
        system, root = self._files()
        system.create_dir(f"{root}/manifests", recursive=True)
        name = f"{root}/manifests/{new.number:010d}"
        with system.open_output_stream(f"{name}.new") as stream:
            stream.write(json.dumps(vars(new)).encode())
        system.move(f"{name}.new", f"{name}.json")

    def _write(self, rows: DataFrame, generation: int) -> list[str]:
        """Rows of different keys as a generation; the buckets they fall in."""
        rows = rows.select(*self.schema.names, F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int").alias("bucket")).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/generation={generation}")
        system, root = self._files()
        there = system.get_file_info(fs.FileSelector(f"{root}/data/generation={generation}"))
        return [x.base_name.partition("=")[2] for x in there if x.base_name.startswith("bucket=")]

    def _read(self, of: dict[str, list[int]]) -> DataFrame:
        """One row per key of those buckets."""
        paths = [f"{self.path}/data/generation={g}/bucket={b}" for b, some in of.items() for g in some]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        layout = StructType([*self.schema.fields]).add("generation", LongType()).add("bucket", IntegerType())
        rows = self.spark.read.schema(layout).option("basePath", f"{self.path}/data").parquet(*paths)
        return first_non_null(rows.drop("bucket").withColumn("_age", -F.col("generation")).drop("generation"), self.key, "_age").select(*self.schema.names)

    def fold(self, batch: DataFrame, number: int, order: str | None = None) -> None:
        """Takes a batch in; of a key's records the first non-null value by `order` counts. Null keys are left out."""
        last = self.latest()
        if number <= last.batch:
            return  # run again after a failure that came later
        rows = batch.where(F.col(self.key).isNotNull())
        rows = rows.withColumn("_order", F.col(order) if order else F.monotonically_increasing_id()).select(*self.schema.names, "_order")
        generation = max((g for some in last.buckets.values() for g in some), default=-1) + 1
        touched = self._write(first_non_null(rows, self.key, "_order"), generation)
        buckets = {b: [*last.buckets.get(b, []), *([generation] if b in touched else [])] for b in {*last.buckets, *touched}}
        self._swap(Manifest(last.number + 1, number, buckets))
        self._compact()

    def _compact(self) -> None:
        last = self.latest()
        full = {b: some for b, some in last.buckets.items() if len(some) > self.most}
        if not full:
            return
        generation = max(g for some in last.buckets.values() for g in some) + 1
        self._write(self._read(full), generation)
        self._swap(Manifest(last.number + 1, last.batch, last.buckets | dict.fromkeys(full, [generation])))
        self._clear()

    def _clear(self) -> None:
        """Deletes what only older manifests than the last two name, and those."""
        system, root = self._files()
        *old, before, last = self._manifests()
        named = lambda m: {(g, b) for b, some in m.buckets.items() for g in some}
        gone = set().union(*map(named, old)) - named(before) - named(last)
        for g, b in gone:
            path = f"{root}/data/generation={g}/bucket={b}"
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_dir(path)
        for m in old:
            system.delete_file(f"{root}/manifests/{m.number:010d}.json")

    def read(self) -> DataFrame:
        """The state after the last batch, one row per key."""
        return self._read(self.latest().buckets)

    def stream(self, records: DataFrame, checkpoint: str, order: str | None = None) -> StreamingQuery:
        """Folds a stream's new batches in, and ends."""
        fold = lambda batch, number: self.fold(batch, number, order)
        query = records.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

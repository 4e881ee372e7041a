"""Voxel files as a Python data source: `.npz` archives and `.vxz` containers, one entity each.

`spark.read.format("voxel_files").schema(...).load(folder)` gives a row per voxel with any of the columns
name, pos, x, y, z and feats. The schema says what is read: without x, y, z the coordinates stay on
disk, without feats the features do, and with name and pos alone only headers are read, so that counting needs
no bodies. Files are dealt to tasks by their bytes.

An `.npz` file has the members coords (n x 3 integers) and feats (n x d floats). A `.vxz` file is, in this order: the four
bytes VXZ1; the header's length as a little-endian uint32; the header, a JSON object with the number of voxels `n` and
`columns`, a list of {name, type, width, bytes}; and the columns one after another, each of n x width
little-endian numbers of that type, row by row, compressed by zlib to that many bytes.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestar.sources.entity_files import opened, write_files

FORMAT, MAGIC = "voxel_files", b"VXZ1"
SCHEMA = "name string, pos bigint, x int, y int, z int, feats array<float>"
#: Bytes of a task's files, what a small file counts as at least, and rows of a batch.
TASK_BYTES, LEAST_BYTES, ROWS = 64 << 20, 1 << 14, 1 << 15


class Npz:
    """The arrays of an archive; opening it reads the directory at its end."""

    def __init__(self, stream: BinaryIO) -> None:
        self.zip = zipfile.ZipFile(stream)

    def count(self) -> int:
        with self.zip.open("coords.npy") as member:
            version = np.lib.format.read_magic(member)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            return read(member)[0][0]

    def array(self, name: str) -> np.ndarray:
        with self.zip.open(f"{name}.npy") as member:
            found = np.lib.format.read_array(member, allow_pickle=False)
        return found if found.ndim == 2 else found.reshape(len(found), -1)


class Vxz:
    """The columns of a container, found by the lengths in its header."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream = stream
        head = stream.read(8)
        if head[:4] != MAGIC:
            raise ValueError("not a voxel container")
        size = struct.unpack("<I", head[4:])[0]
        header = json.loads(stream.read(size))
        self.n, self.columns, at = header["n"], {}, 8 + size
        for c in header["columns"]:
            self.columns[c["name"]] = (at, c)
            at += c["bytes"]

    def count(self) -> int:
        return self.n

    def array(self, name: str) -> np.ndarray:
        at, c = self.columns[name]
        self.stream.seek(at)
        data = zlib.decompress(self.stream.read(c["bytes"]))
        return np.frombuffer(data, np.dtype(c["type"]).newbyteorder("<")).reshape(self.n, c["width"])


KINDS = {"npz": Npz, "vxz": Vxz}


def packed(kind: str, arrays: dict[str, np.ndarray]) -> bytes:
    """The bytes of a file with these n x width arrays."""
    if kind == "npz":
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        return out.getvalue()
    bodies = [zlib.compress(a.astype(a.dtype.newbyteorder("<")).tobytes()) for a in arrays.values()]
    columns = [{"name": k, "type": a.dtype.name, "width": a.shape[1], "bytes": len(b)} for (k, a), b in zip(arrays.items(), bodies)]
    header = json.dumps({"n": len(next(iter(arrays.values()))), "columns": columns}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *bodies])


@dataclass
class Files(InputPartition):
    paths: list[str]


def dealt(found: list[tuple[str, int]], most: int = TASK_BYTES) -> list[Files]:
    """Files in order, as many to a task as have `most` bytes together."""
    out, held = [], most
    for path, size in found:
        if held >= most:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += max(size, LEAST_BYTES)
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        known = {c.split()[0] for c in SCHEMA.split(", ")}
        if not set(schema.names) <= known:
            raise ValueError(f"voxel files have no column {', '.join(sorted(set(schema.names) - known))}")
        self.path, self.schema = path, schema

    def partitions(self) -> list[Files]:
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        own = sorted((x.path, x.size) for x in found if x.extension in KINDS and "/_" not in x.path.removeprefix(root))
        # without bodies a file costs its header alone
        return dealt(own if {"x", "y", "z", "feats"} & set(self.schema.names) else [(p, 0) for p, _ in own]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        arrow = to_arrow_schema(self.schema)
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                yield from self._rows(path, stream, arrow)

    def _rows(self, path: str, stream: BinaryIO, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        name, _, kind = path.rpartition("/")[2].rpartition(".")
        voxels = KINDS[kind](stream)
        n = voxels.count()
        coords = voxels.array("coords") if {"x", "y", "z"} & set(arrow.names) else None
        feats = voxels.array("feats") if "feats" in arrow.names else None
        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            make = {
                "name": lambda: pa.array([name] * (b - a)), "pos": lambda: pa.array(np.arange(a, b)),
                **{c: lambda i=i: pa.array(np.ascontiguousarray(coords[a:b, i])) for i, c in enumerate("xyz")},
                "feats": lambda: pa.FixedSizeListArray.from_arrays(pa.array(feats[a:b].ravel()), feats.shape[1]),
            }
            yield pa.RecordBatch.from_arrays([make[f.name]().cast(f.type) for f in arrow], schema=arrow)


class VoxelFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)


def read_voxels(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The voxels of all files below a folder; only what the columns need is read."""
    spark.dataSource.register(VoxelFiles)
    there = [c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns]
    return spark.read.format(FORMAT).schema(", ".join(there)).load(path)


def count_voxels(spark: SparkSession, path: str) -> DataFrame:
    """name and n of every file, from headers."""
    return read_voxels(spark, path, ["name"]).groupBy("name").agg(F.count("*").alias("n"))


def write_voxels(df: DataFrame, path: str, name: str, feats: str, kind: str = "npz", mode: str = "append") -> None:
    """One file for each name, of columns x, y, z and an array of features, all of one length; voxels in order of x, y, z.

    A file is one task's work, as it is one object.
    """
    rows = df.select(F.concat(F.col(name).cast("string"), F.lit(f".{kind}")).alias("name"), *(F.col(c).cast("int").alias(c) for c in "xyz"), F.col(feats).cast("array<float>").alias("feats"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in "xyz"])
        coords = np.stack([np.asarray(table.column(c)) for c in "xyz"], axis=1).astype(np.int32)
        values = np.asarray(table.column("feats").combine_chunks().flatten(), dtype=np.float32).reshape(len(coords), -1)
        return pa.table({"name": [table.column("name")[0].as_py()], "content": pa.array([packed(kind, {"coords": coords, "feats": values})], pa.binary())})

    write_files(rows.groupBy("name").applyInArrow(pack, "name string, content binary"), path, "name", "content", mode=mode)

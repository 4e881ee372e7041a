"""Binary PLY files of meshes: payloads with or without colours and materials, and their reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lodestar.sources.entity_files import files_below

#: Properties of a vertex after x, y and z, all of them uchar, in the order they have in a file. Fixed values.
COLOUR = ("red", "green", "blue")
COLOUR_ALPHA = (*COLOUR, "alpha")
PBR = (*COLOUR, "metallic", "roughness", "alpha")

#: Sizes of property types. Fixed values of the format.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4",
    "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}


def ply_bytes(vertices: np.ndarray, corners: list[list[int]], extra: tuple[str, ...] = ()) -> bytes:
    """A mesh as little-endian PLY: n x (3 + extra) vertices, and faces of any number of corners."""
    sizes = np.fromiter(map(len, corners), np.int64, len(corners))
    return _packed(vertices, sizes, np.array([v for c in corners for v in c], "<i4"), extra)


def _packed(vertices: np.ndarray, sizes: np.ndarray, corners: np.ndarray, extra: tuple[str, ...]) -> bytes:
    """`ply_bytes` with the corners of all faces in one array."""
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {len(vertices)}", *(f"property float {c}" for c in "xyz")]
    lines += [*(f"property uchar {c}" for c in extra), f"element face {len(sizes)}", "property list uchar int vertex_indices", "end_header", ""]
    rows = np.zeros(len(vertices), [*((c, "<f4") for c in "xyz"), *((c, "u1") for c in extra)])
    for i, c in enumerate(rows.dtype.names):
        rows[c] = vertices[:, i]
    if len(sizes) and sizes.max() > 255:
        raise ValueError(f"a face of {sizes.max()} corners")
    # a face is the byte of its size and its corners: all bytes that aren't sizes are corners, in order
    body = np.zeros(len(sizes) + 4 * len(corners), np.uint8)
    is_size = np.zeros(len(body), bool)
    is_size[np.arange(len(sizes)) + 4 * (np.cumsum(sizes) - sizes)] = True
    body[is_size], body[~is_size] = sizes, corners.astype("<i4").view(np.uint8)
    return "\n".join(lines).encode("ascii") + rows.tobytes() + body.tobytes()


def ply_payloads(vertices: DataFrame, faces: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """key, ply: vertices of key, v_idx, x, y, z and the extra columns; faces of key, f_idx and an array `corners`.

    Rows of a mesh meet as Arrow columns, and no row is made into a Python object. Faces without any vertex are left out.
    """
    names = ["x", "y", "z", *extra]
    v = vertices.select(key, "v_idx", *(F.col(c).cast("double").alias(c) for c in names))
    f = faces.select(key, "f_idx", F.col("corners").cast("array<int>").alias("corners"))
    kind = dict(v.dtypes)[key]

    def pack(keys: tuple, points: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(points.column("v_idx").to_numpy(), kind="stable")
        table = np.stack([points.column(c).to_numpy()[order] for c in names], axis=1)
        lists = own.column("corners").combine_chunks().take(pa.array(np.argsort(own.column("f_idx").to_numpy(), kind="stable")))
        content = [_packed(table, lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), extra)] if len(table) else []
        return pa.table({key: pa.array([keys[0].as_py()] * len(content), points.schema.field(key).type), "ply": pa.array(content, pa.binary())})

    return v.groupBy(key).cogroup(f.groupBy(key)).applyInArrow(pack, f"{key} {kind}, ply binary")


def parsed(content: bytes) -> dict[str, tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """Per element, its single-valued properties as arrays and its list property: the lists' sizes and all their values."""
    end = content.index(b"end_header") + len(b"end_header")
    end = content.index(b"\n", end) + 1
    lines = [x.split() for x in content[:end].decode("ascii").splitlines()]
    if ["format", "binary_little_endian", "1.0"] not in lines:
        raise ValueError("not a binary little-endian PLY file")
    elements: list[tuple[str, int, list[list[str]]]] = []
    for words in lines:
        if words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    out, at = {}, end
    for name, n, properties in elements:
        if any(p[0] == "list" for p in properties):
            if len(properties) != 1:
                raise ValueError(f"element {name} has a list beside other properties")
            rows, at = _lists(content, at, n, TYPES[properties[0][1]], TYPES[properties[0][2]])
            out[name] = ({}, rows)
        else:
            kind = np.dtype([(p[1], TYPES[p[0]]) for p in properties])
            table = np.frombuffer(content, kind, n, at)
            out[name] = ({c: table[c] for c in kind.names}, _NONE)
            at += n * kind.itemsize
    return out


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _lists(content: bytes, at: int, n: int, size_type: str, value_type: str) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Sizes and values of n lists from a place on, and where they end; lists of one length are read as a table."""
    if not n:
        return _NONE, at
    sizes, values = np.dtype(size_type), np.dtype(value_type)
    k = int(np.frombuffer(content, sizes, 1, at)[0])
    table = np.dtype([("k", sizes), ("v", values, (k,))])
    if at + n * table.itemsize <= len(content):
        rows = np.frombuffer(content, table, n, at)
        if (rows["k"] == k).all():
            return (np.full(n, k), rows["v"].ravel()), at + n * table.itemsize
    # one size after another; the bytes between them are the values
    places, begin = np.zeros(n, np.int64), at
    found = np.zeros(n, np.int64)
    for i in range(n):
        k = content[at] if sizes.itemsize == 1 and size_type == "u1" else int(np.frombuffer(content, sizes, 1, at)[0])
        places[i], found[i] = at - begin, k
        at += sizes.itemsize + k * values.itemsize
    if at > len(content):
        raise ValueError("the file ends within its lists")
    rest = np.ones(at - begin, bool)
    rest[(places[:, None] + np.arange(sizes.itemsize)).ravel()] = False
    return (found, np.frombuffer(content, np.uint8, at - begin, begin)[rest].view(values)), at


def read_meshes(spark: SparkSession, path: str, pattern: str = "*.ply") -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): path, v_idx and the properties by name; path, f_idx and corners. Each is a read of its own, and passes no rows of the other."""
    files = files_below(spark, path, pattern).select("path", "content")

    def reader(kind: str, name: str, column: pa.DataType, rows: Callable[[dict], tuple[int, pa.Array]]) -> DataFrame:
        arrow = pa.schema([("path", pa.string()), (kind, pa.int32()), (name, column)])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for place, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    n, values = rows(parsed(content.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(place, pa.string()), n), pa.array(np.arange(n), pa.int32()), values.cast(column)], schema=arrow)

        return files.mapInArrow(read, from_arrow_schema(arrow))

    def points(found: dict) -> tuple[int, pa.Array]:
        columns = found["vertex"][0]
        n, k = len(next(iter(columns.values()))), len(columns)
        values = np.stack([x.astype(float) for x in columns.values()], axis=1)
        names = pa.array(list(columns)).take(pa.array(np.tile(np.arange(k), n)))
        return n, pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), names, pa.array(values.ravel()))

    def faces(found: dict) -> tuple[int, pa.Array]:
        sizes, values = found.get("face", ({}, _NONE))[1]
        return len(sizes), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.astype(np.int32)))

    return reader("v_idx", "properties", pa.map_(pa.string(), pa.float64()), points), reader("f_idx", "corners", pa.list_(pa.int32()), faces)


def triangles(corners: Column) -> Column:
    """A face as triangles around its first corner; other faces than triangles and quads are an error."""
    three = F.array(corners)
    four = F.array(F.slice(corners, 1, 3), F.array(corners[0], corners[2], corners[3]))
    wrong = F.raise_error(F.concat(F.lit("a face of "), F.size(corners).cast("string"), F.lit(" corners"))).cast("array<array<int>>")
    return F.when(F.size(corners) == 3, three).when(F.size(corners) == 4, four).otherwise(wrong)

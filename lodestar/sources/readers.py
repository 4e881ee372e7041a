"""Sources: typed tables, optional tables, key lists, directory listings and JSON documents.

Schemas are always given, never inferred; floating-point NaN becomes NULL on the way in, so
that a missing value behaves alike in every later comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from lodestar.sources.entity_files import opened


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL; Spark would else order it above every number."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_table(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """A table of a known schema; CSV with a header. Unreadable files and rows are skipped."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "PERMISSIVE").option("nanValue", "NaN")
    return nan_to_null(reader.format(fmt).load(path))


def _decoded(path: Column) -> Column:
    """A file's path as text, from the form that row metadata have it in."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^([A-Za-z0-9]+):/+", "$1:/")


def read_parts(spark: SparkSession, paths: list[str], schema: StructType | str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): a table of many parts, and path and problem of the files that can't be read.

    Files that gave no row are opened once more, each by a task of its own: a table without rows is fine, a broken
    one is told with its error. Paths are compared whole.
    """
    load = lambda: spark.read.schema(schema).option("ignoreCorruptFiles", "true").format(fmt).load(paths)
    full = F.regexp_replace("path", "^([A-Za-z0-9]+):/+", "$1:/")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(full.alias("path"))
    gave = load().select(_decoded(F.col("_metadata.file_path")).alias("path")).distinct()
    silent = there.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")).join(gave, "path", "left_anti")
    return nan_to_null(load()), silent.repartition("path").mapInArrow(_probe(fmt), "path string, problem string").where("problem IS NOT NULL")


def _probe(fmt: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """path, problem: why a file can't be read; null if it can."""

    def problem(path: str) -> str | None:
        system, inner = opened(path)
        try:
            with system.open_input_file(inner) as stream:
                if fmt == "parquet":
                    parquet.ParquetFile(stream).close()
                else:
                    while stream.read(1 << 20):
                        pass
        except (OSError, pa.ArrowException) as e:
            return f"{type(e).__name__}: {e}".splitlines()[0]
        return None

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(problem, paths), pa.string())], names=["path", "problem"])

    return probe


def contents_of(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """The bytes of df as Parquet files, one row each."""
    df.write.parquet(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content")


def listed_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The values of a layout column for which a folder of files is there; contents are not read."""
    return list_files(spark, path, ".parquet").select(F.regexp_extract("path", rf"{column}=([^/]+)/", 1).alias(column)).distinct()


def parts_after(spark: SparkSession, path: str, schema: str, after: int | None) -> DataFrame:
    """Records of a stage's parts, or of those ingested after a time; earlier folders are not read."""
    rows = spark.read.schema(f"{schema}, ingest_ts bigint").parquet(path)
    return rows if after is None else rows.where(F.col("ingest_ts") > after)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """The table if it exists, else an empty one of the same schema."""
    return read_table(spark, path, schema, fmt) if exists(spark, path) else spark.createDataFrame([], schema)


def read_key_list(spark: SparkSession, path: str, tail: bool = True) -> DataFrame:
    """Distinct keys of a list file: blank lines and # comments dropped, text after the last / kept."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.select((F.substring_index("value", "/", -1) if tail else F.col("value")).alias("key")).distinct()


def keys_of(spark: SparkSession, spec: str) -> DataFrame:
    """Keys from a file of keys if the spec names one, else from a comma-separated list."""
    if exists(spark, spec):
        return read_key_list(spark, spec, tail=False)
    return spark.range(1).select(F.explode(F.split(F.lit(spec), ",")).alias("key")).distinct()


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, name, stem and length of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), stem(name).alias("stem"), "length")


def match_files(files: DataFrame, registry: DataFrame, key: str = "sha256", identifier: str = "file_identifier") -> DataFrame:
    """key, local_path: files whose stem is the last part of a registry identifier."""
    tail = F.element_at(F.split(identifier, "/"), -1)
    return registry.select(key, stem(tail).alias("stem")).join(files.select("stem", F.col("path").alias("local_path")), "stem").select(key, "local_path")


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents, one per file, with their path."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("path", F.input_file_name())


TRANSFORMS = (
    "aabb array<array<double>>, scale double, offset array<double>, frames array<struct<file_path:string,"
    "camera_angle_x:double,transform_matrix:array<array<double>>,radius:double,original_radius:double,retries:int>>"
)


def frames_of(documents: DataFrame, required: bool = False) -> DataFrame:
    """One row per view of each transforms document; the angle falls back to the document's.

    If it is required, a view with neither ends the job with an error.
    """
    own = F.col("camera_angle_x") if "camera_angle_x" in documents.columns else F.lit(None).cast("double")
    rows = documents.select("*", F.posexplode("frames").alias("view_idx", "frame"))
    angle = [F.col("frame.camera_angle_x"), own]
    if required:
        angle.append(F.raise_error(F.lit("a view has no camera angle, nor has its document")).cast("double"))
    return rows.withColumn("camera_angle_x", F.coalesce(*angle)).drop("frames")


_PLY_HEADER = r"^(ply|format|comment|element|property|end_header)\b"


def read_ply_ascii(spark: SparkSession, path: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of ASCII PLY files; quads become two triangles, other faces are dropped.

    With a pattern, path is a folder, and files of such names at any depth are read. A folder is listed once; a path with
    wildcards would have the driver take each file that it meets as a path of its own, which takes it milliseconds a file.
    A file is one row: its lines keep their order, and header counts say which are which.
    """
    below = {"recursiveFileLookup": True, "pathGlobFilter": pattern} if pattern else {}
    text = spark.read.options(**below).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("value"))
    ends = text.withColumn("end", F.expr("locate('\nend_header', value)"))
    # counts are looked for in the header alone, and only lines that begin with a letter of its words are compared with them
    head = F.when(F.col("end") > 0, F.substr("value", F.lit(1), F.col("end"))).otherwise(F.col("value"))
    rest = F.when(F.col("end") > 0, F.substr("value", F.col("end") + 1)).otherwise(F.col("value"))
    count = lambda kind: F.regexp_extract("head", rf"element {kind} (\d+)", 1).cast("int")
    body = F.filter(F.split(rest, "\n"), lambda x: ~(x.between("c", "q") & x.rlike(_PLY_HEADER)))
    files = ends.select("path", head.alias("head"), body.alias("body")).select("path", count("vertex").alias("nv"), count("face").alias("nf"), "body")
    # one space is split at without a regular expression
    cells = lambda x: F.transform(F.filter(F.split(F.translate(x, "\t\r", "  "), " "), lambda w: w != ""), lambda v: v.cast("double"))
    v = files.select("path", F.posexplode(F.expr("slice(body, 1, nv)")).alias("v_idx", "line")).withColumn("v", cells(F.col("line")))
    vertices = v.select("path", "v_idx", *(F.col("v")[i].alias(c) for i, c in enumerate("xyz")))
    f = files.select("path", F.posexplode(F.expr("slice(body, nv + 1, nf)")).alias("f_idx", "line"))
    f = f.withColumn("c", F.transform(cells(F.col("line")), lambda v: v.cast("int")))
    tri = F.array(F.slice("c", 2, 3))
    quad = F.array(F.slice("c", 2, 3), F.array(F.col("c")[1], F.col("c")[3], F.col("c")[4]))
    parts = F.when(F.col("c")[0] == 3, tri).when(F.col("c")[0] == 4, quad)
    faces = f.select("path", "f_idx", F.posexplode(parts).alias("part", "t")).select("path", "f_idx", "part", *(F.col("t")[i].alias(f"v{i}") for i in range(3)))
    return vertices, faces


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """step, key, value, run: the long log of all runs. Of a step that several runs went through, the last one's entries count."""
    rows = spark.read.schema("step bigint, key string, value double, run int").option("basePath", path).parquet(f"{path}/run=*")
    return rows.groupBy("step", "key").agg(F.max_by("value", "run").alias("value"), F.max("run").alias("run"))


def verified_files(spark: SparkSession, path: str, expected: DataFrame, key: str = "sha256") -> DataFrame:
    """path, key of the files whose content has an expected SHA-256."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias(key))
    return found.join(expected.select(key), key, "left_semi").select("path", key)


#: File extensions by the importer that reads them. Fixed values.
IMPORTERS = {
    "obj": "obj", "glb": "gltf", "gltf": "gltf", "usd": "usd", "usda": "usd", "usdz": "usd", "fbx": "fbx",
    "stl": "stl", "dae": "collada", "ply": "ply", "abc": "alembic", "blend": "append",
}


def importer_of(name: Column) -> Column:
    """The importer for a file's extension in any letter case; null if there is none."""
    pairs = [x for e, i in IMPORTERS.items() for x in (F.lit(e), F.lit(i))]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))


def read_ply_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, kind ('vertex' or 'face'), idx, part and three values of binary little-endian PLY files.

    Vertices are float32 x, y, z first; faces are lists with a uint8 length and int32 indices.
    Quads become two triangles; faces of other lengths are an error.
    """

    def parse(batches):
        import numpy as np
        import pandas as pd

        for rows in batches:
            for name, content in zip(rows["path"], rows["content"]):
                end = content.index(b"end_header\n") + len(b"end_header\n")
                counts, widths, kind = {}, {}, ""
                for line in content[:end].decode("ascii").splitlines():
                    words = line.split()
                    if words[:1] == ["element"]:
                        kind, counts[words[1]] = words[1], int(words[2])
                    elif words[:1] == ["property"] and kind == "vertex":
                        widths.setdefault(kind, []).append({"float": 4, "float32": 4, "uchar": 1, "uint8": 1, "double": 8, "int": 4}[words[1]])
                stride, n = sum(widths["vertex"]), counts["vertex"]
                raw = np.frombuffer(content, np.uint8, n * stride, end).reshape(n, stride)
                xyz = raw[:, :12].copy().view("<f4").astype(float)
                yield pd.DataFrame({"path": name, "kind": "vertex", "idx": range(n), "part": 0, "a": xyz[:, 0], "b": xyz[:, 1], "c": xyz[:, 2]})
                out, at = [], end + n * stride
                for f in range(counts.get("face", 0)):
                    size = content[at]
                    if size not in (3, 4):
                        raise ValueError(f"{name}: a face of {size} corners")
                    v = np.frombuffer(content, "<i4", size, at + 1)
                    out.append((name, "face", f, 0, *map(float, v[:3])))
                    if size == 4:
                        out.append((name, "face", f, 1, float(v[0]), float(v[2]), float(v[3])))
                    at += 1 + 4 * size
                yield pd.DataFrame(out, columns=["path", "kind", "idx", "part", "a", "b", "c"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, kind string, idx int, part int, a double, b double, c double")

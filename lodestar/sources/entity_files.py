"""A committing sink of one file per entity, as a Python data source, and files in the shared folder for tasks.

`df.write.format("entity_files").save(path)` takes the rows (name string, content binary). A task
writes below a temporary folder of its own attempt; what it made is moved in as one folder,
`path/part-NNNNN-<run>`, when the job commits, and goes when it aborts. So a task that fails or is run twice leaves no
file, and the driver moves one folder for each task, however many entities there are.
"""

from __future__ import annotations

import re
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "entity_files"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    scheme, _, rest = path.rpartition("://") if "://" in path else ("", "", re.sub(r"^file:", "", path))
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), rest
    authority, _, inner = rest.partition("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/{urllib.parse.quote(inner)}")


@dataclass
class Written(WriterCommitMessage):
    """The temporary folder of a task's files (None without any) and the place it is to take."""

    folder: str | None
    part: str
    files: int


class _Files(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        # tasks make their folders in this one only, so that one still running after an abort fails and leaves nothing
        system, root = opened(path)
        system.create_dir(self._temporary(root), recursive=True)

    def _temporary(self, root: str) -> str:
        return f"{root}/_temporary-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Consecutive rows of one name make up one file; a name that comes again later is an error."""
        from pyspark import TaskContext

        system, root = opened(self.path)
        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}"
        folder = f"{self._temporary(root)}/{part}-{task.taskAttemptId()}"
        now, stream, files = None, None, 0
        system.create_dir(folder, recursive=False)
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    if name != now or stream is None:
                        if stream is not None:
                            stream.close()
                        stream, now, files = self._begin(system, folder, name), name, files + 1
                    if content.is_valid:
                        stream.write(content.as_buffer())
        except BaseException:
            if system.get_file_info(folder).type != fs.FileType.NotFound:
                system.delete_dir(folder)
            raise
        finally:
            if stream is not None:
                stream.close()
        return Written(folder if files else None, f"{part}-{self.run}", files)

    @staticmethod
    def _begin(system: fs.FileSystem, folder: str, name: str | None):
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"no name for a file: {name!r}")
        path = f"{folder}/{name}"
        if system.get_file_info(path).type != fs.FileType.NotFound:
            raise ValueError(f"the rows of {name!r} do not follow one another")
        if "/" in name:
            system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        there = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-")]
        for m in messages:
            if m is not None and m.folder:
                system.move(m.folder, f"{root}/{m.part}")
        if self.overwrite:
            for old in there:
                system.delete_dir(old)
        self._clear(system, root)
        system.open_output_stream(f"{root}/_SUCCESS", compression=None).close()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        """Deletes what attempts without a commit have left."""
        for last in (False, False, True):
            try:
                if system.get_file_info(self._temporary(root)).type != fs.FileType.NotFound:
                    system.delete_dir(self._temporary(root))
            except OSError:  # a task that is being ended may still have made a file
                if last:
                    raise
                time.sleep(1)


class EntityFiles(DataSource):
    """The sink's format; files are read again by `binaryFile`, see files_below."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Files:
        if {"name", "content"} - set(schema.names):
            raise ValueError("entity_files takes the columns name and content")
        return _Files(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, name: str, content: str, order: str | None = None, mode: str = "append") -> None:
    """One file for each row, or with `order` one for each name, its rows one after another in that order."""
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"), *([F.col(order).alias("order")] if order else []))
    if order:
        rows = rows.repartition("name").sortWithinPartitions("name", "order").drop("order")
    df.sparkSession.dataSource.register(EntityFiles)
    rows.write.format(FORMAT).mode(mode).save(path)


def files_below(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of all files below a folder; content is read only if it is asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.where(~F.element_at(F.split("path", "/"), -1).startswith("_")).select("path", "length", "content")

"""A function applied to every row, where an error becomes a row and not the end of the job."""

from __future__ import annotations

import contextlib
import multiprocessing
import time
from collections.abc import Callable, Iterator
from multiprocessing import connection

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

Func = Callable[[dict], dict | None]


def tried(func: Func, row: dict) -> tuple[dict | None, str | None]:
    """What func gives for a row, and the error's type and text if it raises."""
    try:
        return func(row), None
    except Exception as e:  # noqa: BLE001  whatever a row's function raises is that row's result
        return None, f"{type(e).__name__}: {e}"


#: Seconds until the rows after a silent one go on without it, and rows waited for at the same time in a task.
PATIENCE, AT_ONCE = 0.01, 32


class Child:
    """A process of its own that func runs in. A row that takes too long, or ends the process, costs this
    process and no other row: the next row gets a fresh one. It is a fork: func must not count on threads of the task."""

    _open: set = set()  # ends of this process of all pipes, which its forks let go

    def __init__(self, func: Func, timeout: float) -> None:
        self.func, self.timeout, self.process = func, timeout, None

    def _start(self) -> None:
        fork = multiprocessing.get_context("fork")  # func needs no pickling
        self.ours, theirs = fork.Pipe()
        self._open.add(self.ours)
        self.process = fork.Process(target=self._serve, args=(theirs,), daemon=True)
        self.process.start()
        theirs.close()

    def _serve(self, theirs) -> None:
        for ours in self._open:  # so that the end of the worker is the end of its children
            ours.close()
        try:
            while True:
                theirs.send(tried(self.func, theirs.recv()))
        except (EOFError, OSError):
            pass

    def begin(self, row: dict) -> None:
        """Hands a row over. An end of the process shows in `result`."""
        if self.process is None:
            self._start()
        self.row, self.began, self.queued = row, time.monotonic(), None
        with contextlib.suppress(OSError):
            self.ours.send(row)

    def _in_queue(self) -> float:
        """Seconds in which the process could have run but had no core; 0 where the system doesn't tell."""
        try:
            with open(f"/proc/{self.process.pid}/schedstat") as f:
                return int(f.read().split()[1]) / 1e9
        except (OSError, IndexError, ValueError):
            return 0.0

    def left(self) -> float:
        """Seconds that the row may still take. Time without a core doesn't count once the row is waited for beside others."""
        left = self.began + self.timeout - time.monotonic()
        return left if left > 0 or self.queued is None else left + self._in_queue() - self.queued

    def result(self, wait: float) -> tuple[dict | None, str | None] | None:
        """What the row gave, or None if it has given nothing yet after `wait` seconds and has time left."""
        try:
            if self.ours.poll(max(0.0, min(wait, self.left()))):
                return self.ours.recv()
            if self.left() > 0:
                return None
            error = f"TimeoutError: no result after {self.timeout:g} s"
        except (EOFError, OSError):
            self.process.join(self.timeout)
            error = f"ProcessError: the process ended with {self.process.exitcode}"
        self.end()
        return None, error

    def aside(self) -> None:
        self.queued = self._in_queue()

    def __call__(self, row: dict) -> tuple[dict | None, str | None]:
        self.begin(row)
        while (found := self.result(self.timeout)) is None:
            pass
        return found

    def end(self) -> None:
        """Ends the process, whatever it is doing."""
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self._open.discard(self.ours)
            self.ours.close()
            self.process = None


class Children:
    """Rows one after another in a child; a row that is silent keeps its child, is set aside, and the next rows go on in another.

    So rows that hang are waited for together, `at_once` at most, and a row's result may come after later rows' results.
    """

    def __init__(self, func: Func, timeout: float, at_once: int = AT_ONCE) -> None:
        self.make, self.at_once = lambda: Child(func, timeout), at_once
        self.free: list[Child] = []
        self.silent: list[Child] = []
        self.looked = 0.0

    def __call__(self, row: dict) -> Iterator[tuple[dict, dict | None, str | None]]:
        """Rows that are done by now, with their result and error."""
        child = self.free.pop() if self.free else self.make()
        self.silent.append(child)  # until it has a result, so that end() finds it
        child.begin(row)
        found = child.result(PATIENCE)
        if found is None:
            child.aside()
        else:
            self.free.append(self.silent.pop())
            yield row, *found
        if self.silent and time.monotonic() - self.looked >= PATIENCE:
            yield from self._done(0.0)
        while len(self.silent) >= self.at_once:
            yield from self._done(PATIENCE)

    def _done(self, wait: float) -> Iterator[tuple[dict, dict | None, str | None]]:
        if wait:
            connection.wait([c.ours for c in self.silent], wait)
        for child in list(self.silent):
            if (found := child.result(0.0)) is not None:
                self.silent.remove(child)
                self.free.append(child)
                yield child.row, *found
        self.looked = time.monotonic()

    def rest(self) -> Iterator[tuple[dict, dict | None, str | None]]:
        while self.silent:
            yield from self._done(PATIENCE)

    def end(self) -> None:
        for child in self.free + self.silent:
            child.end()


def per_row(df: DataFrame, key: str, func: Func, schema: str, timeout: float | None = None) -> DataFrame:
    """key, the columns of schema as func(row) gives them, and error.

    A row for which func gives None has no result row. One that raises has nulls and the error's type
    and text. Rows are handled one by one, in Arrow batches, wherever the table's partitions are.

    With a timeout in seconds, func runs in children of the task, and a row that hangs or that ends the
    process is an error row too. Rows that hang are waited for together (see Children), and rows are dealt out first: a file of few
    row groups, which would be read by as few tasks, may hold many of them.
    """
    result = _parse_datatype_string(schema)
    out = StructType([df.schema[key], *result.fields]).add("error", StringType())
    arrow, names = to_arrow_schema(out), [f.name for f in result.fields]

    def result_row(row: dict, found: dict | None, error: str | None) -> list[dict]:
        if error is not None:
            return [{key: row[key], **dict.fromkeys(names), "error": error}]
        return [] if found is None else [{key: row[key], **{n: found.get(n) for n in names}, "error": None}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in batch.to_pylist() for r in result_row(row, *tried(func, row))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def run_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        children = Children(func, timeout)
        try:
            for batch in batches:
                rows = [r for row in batch.to_pylist() for done in children(row) for r in result_row(*done)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_pylist([r for done in children.rest() for r in result_row(*done)], schema=arrow)
        finally:
            children.end()

    if not timeout:
        return df.mapInArrow(run, out)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run_apart, out)

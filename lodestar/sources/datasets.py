"""Named data sources: a table, filters that follow one another, and a way to collate samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Dataset:
    """metadata(spark, folder) is the table; each step of `keep` filters what the one before left."""

    metadata: Callable[[SparkSession, str], DataFrame]
    keep: tuple[Step, ...] = ()
    collate: Step = field(default=lambda rows: rows)

    def refined(self, *more: Step, collate: Step | None = None) -> Dataset:
        """The same source with further filters, as a subclass would add them."""
        return Dataset(self.metadata, (*self.keep, *more), collate or self.collate)

    def samples(self, spark: SparkSession, folder: str) -> DataFrame:
        rows = self.metadata(spark, folder)
        for step in self.keep:
            rows = rows.transform(step)
        return rows.transform(self.collate)


_KNOWN: dict[str, Dataset] = {}


def register(name: str, dataset: Dataset) -> Dataset:
    """A name stands for one source; a second one under the same name replaces it."""
    _KNOWN[name] = dataset
    return dataset


def named(name: str) -> Dataset:
    if name not in _KNOWN:
        raise KeyError(f"no dataset {name!r}; known: {', '.join(sorted(_KNOWN)) or 'none'}")
    return _KNOWN[name]

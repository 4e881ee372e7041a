"""Connected components of a link table, wholly as DataFrame steps.

Defined results: an empty link table has no nodes; links of a node with itself give none; repeated
links count once; null ends are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import DataFrameSchema, SharedTables

#: Links that a task joins by itself; what is left of a table of more is joined in rounds.
BLOCK_LINKS = 1 << 18


def _forests(most: int):
    """A function for batches of links (a, b): node, root of the components of each block of about `most` links."""
    schema = DataFrameSchema("node bigint, root bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}
        held = 0

        def find(x: int) -> int:
            while (y := above.setdefault(x, x)) != x:
                above[x] = above[y]
                x = y
            return x

        def labels() -> pa.RecordBatch:
            nodes = list(above)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], schema=schema.arrow())

        for batch in batches:
            if held and held + batch.num_rows > most:
                yield labels()
                above.clear()
                held = 0
            held += batch.num_rows
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                p, q = find(a), find(b)
                above[max(p, q)] = min(p, q)
        yield labels()

    return run


def connected_components(links: DataFrame, tables: SharedTables, name: str = "components") -> DataFrame:
    """node, root (the least node of its component) for each node of links (a, b).

    Links are joined in blocks of BLOCK_LINKS first, of which only each node's link with its
    block's root is left. A table of one block is done by then. Else, each round a node takes
    the least label among its neighbours' and its label's label, so labels travel twice as far
    each round. Every round's table is written to the shared folder; nothing of it passes the
    driver but one number that shows when labels stand still.
    """
    links = links.select("a", "b").where("a <> b")
    blocks = -(-links.count() // BLOCK_LINKS)
    forests = links.coalesce(max(1, blocks)).mapInArrow(_forests(BLOCK_LINKS), "node bigint, root bigint")
    if blocks <= 1:
        return tables.write(forests, name)
    links = tables.write(forests.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), f"{name}-forests")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = tables.write(both.distinct(), f"{name}-links")
    labels = tables.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    before, rounds = None, 0
    while (now := labels.agg(F.bit_xor(F.xxhash64("node", "root")), F.count("*")).first()) != before:
        before, rounds = now, rounds + 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("least"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "least").alias("root"))
        # a root is a node; its own label may be lower by now
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("farther"))
        new = step.join(jump, "root").select("node", F.least("root", "farther").alias("root"))
        labels = tables.write(new, f"{name}-{rounds}")
        if rounds > 1:
            tables.drop(f"{name}-{rounds - 2}")
    for done in ("links", "forests"):
        tables.drop(f"{name}-{done}")
    return labels


def merged(classes: DataFrame | None, links: DataFrame, tables: SharedTables, name: str) -> DataFrame:
    """classes (node, root) joined further by links (a, b), as a table: a class is its members' links with its root."""
    if classes is not None:
        links = links.select("a", "b").unionAll(classes.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return connected_components(links, tables, name)

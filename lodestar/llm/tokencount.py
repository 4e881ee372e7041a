"""Token counts from pre-token counts, without materialising ids.

1. The distinct pre-tokens of all texts are gathered with their frequencies (each task first
   counts its own), and each distinct one is tokenised once, for its number of pieces.
2. Per document, pre-token frequencies are joined to these numbers and summed. Word
   frequencies are heavy-tailed, so the join is in two parts: the `common` most frequent
   pre-tokens (a fixed number, so their broadcast has a bound that doesn't grow with the data)
   of at most SHORT bytes are joined where the text is read; what is rarer or longer goes through
   a shuffle join on the pre-token and back by row. What could make a hot key is common by
   definition, unless it is long; Spark splits such a key when it joins.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts and pre-tokens of any length
are counted whole; rows are kept one for one
(repeated rows and null ids too); special strings inside texts count as the library counts
them; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import DataFrameSchema, SharedTables, input_columns, map_texts, slices
from lodestar.llm.tokens import PreTokens, cut, default_path

#: Distinct units that a task holds before it passes their counts on, or remembers.
HELD = 600_000
#: Bytes of a pre-token that may be broadcast; longer ones are joined by shuffle.
SHORT = 64


def pretoken_frequencies(texts: DataFrame, path: str) -> DataFrame:
    """pretoken, n over the whole table."""
    schema = DataFrameSchema("pretoken string, n bigint")

    def run(batches):
        pre = PreTokens(path)
        held: Counter = Counter()
        firsts: Counter = Counter()

        def flush():
            found: Counter = Counter()
            for lead, counts in (("", firsts), (" ", held)):
                for unit, n in counts.items():
                    for p in pre.of(lead + unit):
                        found[p] += n
                counts.clear()
            keys = list(found)
            for at in range(0, len(keys), 100_000):
                run_ = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(run_, pa.string()), pa.array([found[k] for k in run_], pa.int64())], schema=schema.arrow())

        for whole in batches:
            for part in slices(whole, "text"):
                for text in part.column("text").to_pylist():
                    units, _ = cut(text or "", held)
                    if units:
                        firsts[units[0]] += 1
                        held.update(units[1:])
                if len(held) + len(firsts) > HELD:
                    yield from flush()
        yield from flush()

    return texts.select("text").mapInArrow(run, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(frequencies: DataFrame, path: str) -> DataFrame:
    """pretoken, n, pieces: each distinct pre-token is tokenised once."""

    def make():
        pre = PreTokens(path)
        return lambda batch, texts: {"pretoken": batch.column("pretoken"), "n": batch.column("n"), "pieces": pre.pieces(texts)}

    return map_texts(frequencies, "pretoken", None, "pretoken string, n bigint, pieces int", make=make)


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", common: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text."""
    path = path or default_path()
    spark = docs.sparkSession
    tables = SharedTables(spark, "tokencount")
    texts = input_columns(docs, id_col, text_col)
    pieces = tables.write(piece_counts(pretoken_frequencies(texts, path), path), "pieces")
    short = pieces.where(F.octet_length("pretoken") <= SHORT)
    top = short.where(F.col("n") >= _least_common(short, common)).select("pretoken", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column("pretoken").to_pylist(), top.column("pieces").to_pylist())))
    tables.write(_per_document(texts, known, path), "documents")
    done = spark.read.schema(_ROWS).parquet(tables.path("documents"))
    rare = (
        done.where(F.size("rest") > 0)
        .select("row", F.explode("rest").alias("x"))
        .select("row", F.col("x.pretoken").alias("pretoken"), F.col("x.n").alias("n"))
        .join(pieces.select("pretoken", "pieces"), "pretoken")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    )
    return done.join(rare, "row", "left").select(
        "doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    )


def _least_common(pieces: DataFrame, common: int) -> int:
    """The least frequency such that at most `common` pre-tokens have it or more.

    One row per distinct frequency is looked at, so no task sorts the pre-tokens themselves.
    """
    above = F.sum("of").over(Window.orderBy(F.desc("n")))
    by_n = pieces.groupBy("n").agg(F.count("*").alias("of")).withColumn("above", above)
    return by_n.where(F.col("above") <= common).agg(F.coalesce(F.min("n"), F.lit((1 << 63) - 1))).first()[0]


_ROWS = "row bigint, doc_id bigint, n_bytes bigint, known bigint, rest array<struct<pretoken:string,n:int>>"


def _per_document(texts: DataFrame, known, path: str) -> DataFrame:
    """Per row: the pieces of its common pre-tokens, and the frequencies of its rarer ones."""

    def make():
        pre, pieces = PreTokens(path), known.value
        common: dict[str, int] = {}  # unit -> pieces of its common pre-tokens
        rarer: dict[str, list[str]] = {}  # unit -> its rarer pre-tokens, if any
        first = TaskContext.get().partitionId() << 36
        seen = 0

        def learn(unit: str, lead: str) -> tuple[int, list[str]]:
            found = pre.of(lead + unit)
            return sum(pieces.get(p, 0) for p in found), [p for p in found if p not in pieces]

        def call(batch, texts):
            nonlocal seen
            sums, rests = [], []
            for text in texts:
                units, new = cut(text, common)
                total, rest = 0, Counter()
                if units:
                    total, more = learn(units.pop(0), "")
                    rest.update(more)
                    if len(common) < HELD:
                        for u in new:
                            common[u], more = learn(u, " ")
                            if more:
                                rarer[u] = more
                    elif new:
                        # no more room: new units are worked out where they stand
                        for u in units:
                            if u in new:
                                n, more = learn(u, " ")
                                total += n
                                rest.update(more)
                        units = [u for u in units if u not in new]
                    total += sum(map(common.__getitem__, units))
                    for u in units:
                        if u in rarer:
                            rest.update(rarer[u])
                sums.append(total)
                rests.append([{"pretoken": p, "n": n} for p, n in rest.items()])
            start = first + seen
            seen += len(texts)
            return {
                "row": range(start, start + len(texts)), "doc_id": batch.column("doc_id"),
                "n_bytes": batch.column("n_bytes"), "known": sums, "rest": rests,
            }

        return call

    with_bytes = texts.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return map_texts(with_bytes, "text", None, _ROWS, make=make)


def over_limit(counted: DataFrame, limit: int = 1024) -> DataFrame:
    """Adds over_limit: more tokens than the limit."""
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

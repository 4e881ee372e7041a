"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

1. Every document's size is its number of words; every source's, their sum.
2. Sources in code-point order (null last) carry the weights in turn and share the total of
   all sizes; a target stops at `most` times its source's size and the excess is shared anew
   by weight. In closed form the targets are min(cap, level * weight) for one common level.
3. Every document takes floor(target / source size) certain whole copies. What remains is a
   sample of documents without replacement: u is a uniform number drawn from the document's
   id and text, its random odds u / (1 - u) are divided by its inclusion odds, and documents are taken
   in ascending order of the quotient until the words reach the remainder. Inclusion odds are
   the source's remaining share, times (size / mean size) ** size_power: longer documents
   fill a sample that is counted in words with fewer draws.

The order is never sorted as a whole: quotients are counted into bins per source, the bin in
which the remainder is reached is found from the bins' sums, and only that bin's documents are
ordered. Each source so yields one threshold, and each document is compared with it. A source
that holds a third of all rows therefore meets in no task. Rows with the threshold's own
quotient, id and size are copies of one row; the threshold says how many of them are taken. These
are told by numbers that each task gives to its own rows, moved up by the tasks before it.

Tables of one row per source (or per source and bin, or source and task) pass through windows
over sources. Only they are broadcast, where Spark finds their files below its own threshold;
else it joins by shuffle.

Defined results: null or empty texts have size 0 and take 0 words; a null source is a source
of its own, listed last; null ids are ids like others, and rows with equal ids are drawn by
their texts; of rows with equal id, text and source as many are taken as come nearest to the
target; a table of empty texts has targets of 0; very long texts are sized whole; an empty table
gives an empty result; `mix` keeps all columns (its own four names replace clashing ones), and
`repeated` all without exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import SharedTables
from lodestar.operators.shard import quoted

#: Bins of the quotient per source. The bin at the threshold holds about 1/BINS of a source.
BINS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the digest of id and text; the same on every run and in every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def allocate(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size -> those and target. One row per source goes through these windows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumns(
        {"weight": F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("bigint"), "cap": F.col("source_size") * most}
    )
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    until, onward = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(until), F.lit(0))) / F.sum("weight").over(onward)
    levels = ranked.withColumn("level", level)
    # sources below the common level are capped; the highest level that caps no further source holds
    common = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    return levels.withColumn("common", common).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")).alias("target")
    )


def _same_source(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size and u of each row."""
    key, text = F.col(id_col).cast("bigint"), F.col(text_col)
    return docs.select(key.alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), uniform(key, text, seed).alias("u"), *more)


def _ranked(sized: DataFrame, plan: DataFrame, size_power: float) -> DataFrame:
    """sized with the plan's columns and q, the quotient of odds, and its bin."""
    share = F.col("share")
    odds = share / (1 - share) * F.pow(F.greatest(F.col("size"), F.lit(1)) / F.col("mean"), F.lit(size_power))
    q = F.when(share > 0, (F.col("u") / (1 - F.col("u"))) / odds)
    ranked = sized.join(plan, _same_source(F.col("source"), F.col("of_source"))).withColumn("q", q)
    return ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS))


def plan_mix(sized: DataFrame, tables: SharedTables, weights: tuple[int, ...], most: int, size_power: float) -> DataFrame:
    """One row per source: its size, target, certain copies and the threshold of its sample.

    The threshold is the last (q, id, size) of which rows are taken, how many rows have it
    (`tied`) and how many of them are taken (`some`).
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sums = tables.write(sums, "sources")
    targets = allocate(sums.select("source", "source_size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(rate)).withColumn("share", rate - F.col("whole"))
    plan = targets.alias("t").join(sums.alias("s"), _same_source(F.col("t.source"), F.col("s.source"))).select(
        F.col("t.source").alias("of_source"), F.col("t.source_size").alias("source_size"), "target", "whole", "share",
        F.greatest(F.col("t.source_size") / F.col("n_docs"), F.lit(1.0)).alias("mean"),
        (F.col("target") - F.col("whole") * F.col("t.source_size")).alias("rest"),
    )
    plan = tables.write(plan.coalesce(1), "plan")
    ranked = _ranked(sized, plan, size_power).where("q is not null")
    bins = ranked.groupBy("of_source", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    upto = Window.partitionBy("of_source").orderBy("bin")
    reached = bins.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") >= F.col("rest"))
    cut = reached.groupBy(F.col("of_source").alias("cut_source")).agg(
        F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("cut")
    )
    cut = tables.write(cut.coalesce(1), "cut")
    # rows of the bin at the threshold; equal (quotient, id, size) are one row here
    near = (
        ranked.join(cut, _same_source(F.col("of_source"), F.col("cut_source")))
        .where(F.col("bin") == F.col("cut.bin"))
        .groupBy("of_source", "q", "doc_id", "size")
        .agg(F.count("*").alias("tied"), F.max("rest").alias("rest"), F.max("cut.before").alias("before"))
    )
    ordered = Window.partitionBy("of_source").orderBy("q", F.col("doc_id").asc_nulls_first(), "size")
    words = F.col("tied") * F.col("size")
    before = F.col("before") + F.sum(words).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - words
    # a row is taken if more than half of it, or just half, still fits
    some = F.when(F.col("size") > 0, F.floor((F.col("rest") - before) / F.col("size") + 0.5)).when(before <= F.col("rest"), F.col("tied"))
    last = F.struct("q", F.col("doc_id").alias("id"), "size")
    threshold = (
        near.withColumn("some", F.least(some, F.col("tied")))
        .where("some > 0")
        .groupBy(F.col("of_source").alias("last_source"))
        .agg(F.max_by(F.struct(last.alias("last"), "tied", "some"), last).alias("at"))
    )
    done = (
        plan.join(cut, _same_source(F.col("of_source"), F.col("cut_source")), "left")
        .join(threshold, _same_source(F.col("of_source"), F.col("last_source")), "left")
        .select(*plan.columns, F.col("cut.bin").alias("cut_bin"), "at.last", "at.tied", "at.some")
    )
    done = tables.write(done.coalesce(1), "thresholds")
    for name in ("sources", "plan", "cut"):
        tables.drop(name)
    return done


def with_copies(sized: DataFrame, plan: DataFrame, tables: SharedTables, size_power: float) -> DataFrame:
    """sized with the plan's columns and `copies`, by comparing each row with its source's threshold."""
    ranked = _ranked(sized, plan, size_power)
    own = F.struct("q", F.col("doc_id").alias("id"), "size")
    drawn = (
        F.when(F.col("q").isNull(), False)
        # without a cut the whole source stays below the remainder
        .when(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")), True)
        .when(F.col("bin") > F.col("cut_bin"), False)
        .otherwise(F.coalesce(own <= F.col("last"), F.lit(False)))
    )
    ranked = ranked.withColumn("copies", (F.col("whole") + drawn.cast("int")).cast("bigint"))
    # only where some, not all, of a row's equals are taken must they be told apart
    if plan.where("some < tied").isEmpty():
        return ranked
    tie = F.coalesce(F.col("cut_bin").isNotNull() & (F.col("bin") == F.col("cut_bin")) & (own == F.col("last")) & (F.col("some") < F.col("tied")), F.lit(False))
    rows = tables.write(ranked.where(tie).withColumn("row", F.monotonically_increasing_id()), "tied")
    rows = rows.withColumn("task", F.shiftright("row", 33))
    per_task = Window.partitionBy("of_source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("of_source", "task").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(per_task), F.lit(0)))
    sizes = sizes.select(F.col("of_source").alias("its_source"), F.col("task").alias("its_task"), "earlier")
    number = F.row_number().over(Window.partitionBy("of_source", "task").orderBy("row")) + F.col("earlier")
    told = rows.join(sizes, _same_source(F.col("of_source"), F.col("its_source")) & (F.col("task") == F.col("its_task")))
    told = told.withColumn("copies", (F.col("whole") + (number <= F.col("some")).cast("int")).cast("bigint"))
    return ranked.where(~tie).unionByName(told.select(ranked.columns))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, size_power: float = 0.5, seed: int = 0,
) -> DataFrame:
    """docs with size, source_size, target and copies for each row.

    Sizes and odds come from one pass over the texts into a table of ids, sources and sizes;
    returned rows compute theirs again, so that texts are neither shuffled nor copied.
    """
    tables = SharedTables(docs.sparkSession, "mix")
    plan = plan_mix(tables.write(_sized(docs, id_col, source_col, text_col, seed), "sizes"), tables, weights, most, size_power)
    tables.drop("sizes")
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    rows = _sized(docs, id_col, source_col, text_col, seed, F.struct(*map(quoted, own)).alias("own"))
    return with_copies(rows, plan, tables, size_power).select("own.*", "size", "source_size", "target", "copies")


def mix_sizes(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, size_power: float = 0.5, seed: int = 0,
) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes), without the texts."""
    tables = SharedTables(docs.sparkSession, "mix")
    sized = tables.write(_sized(docs, id_col, source_col, text_col, seed), "sizes")
    plan = plan_mix(sized, tables, weights, most, size_power)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return with_copies(sized, plan, tables, size_power).select("doc_id", "size", "source_size", "target", taken)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, all columns kept."""
    source_col, id_col = options.get("source_col", "source"), options.get("id_col", "doc_id")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(options.get("text_col", "text")).alias("text"))
    kept = {k: v for k, v in options.items() if not k.endswith("_col")}
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mix(rows, **kept).where("copies > 0").select("row", copies).select("row.*")


#: The same rule over a table `documents` in DuckDB; one window per source does there.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap FROM sums),
levels AS (
  SELECT *, cap::DOUBLE / weight AS full_at,
         ((SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, n,
         least(cap::DOUBLE, (SELECT max(level) FROM levels WHERE level <= full_at) * weight) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
plan AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS share,
         target - floor(rate)::BIGINT * source_size AS rest,
         greatest(source_size::DOUBLE / n, 1.0) AS mean FROM rates),
ranked AS (
  SELECT s.doc_id, s.size, p.*,
         CASE WHEN share > 0 THEN (u / (1 - u)) / (share / (1 - share) * pow(greatest(s.size, 1)::DOUBLE / mean, 0.5)) END AS q
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - size / 2.0 AS half FROM ranked)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN q IS NOT NULL AND half <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""

"""The corpus pipeline: toxicity, near duplicates, benchmark items, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`. Every stage's result is written as Parquet in the shared folder and
read again as the next one's input, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, mixing, omh, tokenfile, toxicity
from lodestar.llm.common import SharedTables, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the classifier learns from the labels of its folds.

    Null and empty texts have a score like others; equal texts go or stay alike; whole texts are scored;
    without toxic labels, or rows, nothing goes; all columns stay, whatever their names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (name,) = fresh(docs, "toxicity")
    return toxicity.with_scores(docs, model, score_col=name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least id, null ids last.

    Null and empty texts are one class; of equal rows one stays; whole texts are compared; an empty table
    stays empty; all columns stay, whatever their names.
    """
    return omh.one_per_class(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and items hold nothing and are held nowhere; equal texts go or stay alike;
    whole texts are searched; empty tables lose nothing; all columns stay, whatever their names.
    """
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Null and empty texts have no words; a null source is a source; of equal rows as many are taken as
    fit the target; whole texts are counted; an empty table stays empty; all columns stay.
    """
    return mixing.repeated(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document copy, read from its token file.

    Null and empty texts are their end id alone; null ids come first; copies follow one another; an
    empty table gives no rows; other columns are left out.
    """
    tables = SharedTables(spark, "tokenfiles")
    tokenfile.write_tokens(docs, tables)
    return tokenfile.read_tokens(spark, tables)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: The classifier and the alignment are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    tables = SharedTables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

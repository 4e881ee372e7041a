"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import centroids, decontaminate, mixing, omh, pii, rlindex, secrets, tokencount, tokenfile, topk, toxicity, vectorcodes, warc
from lodestar.llm.common import SharedTables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_credentials(_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classify(_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op5_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlindex.remove_repeats(_table(spark, sf_dir, "documents"), with_kept=False)


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.over_limit(tokencount.count_tokens(_table(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = SharedTables(spark, "tokenfiles")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), tables)
    return tokenfile.read_tokens(spark, tables)


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(_table(spark, sf_dir, "embeddings"))


def op13_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = SharedTables(spark, "warc")
    warc.write_records(_table(spark, sf_dir, "pages"), tables)
    return warc.page_records(warc.read_records(spark, tables.path("archives")))


def queries() -> dict:
    found = (op1_secret_scan, op2_toxicity, op3_order_minhash, op4_personal_data, op5_run_length_index, op6_benchmark_leaks, op7_exact_top_k, op8_token_counts, op9_token_files, op10_pareto_mix, op11_elkan_clusters, op12_vector_codes, op13_warc_records)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_top_k": topk.ORACLE_SQL, "op10_pareto_mix": mixing.ORACLE_SQL, "op11_elkan_clusters": centroids.oracle_sql(), "op12_vector_codes": vectorcodes.oracle_sql(), "op13_warc_records": warc.ORACLE_SQL}

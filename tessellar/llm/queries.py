"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellar.llm import decontam, licenses, lm, media, mixing, oracles, pii, secrets, simhash, suffix, toxicity
from tessellar.llm.common import batch_rows, documents


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return media.report(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return suffix.remove(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return lm.report(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return simhash.report(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return pii.report(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def queries() -> dict:
    return {"op1_media": op1_media, "op2_suffix_dedup": op2_suffix_dedup, "op3_decontamination": op3_decontamination, "op4_mixing": op4_mixing, "op5_lm_scoring": op5_lm_scoring, "op6_simhash": op6_simhash, "op7_toxicity": op7_toxicity, "op8_licenses": op8_licenses, "op9_pii": op9_pii, "op10_secrets": op10_secrets}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()

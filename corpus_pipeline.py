"""A training corpus from raw documents: each stage takes all that the one before it kept.

Toxic documents go; one document of each group of near copies stays; documents that hold benchmark
items go; secrets are replaced by a mark; and what is left is mixed to the sources' target weights.
Each stage is written before the next begins; what it stored on the way, and the stage before it, go then.

Null and empty texts pass every stage (near-dedup keeps one of them); null ids and sources, repeated rows, empty
tables and extra columns of any name are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import decontam, mixing, secrets, simhash, toxicity
from tessellar.llm.common import batch_rows, discard, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return simhash.dedupe(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batch_rows(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
]

#: A trained classifier, fingerprints and alignments have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

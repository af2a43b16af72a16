"""A training-data pipeline: five operators of the llm subpackage, one after another.

Each stage takes all rows that its predecessor kept. Documents that the quality classifier
rejects go; one document of each near-duplicate group stays; documents that hold a
benchmark item go; secrets are masked in the texts; and the last stage mixes the sources to
their target weights, repeating documents where a target asks for it.

Every stage takes nulls in any column, empty and very long texts, repeated rows, further
columns of any name and empty tables; each says below what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope.llm import decontaminate, mixing, near_dedup, quality, secrets
from chimerascope.llm.shared import scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a classifier trained on the labels rejects.

    Rows are judged by their whole text, repeated ones alike; a null or empty text as one
    of no words. Without usable labels every score is one half, so all rows go. An empty
    table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group whose 5-word shingle sets are alike by 0.8 or more.

    The row with the smallest doc_id stays, one with a null id only where no other is;
    repeated rows are a group. Rows with null or blank texts all stay.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that contain 0.8 or more of a benchmark item's 5-word shingles; null and empty texts and repeated rows stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret in a text masked, and n_chars counted anew where there is such a column; no row goes, and null texts stay null."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the columns of documents and copy, a row for each time that a document is taken.

    Rows are taken one by one, so repeated and null ids don't change a source's share; a
    null source is one of its own, and rows without words aren't taken.
    """
    return mixing.mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The classifier's boosted tables and the sketches' seeded hashes can't be written in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each from the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

"""Cases to time, and the report on timed operations: counts, sums, median, 95th percentile, the slowest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope import schemas
from chimerascope.operators.coverage import at_ranks, nearest_rank
from chimerascope.sources.lake import Store


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Events from a JSON file of objects, a list or one a line. An unknown key, a value that is no text, a malformed object, no name, or a name used twice is an error that shows it."""
    raw = spark.read.option("multiLine", "true").json(path) if spark.read.text(path, wholetext=True).filter("ltrim(value) like '[%'").head() else spark.read.json(path)
    unknown = sorted(set(raw.columns) - set(schemas.EVENT) - {"_corrupt_record"})
    odd = sorted(name for name, kind in raw.dtypes if name in schemas.EVENT and kind != "string")
    if "_corrupt_record" in raw.columns or unknown or odd:
        raise ValueError(f"Malformed cases in {path}: " + ("no JSON object" if "_corrupt_record" in raw.columns else f"unknown keys {unknown}, other than text {odd}"))
    cases = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in schemas.EVENT])
    twice = cases.groupBy("event_id").count().filter("count > 1 or coalesce(event_id, '') = ''").head()
    if twice is not None:
        raise ValueError(f"Cases need names of their own: {twice['event_id']}")
    return cases


def summary(timings: DataFrame) -> DataFrame:
    """One row for each operation and phase of timings (operation, phase, ok, wall, cpu): successes, errors, sums of both times, median, nearest-rank 95th percentile and maximum of the wall time."""
    keys = ["operation", "phase"]
    counts = timings.groupBy(*keys).agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("errors"), F.sum("wall").alias("wall"), F.sum("cpu").alias("cpu"), F.max("wall").alias("max"))
    middle = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1, "p95": lambda n: nearest_rank(n, 95)}
    ranks = at_ranks(timings, keys, "wall", middle).withColumn("median", 0.5 * F.col("low") + 0.5 * F.col("high")).withColumnsRenamed({k: f"__{k}" for k in keys})
    met = counts.join(ranks, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return met.select(*keys, "successes", "errors", "wall", "cpu", "median", "p95", "max")


def slowest(timings: DataFrame, *, n: int = 5, tie: str) -> DataFrame:
    """The n operations of the longest wall time; equal ones by tie."""
    return timings.orderBy(F.desc("wall"), tie).limit(n)


def write_report(timings: DataFrame, path: str, *, tie: str, n: int = 5) -> None:
    """Both as JSON below path; an existing report is left alone."""
    if Store(timings.sparkSession).exists(path):
        raise FileExistsError(path)
    summary(timings).coalesce(1).write.json(f"{path}/summary")
    slowest(timings, n=n, tie=tie).coalesce(1).write.json(f"{path}/slowest")

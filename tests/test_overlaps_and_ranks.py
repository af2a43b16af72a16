"""Interval joins by levels of bins and values at ranks, against plain loops; one key for all rows stays spread."""

import random

import pytest
from pyspark.sql import functions as F

from chimerascope.operators import coverage, joins


def intervals(seed, n, keys, far=200_000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(-far, far)
        width = rng.choice([1, 2, 1024, 1025, 8192, 8193, rng.randrange(1, 3000), rng.randrange(1, far)])
        rows.append((i, rng.randrange(keys), start, start + width - 1))
    return rows + [(n, None, 0, 5), (n + 1, 0, None, 5), (n + 2, 0, 9, 5), (n + 3, 0, 1023, 1024)]


@pytest.mark.parametrize(("keys", "n"), [(1, 250), (20, 400)])
def test_each_overlapping_pair_once(spark, keys, n):
    a, b = intervals(1, n, keys), intervals(2, n, keys)
    left = spark.createDataFrame(a, "i int, k int, a int, b int")
    right = spark.createDataFrame(b, "j int, k int, c int, d int")
    got = joins.overlapping(left, right, ["k"], left_bounds=("a", "b"), right_bounds=("c", "d"))
    assert got.columns == ["i", "k", "a", "b", "j", "c", "d"]
    there = lambda x: None not in x and x[2] <= x[3]
    want = sorted((x[0], y[0]) for x in filter(there, a) for y in filter(there, b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_one_key_is_spread_by_place(spark):
    rows = spark.range(40_000).select(F.lit("chr1").alias("k"), (F.col("id") * 1000).alias("a"), (F.col("id") * 1000 + 50).alias("b"), "id")
    other = rows.select("k", F.col("a").alias("c"), (F.col("b") + 1000).alias("d"), F.col("id").alias("j"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = joins.overlapping(rows, other, ["k"], left_bounds=("a", "b"), right_bounds=("c", "d"))
        tasks = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 79_999 and len(tasks) >= 4 and max(tasks) < 30_000
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("keys", [1, 4])
def test_values_at_ranks(spark, keys):
    rng = random.Random(keys)
    rows = [(rng.choice([None, *range(keys)]), rng.choice([None, 7.0, 7.0, rng.random() * 100])) for _ in range(3000)]
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        want[k] = (own[0], own[(len(own) + 1) // 2 - 1], own[-(-95 * len(own) // 100) - 1], own[-1])
    ranks = {"first": lambda n: F.lit(1), "middle": lambda n: F.floor((n + 1) / 2), "p95": lambda n: coverage.nearest_rank(n, 95), "last": lambda n: n}
    got = coverage.at_ranks(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", ranks, blocks=6)
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == want
    assert coverage.at_ranks(spark.createDataFrame([], "k int, v double"), ["k"], "v", ranks).collect() == []

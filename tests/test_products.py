"""Splice products by number: every pattern once, in order, any number of them, spread over tasks; plans hold each derivation once."""

import itertools
import os
import re

import pytest
from pyspark.sql import functions as F

from chimerascope.operators import splicing
from chimerascope.plans import registry
from chimerascope.plans.annotate import annotate
from test_annotate import check, made  # noqa: F401 - a fixture

FOLDER = "/root/testdata/sf0.001"


def frame(spark, runs):
    rows = [(k, r) for k, r in runs.items()]
    return spark.createDataFrame(rows, "event_id string, runs array<array<int>>").withColumn("patterns", splicing.pattern_count(F.col("runs")).cast("long"))


@pytest.mark.parametrize("per_part", [1, 3, 1000])
def test_patterns_are_numbered_in_order(spark, per_part):
    runs = {"a": [], "b": [[5]], "c": [[1, 2, 3], [7], [8, 9]], "d": [[1, 2]] * 5}
    out = splicing.numbered_patterns(frame(spark, runs), per_part=per_part, spread=per_part == 1)
    got = {}
    for r in out.orderBy("event_id", "product").collect():
        assert r["part"] == r["product"] // per_part
        got.setdefault(r["event_id"], []).append(tuple(r["pattern"]))
    assert got == {k: list(itertools.product(*r)) for k, r in runs.items()}


def test_an_event_of_200000_products_is_spread(spark):
    runs = [[10 * i + j for j in range(1, 11)] for i in range(5)] + [[60, 61]]
    one = spark.createDataFrame([("e", runs, 200_000, True, "ENST1", "ATG" * 30)], "event_id string, runs array<array<int>>, patterns long, pair boolean, leading_transcript string, sequence string")
    segments = F.array(F.struct(F.lit(1).alias("start"), F.lit(90).alias("end"), F.lit(1).alias("slot"), F.lit("ENST1").alias("transcript_id"), F.lit(1).alias("cds_start"), F.lit(90).alias("cds_end")))
    made = splicing.products(one.withColumn("segments", segments), per_part=1000, spread=True)
    spread = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_distinct("product").alias("kinds")).collect()
    assert sum(r["n"] for r in spread) == sum(r["kinds"] for r in spread) == 200_000
    assert len(spread) >= 3 and max(r["n"] for r in spread) < 120_000


def test_ranges_of_one_product_give_the_same(spark, made):  # noqa: F811
    events, models = made
    check(events.collect(), models.collect(), annotate(events, models, per_part=1).collect())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize(("name", "most"), [("peptide_to_genome", 15), ("breakpoint_statuses", 15), ("retained_clip", 15)])
def test_plans_hold_each_derivation_once(spark, name, most):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert 3 < len(re.findall(r"transform\(", plan)) <= most


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_blocks_are_not_derived_again_to_ask_whether_there_are_any(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    plan = registry.queries()["cds_blocks_phase"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert 3 < len(re.findall(r"transform\(", plan)) <= 15
    assert not re.search(r"Join Inner.*transform\(", plan)

"""Interval coverage, runs and ranks over tables of any number of rows per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chimerascope.operators.scan import BLOCK, in_blocks, with_before


def covered_by_key(rows: DataFrame, keys: Sequence[str], start: str, end: str, *, blocks: int | None = None) -> DataFrame:
    """keys and covered: how many positions lie in at least one of a key's inclusive intervals; touching ones count once. A key's intervals may be spread over all blocks."""
    distinct = in_blocks(rows.select(*keys, start, end).distinct(), keys, [start, end], blocks=blocks)
    placed = with_before(distinct, keys, [start, end], {"__reached": ("max", F.col(end))})
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("__reached") + 1, F.col(start))) + 1)
    return placed.withColumn("__new", new).groupBy(*keys).agg(F.sum("__new").alias("covered"))


def numbered_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, *, blocks: int | None = None) -> DataFrame:
    """rows with run, the number from 1 of the stretch of equal kinds that each lies in; the order is total within a key. A key's rows may be spread over all blocks."""
    placed = with_before(in_blocks(rows, keys, order, blocks=blocks), keys, order, {"__previous": ("last", F.struct(F.col(kind).alias("kind")))})
    same = F.col("__previous").isNotNull() & F.col("__previous.kind").eqNullSafe(F.col(kind))
    changed = placed.withColumn("__new", F.when(same, 0).otherwise(1))
    counted = with_before(changed, keys, order, {"run": ("sum", F.col("__new"))})
    return counted.withColumn("run", F.coalesce("run", F.lit(0)) + F.col("__new")).drop("__new", "__previous", BLOCK)


def at_ranks(rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], *, blocks: int | None = None) -> DataFrame:
    """keys and, for each name, the value at a rank (from 1) among the key's non-null values in order; ranks: from their number to the rank wanted.

    Equal values are counted first. Ranges of values then tell by their counts which of them
    holds a rank, and only there values are counted through; so the values of a key may be
    spread over all blocks, and no task holds them together.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    held = in_blocks(counted, keys, [value], blocks=blocks)
    sizes = held.groupBy(*keys, BLOCK).agg(F.sum("__n").alias("__own"))
    ahead = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__own").over(ahead), F.lit(0)), "__all": F.sum("__own").over(Window.partitionBy(*keys))})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), of(F.col("__all")).cast("long").alias("rank")) for name, of in ranks.items()])
    sizes = sizes.withColumn("__w", F.explode(wanted)).filter((F.col("__w.rank") > F.col("__before")) & (F.col("__w.rank") <= F.col("__before") + F.col("__own")))
    targets = sizes.select(*[F.col(k).alias(f"__{k}") for k in (*keys, BLOCK)], F.col("__w.name").alias("__name"), (F.col("__w.rank") - F.col("__before")).alias("__rank"))
    within = Window.partitionBy(*keys, BLOCK).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumn("__upto", F.sum("__n").over(within))
    met = local.join(targets, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, BLOCK)])
    met = met.filter((F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__n")))
    return met.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in ranks])


def nearest_rank(n: Column, percent: int) -> Column:
    """The rank of the smallest of n values that at least percent of them don't exceed."""
    return F.floor((n * percent + 99) / 100)

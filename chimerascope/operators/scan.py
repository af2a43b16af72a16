"""Running values over the ordered rows of a key, however many rows one key has.

Rows lie in blocks that follow one another in the order of keys and rows. Windows run within
a block and key only, so a key with many rows is spread over tasks. What the blocks before
contribute is carried in from a table of totals, which has one row for each block that a key
goes on in: at most one less than there are blocks, since blocks follow the order of the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chimerascope.plans.staging import staged

BLOCK = "__block"


def in_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, blocks: int | None = None) -> DataFrame:
    """rows with __block, the number of the range of keys and order that each lies in; written to the shared folder, since ranges are drawn anew whenever a plan runs."""
    number = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(number, *keys, *order).withColumn(BLOCK, F.spark_partition_id()), "blocks")


def _of(kind: str, value: Column, order: Sequence[str]) -> Column:
    """A block's own contribution, as an aggregate."""
    there = value.isNotNull()
    return {"sum": F.sum(value), "max": F.max(value), "last": F.max_by(F.when(there, value), F.when(there, F.struct(*order)))}[kind]


def _over(kind: str, value: Column, window) -> Column:
    return {"sum": F.sum(value), "max": F.max(value), "last": F.last(value, ignorenulls=True)}[kind].over(window)


def _both(kind: str, carried: Column, own: Column) -> Column:
    """What earlier blocks and earlier rows of the block make together; null where there is neither."""
    if kind == "sum":
        return F.when(carried.isNotNull() | own.isNotNull(), F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0)))
    return F.greatest(carried, own) if kind == "max" else F.coalesce(own, carried)


def with_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, Column]], *, block: str = BLOCK) -> DataFrame:
    """rows with, for each name: (kind, value) of columns, the sum, max or last non-null value over the rows of its key before each; null without one.

    Blocks of rows ascend with keys and order; the order is total within a key, or rows equal
    in it have equal values.
    """
    before = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, block).agg(*[_of(kind, value, order).alias(name) for name, (kind, value) in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy(block)
    ahead = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"__{k}") for k in (*keys, block)], F.row_number().over(earlier).alias("__n"), *[_over(kind, F.col(name), ahead).alias(f"__carried_{name}") for name, (kind, _) in columns.items()])
    local = rows.withColumns({f"__own_{name}": _over(kind, value, before) for name, (kind, value) in columns.items()})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, block)]
    met = local.join(F.broadcast(carried.filter("__n > 1")), same, "left")
    made = {name: _both(kind, F.col(f"__carried_{name}"), F.col(f"__own_{name}")) for name, (kind, _) in columns.items()}
    return met.withColumns(made).select(*rows.columns, *columns)

"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. A source's budget first takes whole passes and,
but for the last KNAPSACK_WORDS words, an even share of every length; a bounded-knapsack
dynamic programme over the remaining counts then closes the rest exactly where the
lengths allow it. Which
documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chimerascope.llm.shared import all_columns, count_words, scratch, unused_name, utf8_views

#: Words that the dynamic programme fits; larger remainders are first lowered with long documents.
KNAPSACK_WORDS = 1 << 15
#: Documents of one source and length that are ranked together.
SLICE_ROWS = 10_000


def sizes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, source, size): words of the text, 0 for null; and the column key of docs, as row, where one is named."""
    row = [F.col(key).cast("long").alias("row")] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([count_words(raw) for raw in utf8_views(batch.column(2))], pa.int64())
            columns = [*batch.columns[:2], n, *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "size", "row"][: len(columns)])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *row)
    return picked.mapInArrow(run, "doc_id long, source string, size long" + (", row long" if key else ""))


def targets(sized: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target). The weights repeat over the sources by code point, null last; no target is above most times its source's size, and what is cut is shared out again by weight.

    The sources are ranked in one window over one row a source: made for up to some
    hundred thousand sources. Each sharing-out again caps a source at least, and takes two
    sums over those rows.
    """
    dims = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    dims = scratch(dims.withColumn("weight", weight), "mix-sources")
    budget, free, used = dims.agg(F.sum("source_size") * F.lit(share), F.sum("weight"), F.lit(0.0)).first()
    level = 0.0
    while free and budget is not None:
        further = (budget - used) / free
        if further <= level:
            break
        level = further
        capped = F.col("source_size") * most <= F.col("weight") * level
        used, free = dims.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size") * most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
    return dims.select("source", "source_size", F.least(F.col("source_size") * most, F.col("weight") * level).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to budget, or as near to it as can be. lengths ascend and are positive."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    even = max(0, budget - KNAPSACK_WORDS)
    taken = np.array([int(c) * even // total for c in counts], dtype=np.int64)
    left = counts - taken
    rest = budget - int((taken * lengths).sum())
    for i in range(len(lengths) - 1, -1, -1):
        if rest <= KNAPSACK_WORDS:
            break
        k = min(int(left[i]), (rest - KNAPSACK_WORDS) // int(lengths[i]))
        taken[i] += k
        left[i] -= k
        rest -= k * int(lengths[i])
    highest = 2 * rest  # sums above that are no nearer than none
    reach, mask, steps = 1, (1 << (highest + 1)) - 1, []
    for i in range(len(lengths)):
        size, n, part = int(lengths[i]), int(left[i]), 1
        if size > highest or reach >> rest & 1:
            break
        n = min(n, highest // size)
        while n > 0:
            part = min(part, n)
            wider = (reach | reach << part * size) & mask
            if wider != reach:
                steps.append((i, part, reach))
                reach = wider
            n -= part
            part *= 2
    below, above = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1, reach >> rest
    at = rest + (above & -above).bit_length() - 1 if above and (above & -above).bit_length() - 1 < rest - below else below
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return taken


def quotas(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, size, n, source_size, target, passes, extra) for each source and length: of its n documents each is taken passes times, and extra of them once more."""
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    grouped = lengths.join(wanted, lengths["source"].eqNullSafe(wanted["source"])).select(lengths["source"], "size", "n", "source_size", "target")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size").reset_index(drop=True)
        size, target = int(rows["source_size"][0]), float(rows["target"][0])
        passes = int(target // size) if size else 0
        real = (rows["size"] > 0).to_numpy()
        extra = np.zeros(len(rows), np.int64)
        extra[real] = fit_counts(rows["size"].to_numpy()[real], rows["n"].to_numpy()[real], round(target - passes * size))
        return rows.assign(passes=passes, extra=extra)

    kinds = "source string, size long, n long, source_size long, target double, passes long, extra long"
    return grouped.groupBy("source").applyInPandas(fit, kinds)


def _counted(sized: DataFrame, *, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """sized with source_size, target, copies and taken."""
    own = sized.columns
    quota = scratch(quotas(sized, targets(sized, weights=weights, share=share, most=most)), "mix-quotas")
    key = F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << 63) - 1))
    slices = F.ceil(F.col("n") / SLICE_ROWS)
    rows = (
        sized.join(quota.withColumnRenamed("source", "q_source").withColumnRenamed("size", "q_size"), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")))
        .drop("q_source", "q_size")
        .withColumn("order", key)
        .withColumn("slice", F.least(slices - 1, F.floor(F.col("order") / F.lit(float(1 << 63)) * slices)))
    )
    before = (
        rows.filter(slices > 1)
        .groupBy("source", "size", "slice")
        .agg(F.count("*").alias("here"))
        .withColumn("before", F.sum("here").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("here"))
        .select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("slice").alias("b_slice"), "before")
    )
    order = ["order", "doc_id", *[c for c in own if c == "row"]]
    placed = rows.repartition("source", "size", "slice").withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy(*order)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("slice") == F.col("b_slice")), "left")
    copies = F.col("passes") + F.when(F.col("place") + F.coalesce("before", F.lit(0)) <= F.col("extra"), 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("long")).select(*own, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_counts(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Needs doc_id, source and text; other columns are left out. A null source is a source
    of its own, last in order; a null or blank text has size 0 and is taken with none.
    Documents of equal size and source are chosen by a hash of seed and doc_id, so reruns
    agree; of repeated rows it doesn't matter which. An empty table gives no rows.
    """
    return _counted(scratch(sizes(docs), "mix-sizes"), weights=weights, share=share, most=most, seed=seed)


def mixture(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with a number for each copy, from 1.

    Rows are counted and taken one by one, by a key of their own, so repeated and null ids
    don't change what a source comes to. Texts without words, null ones too, aren't in it;
    an empty table stays empty. All columns of docs stay, of any name; the number is in
    column copy, or copy_ where docs have a copy already.
    """
    key, copies, copy = (unused_name(docs, name) for name in ("row", "copies", "copy"))
    keyed = scratch(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    counts = _counted(scratch(sizes(keyed, key), "mix-sizes"), weights=weights, share=share, most=most, seed=seed)
    taken = counts.filter("copies > 0 and size > 0").select(F.col("row").alias(key), F.col("copies").cast("int").alias(copies))
    return keyed.join(taken, key).select(*all_columns(docs), F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy))

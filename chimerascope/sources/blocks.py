"""Tables dealt into blocks by a hash of their key, with a tree of SHA-256 digests over the rows of each block.

A block is a folder of its own, so a copy that was broken off or damaged is mended block by
block, and a reader that knows the key opens one block. A table has at most MOST blocks, which
bounds every list of blocks; rows are never gathered, only their digests, a leaf at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "content_block"
#: Blocks of a table, at most; rows of a block, until there are that many; children of an inner node of the tree.
MOST, PER_BLOCK, FAN_OUT = 4096, 256, 64


def block_count(rows: int) -> int:
    """How many blocks a table of so many rows gets; none if it is empty."""
    return min(MOST, -(-rows // PER_BLOCK))


def block_of(keys: Sequence[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def write_blocks(rows: DataFrame, path: str, keys: Sequence[str], blocks: int) -> None:
    """Writes rows, one folder a block. An empty table has no blocks and is written plainly, so that it keeps its columns."""
    if not blocks:
        rows.write.mode("overwrite").parquet(path)
        return
    dealt = rows.withColumn(BLOCK, block_of([F.col(k) for k in keys], blocks))
    dealt.repartition(BLOCK).write.mode("overwrite").partitionBy(BLOCK).parquet(path)


def _over(*parts: str) -> Column:
    """The digest over a group's parts in their order, as an aggregate."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*parts))), lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts]))
    return F.sha2(F.array_join(lines, ","), 256)


def digests(rows: DataFrame) -> DataFrame:
    """(block, digest, n) of rows that carry their block; equal rows count as often as they come, their order doesn't.

    Rows are digested where they lie. Digests are gathered by 4,096 leaves a block, then leaves by block.
    """
    own = sorted(c for c in rows.columns if c != BLOCK)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]), {"ignoreNullFields": "false"})
    block = F.col(BLOCK) if BLOCK in rows.columns else F.lit(0)
    counted = rows.select(block.cast("int").alias("block"), F.sha2(text, 256).alias("row")).groupBy("block", "row").agg(F.count("*").alias("n"))
    leaves = counted.groupBy("block", F.substring("row", 1, 3).alias("leaf")).agg(_over("row", "n").alias("digest"), F.sum("n").alias("n"))
    return leaves.groupBy("block").agg(_over("leaf", "digest").alias("digest"), F.sum("n").alias("n"))


def root(blocks: DataFrame) -> str:
    """The digest over all of (block, digest); of none it is that of an empty text."""
    nodes, width = blocks.select(F.col("block").alias("place"), "digest"), MOST
    while width > 1:
        nodes = nodes.groupBy(F.floor(F.col("place") / FAN_OUT).cast("int").alias("up")).agg(_over("place", "digest").alias("digest")).withColumnRenamed("up", "place")
        width = -(-width // FAN_OUT)
    return nodes.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("root")).first()["root"]


def only(rows: DataFrame, blocks: Iterable[int]) -> DataFrame:
    """The rows of some blocks; folders of other blocks aren't opened."""
    return rows.filter(F.col(BLOCK).isin(*sorted(blocks))) if BLOCK in rows.columns else rows


def differing(rows: DataFrame, expected: dict[int, str], among: Iterable[int] | None = None) -> set[int]:
    """The blocks, of all or of some, whose digest isn't the expected one: changed, lacking, or not expected at all."""
    found = {r["block"]: r["digest"] for r in digests(rows if among is None else only(rows, among)).collect()}
    asked = expected.keys() | found.keys() if among is None else set(among)
    return {b for b in asked if found.get(b) != expected.get(b)}

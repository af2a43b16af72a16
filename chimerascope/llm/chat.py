"""Chat formatting after cumulative-snapshot collapse.

Services log a conversation again after every turn, so many logged conversations are
prefixes of longer ones. A rolling hash of the turns so far identifies each prefix; an
anti-join of whole conversations against the proper prefixes of all others keeps the
maximal ones, of equal ones the first, and only those are rendered, a row per turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chimerascope.llm.shared import scratch

_PREFIX = ["seq", "h1", "h2"]


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place in the conversation (seq, from 1), the number of turns, a 128-bit hash of the turns up to it, and the block that it lies in.

    The hash of a prefix is the exclusive or of the hashes of its turns and their places,
    so blocks of a conversation are hashed on their own and then offset by the blocks
    before. Blocks are ranges of all turns in order, so a conversation of any length,
    and any number of turns of one number or text, is spread over them.
    """
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text", "tie")]
    ranged = rows.repartitionByRange(F.asc_nulls_first("conv_id"), *order)
    ranged = scratch(ranged.withColumn("block", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("conv_id", "block").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    counts = ranged.groupBy("conv_id", "block").agg(F.count("*").alias("here"))
    counts = counts.withColumns({"base": F.coalesce(F.sum("here").over(before), F.lit(0)), "n_turns": F.sum("here").over(whole)})
    counts = counts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "base", "n_turns")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    placed = ranged.withColumn("own", F.row_number().over(within)).join(counts, same).withColumn("seq", F.col("base") + F.col("own"))
    parts = ["seq", F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit(""))]
    placed = placed.select("conv_id", "block", "seq", "n_turns", "role", "text", *[F.xxhash64(F.lit(k), *parts).alias(f"x{k}") for k in (1, 2)])
    placed = scratch(placed, "turns")
    blocks = placed.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"o{k}") for k in (1, 2)]
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.withColumns({f"p{k}": F.bit_xor(f"x{k}").over(so_far) for k in (1, 2)}).join(blocks, same)
    return hashed.select("conv_id", "block", "seq", "n_turns", "role", "text", *[F.col(f"p{k}").bitwiseXOR(F.col(f"o{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations that no longer one begins with; of equal ones the smallest id, a null id only if there is no other."""
    full = prefixes.filter("seq = n_turns").groupBy(*_PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = prefixes.filter("seq < n_turns").select(*_PREFIX).distinct()
    return full.join(proper, _PREFIX, "left_anti").select("conv_id", "copies")


def render_maximal(turns: DataFrame, *, opening: str = "<|{}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """The turns of the maximal conversations, rendered: conv_id, seq, n_turns, copies, rendered.

    One row per turn, to be read in order of seq; the rendering of a conversation is their
    concatenation. Turns are ordered by turn, then role, then text, nulls first, so ties
    and repeated rows have a defined place. A null role is rendered as "unknown" and a null
    text as empty. All turns of a null conv_id are one conversation. copies counts equal
    conversations. An empty table gives no rows; other columns are left out.
    """
    prefixes = scratch(rolling_prefixes(turns), "prefixes")
    kept = maximal(prefixes).withColumnRenamed("conv_id", "k")
    blocks = prefixes.select(F.col("conv_id").alias("c"), F.col("block").alias("b")).distinct().join(kept, F.col("c").eqNullSafe(F.col("k"))).select("c", "b", "copies")
    head, tail = opening.split("{}")
    rendered = F.concat(F.lit(head), F.coalesce("role", F.lit("unknown")), F.lit(tail), F.coalesce("text", F.lit("")), F.lit(closing))
    rows = prefixes.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return rows.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("n_turns").cast("long").alias("n_turns"), "copies", rendered.alias("rendered"))


ORACLE = r"""
WITH t AS (SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS seq,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations),
e AS (SELECT *, coalesce(length(role)::VARCHAR, 'n') || ':' || coalesce(role, '') || coalesce(length(text)::VARCHAR, 'n') || ':' || coalesce(text, '') AS enc FROM t),
p AS (SELECT *, string_agg(enc, '') OVER (PARTITION BY conv_id ORDER BY seq) AS pre FROM e),
f AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE seq = n_turns GROUP BY pre),
k AS (SELECT conv_id, copies FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.seq < p.n_turns AND p.pre = f.pre))
SELECT p.conv_id, p.seq, p.n_turns, k.copies,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered
FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id
"""

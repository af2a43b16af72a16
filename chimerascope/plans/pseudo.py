"""Annotation-like tables derived from the star-schema test tables, so that the operators run on all of their rows.

A line of an order is an exon, an order a transcript; documents give the bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chimerascope.functions.intervals import running_total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transcript_id, rank, length, pre_start, pre_end) and the keys of each line: exons one after another with introns between."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transcript_id"), F.row_number().over(order).alias("rank"), F.floor("l_quantity").cast("int").alias("length"),
        (1 + F.col("l_partkey") % 20).cast("int").alias("intron"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
    )
    before = Window.partitionBy("transcript_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.col("length") + F.col("intron")).over(before), F.lit(0)) + 1).cast("int")
    return rows.withColumn("pre_start", start).withColumn("pre_end", F.col("pre_start") + F.col("length") - 1)


def whole_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with their exons and translation ends, as operators.structure.derived takes them: one grouping of the lines and one join with the orders.

    A transcript's translation goes from the first base of its first exon to the last base
    of its last one.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("transcript_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    length = lambda x: F.floor(x["l_quantity"]).cast("int")
    starts = running_total(F.transform("lines", lambda x: length(x) + (1 + x["l_partkey"] % 20).cast("int")), F.lit(1))
    rows = rows.select("transcript_id", F.zip_with("lines", starts, lambda x, at: F.struct(at.alias("pre_start"), (at + length(x) - 1).alias("pre_end"))).alias("parts"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transcript_id"), (F.col("o_custkey") % 5).alias("seq_region_id"))
    rows = rows.join(orders, "transcript_id").withColumn("start", (1000 + F.col("transcript_id") % 97).cast("int"))
    last = F.element_at("parts", -1)
    rows = rows.withColumns({"end": (F.col("start") + last["pre_end"] - 1).cast("int"), "strand": F.when(F.col("transcript_id") % 2 == 0, 1).otherwise(-1), "chromosome": F.col("seq_region_id").cast("string")})

    def exon(x: Column, i: Column) -> Column:
        low = F.when(F.col("strand") == 1, F.col("start") + x["pre_start"] - 1).otherwise(F.col("end") - x["pre_end"] + 1)
        return F.struct(
            (F.col("transcript_id") * 100 + i + 1).alias("exon_id"), (i + 1).alias("rank"), low.alias("start"), (low + x["pre_end"] - x["pre_start"]).alias("end"), F.col("strand").alias("strand"),
            F.lit(-1).alias("phase"), F.col("seq_region_id").alias("seq_region_id"),
        )

    return rows.select(
        "transcript_id", "start", "end", "strand", "seq_region_id", "chromosome", F.transform("parts", exon).alias("exons"), F.lit(1).alias("seq_start"),
        (F.col("transcript_id") * 100 + 1).alias("start_exon_id"), (last["pre_end"] - last["pre_start"] + 1).alias("seq_end"), (F.col("transcript_id") * 100 + F.size("parts")).alias("end_exon_id"),
    )


def split_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same as three tables, as annotation dumps have them: transcripts, exons, translations."""
    rows = whole_transcripts(spark, sf_dir)
    exons = rows.select("transcript_id", F.explode("exons").alias("x")).select("transcript_id", "x.*")
    return rows.drop("exons", "seq_start", "start_exon_id", "seq_end", "end_exon_id"), exons, rows.select("transcript_id", "seq_start", "start_exon_id", "seq_end", "end_exon_id")


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, bases): the nucleotide letters of each document that has three or more."""
    kept = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return table(spark, sf_dir, "documents").select("doc_id", kept.alias("bases")).filter(F.length("bases") >= 3)


#: The same derivation in SQL.
SQL = """
lines AS (SELECT l_orderkey AS tx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS rank,
  CAST(floor(l_quantity) AS INTEGER) AS length, CAST(1 + l_partkey % 20 AS INTEGER) AS intron, l_partkey AS part, l_suppkey AS supplier FROM lineitem),
placed AS (SELECT *, CAST(1 + coalesce(sum(length + intron) OVER (PARTITION BY tx ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pre_start FROM lines),
ex AS (SELECT *, pre_start + length - 1 AS pre_end FROM placed),
span AS (SELECT tx, max(pre_end) AS span, max(rank) AS n FROM ex GROUP BY tx),
tr AS (SELECT o_orderkey AS tx, CAST(1000 + o_orderkey % 97 AS INTEGER) AS t_start, CAST(1000 + o_orderkey % 97 AS INTEGER) + span - 1 AS t_end,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS strand, o_custkey % 5 AS region, span, n FROM orders JOIN span ON tx = o_orderkey),
gx AS (SELECT ex.*, tr.t_start, tr.t_end, tr.strand, tr.region, tr.n,
  CASE WHEN strand = 1 THEN t_start + pre_start - 1 ELSE t_end - pre_end + 1 END AS g_start,
  CASE WHEN strand = 1 THEN t_start + pre_end - 1 ELSE t_end - pre_start + 1 END AS g_end FROM ex JOIN tr USING (tx))
"""

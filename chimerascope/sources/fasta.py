"""FASTA files as a table of fixed-size chunks and an index of sequences.

A record is never one row. Lines keep their place in the file; running counts of headers and
of letters, carried from block to block of the file, tell which record a line belongs to and
where in it; and chunks are put together from the lines that reach into them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope.operators.scan import with_before
from chimerascope.plans.staging import staged

CHUNK = 1 << 20
# The letters of nucleotide and of peptide sequences.
ALPHABETS = {"dna": "^[ACGTNRYSWKMBDHV]+$", "pep": "^[A-Z*]+$"}


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of a file, folder or glob: file, record (headers so far), header (that of its own, else null), letters, offset in the record.

    Written once, as the place of a line in its block of the file is a number that a scan
    hands out. A line of a packed file is in its only block.
    """
    text = F.trim(F.regexp_replace("value", "\r$", ""))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"), text.alias("text"))
    is_header = F.startswith(F.col("text"), F.lit(">"))
    raw = raw.filter("text != ''").select("file", "block", "ord", F.when(is_header, F.trim(F.substring("text", F.lit(2), F.length("text")))).alias("header"), F.when(~is_header, F.upper(F.regexp_replace("text", r"\s", ""))).alias("letters"))
    lines = staged(raw, "fasta-lines")
    opened = F.when(F.col("header").isNotNull(), 1).otherwise(0)
    lines = with_before(lines, ["file"], ["ord"], {"record": ("sum", opened)}, block="block").withColumn("record", F.coalesce("record", F.lit(0)) + opened)
    lines = with_before(lines, ["file", "record"], ["ord"], {"offset": ("sum", F.length("letters"))}, block="block")
    return lines.select("file", "record", "header", "letters", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def read_chunks(spark: SparkSession, path: str, kind: str, size: int = CHUNK) -> DataFrame:
    """(kind, sequence_id, stable_id, header, chunk_start, bases) of the records of FASTA files, written to the shared folder.

    The id is the first word of the header; a peptide's stable id drops its version. Text
    before the first header and a header without an id are errors. A record without
    letters has one chunk of null bases, which index() takes for the error it is.
    """
    lines = placed_lines(spark, path)
    lost = F.raise_error(F.concat(F.lit("Text before the first FASTA header: "), F.substring("letters", 1, 80)))
    lines = lines.withColumn("record", F.when(F.col("record") == 0, lost).otherwise(F.col("record")))
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.length("letters") - 1) / size)
    pieces = lines.filter("header is null").select("file", "record", "letters", "offset", F.explode(F.sequence(first, last)).alias("chunk"))
    low, high = F.greatest("offset", F.col("chunk") * size), F.least(F.col("offset") + F.length("letters"), (F.col("chunk") + 1) * size)
    cut = F.substring("letters", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    pieces = pieces.select("file", "record", "chunk", F.struct(low.alias("at"), cut.alias("part")).alias("piece"))
    chunks = pieces.groupBy("file", "record", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["part"]), "").alias("bases"))
    name = F.regexp_extract("header", r"^(\S+)", 1)
    checked = F.when(name == "", F.raise_error(F.concat(F.lit("FASTA record without an id: "), F.substring("header", 1, 80)))).otherwise(name)
    headers = lines.filter("header is not null").select("file", "record", "header", checked.alias("sequence_id"))
    stable = F.regexp_replace("sequence_id", r"\.[0-9]+$", "") if kind == "pep" else F.col("sequence_id")
    rows = headers.join(chunks, ["file", "record"], "left").select(
        F.lit(kind).alias("kind"), "sequence_id", stable.alias("stable_id"), "header", (F.coalesce("chunk", F.lit(0)) * size + 1).cast("int").alias("chunk_start"), "bases"
    )
    return staged(rows, "fasta-chunks")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence whose chunks come one after another; a chunk at a time is in memory."""
    current, digest, out = None, hashlib.sha256(), []
    for batch in batches:
        for kind, name, bases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, name) != current:
                if current:
                    out.append((*current, digest.hexdigest()))
                current, digest = (kind, name), hashlib.sha256()
            digest.update(bases.encode())
    if current:
        out.append((*current, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["kind", "sequence_id", "sha256"])


def index(chunks: DataFrame) -> DataFrame:
    """(kind, sequence_id, stable_id, header, length, sha256), one row a sequence of read_chunks. Empty records, letters outside the alphabet and an id that two records have are errors."""
    wrong = F.lit(False)
    for kind, letters in ALPHABETS.items():
        wrong = wrong | (F.col("kind") == kind) & ~F.col("bases").rlike(letters)
    grouped = chunks.groupBy("kind", "sequence_id", "stable_id").agg(
        F.min("header").alias("header"), F.sum(F.length("bases")).cast("int").alias("length"), F.max(wrong).alias("wrong"), F.count_if(F.col("chunk_start") == 1).alias("first")
    )
    shown = F.concat(F.lit(": "), F.substring("header", 1, 80))
    problem = (
        F.when(F.col("first") > 1, F.concat(F.lit("Two FASTA records of one id"), shown))
        .when(F.col("length").isNull(), F.concat(F.lit("Empty FASTA record"), shown))
        .when(F.col("wrong"), F.concat(F.lit("Letters outside the alphabet in FASTA record"), shown))
    )
    checked = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("length"))
    keys = ["kind", "sequence_id"]
    ordered = chunks.filter("bases is not null").repartition(*keys).sortWithinPartitions(*keys, "chunk_start").select(*keys, "bases")
    digests = ordered.mapInArrow(_digests, "kind string, sequence_id string, sha256 string")
    rows = grouped.withColumn("length", checked).drop("wrong", "first")
    return rows.join(digests, keys, "left").select("kind", "sequence_id", "stable_id", "header", "length", "sha256")


def whole(chunks: DataFrame) -> DataFrame:
    """(sequence_id, stable_id, bases) of sequences that are short, as peptides are: their chunks joined."""
    part = F.struct("chunk_start", "bases")
    return chunks.groupBy("sequence_id", "stable_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["bases"]), "").alias("bases"))


def without_orphans(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose sequence is in the index."""
    return chunks.join(index.select("kind", "sequence_id").distinct(), ["kind", "sequence_id"], "left_semi")


def missing_regions(regions: DataFrame, index: DataFrame, *, assembly: str) -> DataFrame:
    """DNA records whose name and length match no region of the assembly, with the lengths that regions of the name have."""
    known = regions.filter(F.col("version") == assembly).select(F.col("name").alias("sequence_id"), "length").distinct()
    odd = index.filter("kind = 'dna'").select("sequence_id", "length").join(known, ["sequence_id", "length"], "left_anti")
    lengths = regions.groupBy(F.col("name").alias("sequence_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("length")), lambda n: n.cast("string")), ", ").alias("candidates"))
    return odd.join(lengths, "sequence_id", "left")

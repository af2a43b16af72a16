"""Lists of integrated protein signatures, with rules for which list wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope.operators.joins import one_per_key, upsert

COLUMNS = ("ENTRY_AC", "ENTRY_TYPE", "ENTRY_NAME")


def entry_type(text: Column) -> Column:
    """Lower case with underscores for spaces and dashes; empty is null."""
    return F.nullif(F.translate(F.lower(F.trim(text)), " -", "__"), F.lit(""))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(interpro_id, entry_type, name) of a tab-separated list; columns are found by their header. A row with a malformed accession is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    lacking = [c for c in COLUMNS if c not in raw.columns]
    if lacking:
        raise ValueError(f"Entry list lacks {', '.join(lacking)}")
    wrong = F.raise_error(F.concat(F.lit("Malformed entry accession: "), F.coalesce("ENTRY_AC", F.lit(""))))
    accession = F.when(F.col("ENTRY_AC").rlike("^IPR[0-9]+$"), F.col("ENTRY_AC")).otherwise(wrong)
    return raw.select(accession.alias("interpro_id"), entry_type(F.col("ENTRY_TYPE")).alias("entry_type"), F.nullif(F.trim("ENTRY_NAME"), F.lit("")).alias("name"))


def core_names(xref: DataFrame) -> DataFrame:
    """(interpro_id, name, entry_type) from cross references: the largest non-empty description of each accession, else label."""
    rows = xref.filter(F.ilike("dbprimary_acc", F.lit("IPR%"))).groupBy(F.col("dbprimary_acc").alias("interpro_id"))
    best = rows.agg(F.coalesce(F.max(F.nullif("description", F.lit(""))), F.max(F.nullif("display_label", F.lit("")))).alias("name"))
    return best.withColumn("entry_type", F.lit(None).cast("string"))


def resolved(core: DataFrame, stored: DataFrame | None, supplied: DataFrame | None, history: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row an accession: core names, under stored rows, under the supplied list (nulls too); history, newest version first, only fills missing types."""
    columns = ["name", "entry_type"]
    out = core.select("interpro_id", *columns)
    for newer in (stored, supplied):
        if newer is not None:
            out = upsert(out, newer.select("interpro_id", *columns), "interpro_id", columns, prefer_new=True)
    if not history:
        return out
    ranked = sorted(history, key=lambda h: [int(p) for p in h[0].split(".")], reverse=True)
    old = None
    for place, (_, entries) in enumerate(ranked):
        rows = entries.filter("entry_type is not null").select("interpro_id", *columns, F.lit(place).alias("place"))
        old = rows if old is None else old.union(rows)
    newest = one_per_key(old, ["interpro_id"], [F.col("place")]).select("interpro_id", F.col("entry_type").alias("old_type"), F.col("name").alias("old_name"))
    filled = out.join(newest, "interpro_id", "full")
    return filled.select("interpro_id", F.coalesce("name", "old_name").alias("name"), F.coalesce("entry_type", "old_type").alias("entry_type"))


def used_entries(raw: dict[str, DataFrame]) -> DataFrame:
    """(interpro_id) that signatures on translations of current transcripts belong to."""
    current = raw["translation"].join(raw["transcript"].filter("is_current = 1").select("transcript_id"), "transcript_id", "left_semi")
    hits = raw["protein_feature"].join(current.select("translation_id"), "translation_id", "left_semi").select(F.col("hit_name").alias("id")).distinct()
    return raw["interpro"].join(hits, "id", "left_semi").select(F.col("interpro_ac").alias("interpro_id")).distinct()


def unresolved(used: DataFrame, entries: DataFrame) -> DataFrame:
    """Accessions in use (interpro_id) that have no entry type."""
    return used.select("interpro_id").distinct().join(entries.filter("entry_type is not null"), "interpro_id", "left_anti")

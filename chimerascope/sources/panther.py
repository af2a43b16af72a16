"""Protein family classifications: both file layouts, and their unambiguous assignment to translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope.operators.joins import unambiguous

SUBFAMILY = r"^PTHR[0-9]+:SF[0-9]+$"


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(accession, subfamily_id, subfamily_name) of a headerless tab-separated file.

    The subfamily id stands in the fourth field of the current layout, with its name in the
    sixth, and in the third of the older one, with its name in the fifth; the first row
    that tells decides for the file. Rows must begin with the species and have five fields.
    """
    raw = spark.read.text(path).filter(F.trim("value") != "").select(F.split("value", "\t", -1).alias("f"), "value")
    wrong = F.raise_error(F.concat(F.lit("Malformed classification row: "), F.substring("value", 1, 120)))
    ok = F.startswith(F.col("value"), F.lit("HUMAN|")) & (F.size("f") >= 5)
    rows = raw.withColumn("f", F.when(ok, F.col("f")).otherwise(wrong))
    cell = lambda i: F.get("f", F.lit(i))
    telling = rows.filter(cell(3).rlike(SUBFAMILY) | cell(2).rlike(SUBFAMILY)).select(cell(3).rlike(SUBFAMILY)).head()
    if telling is None:
        raise ValueError("The classification file holds no subfamily")
    at = (3, 5) if telling[0] else (2, 4)
    accession = F.regexp_extract(cell(0), r"UniProtKB[:=]([A-Za-z0-9-]+)", 1)
    found = rows.select(accession.alias("accession"), F.trim(cell(at[0])).alias("subfamily_id"), F.trim(cell(at[1])).alias("subfamily_name"))
    return found.filter("accession != '' and coalesce(subfamily_id, '') != '' and coalesce(subfamily_name, '') != ''")


def assignments(classes: DataFrame, xref: DataFrame, object_xref: DataFrame) -> DataFrame:
    """(translation_id, subfamily_id, subfamily_name) of the translations whose cross references lead to one subfamily only."""
    links = object_xref.filter("ensembl_object_type = 'Translation'").select("xref_id", F.col("ensembl_id").alias("translation_id"))
    met = classes.join(xref.select("xref_id", F.col("dbprimary_acc").alias("accession")), "accession").join(links, "xref_id")
    names = classes.groupBy("subfamily_id").agg(F.min("subfamily_name").alias("subfamily_name"))
    return unambiguous(met, "translation_id", "subfamily_id").join(names, "subfamily_id").select("translation_id", "subfamily_id", "subfamily_name")


def fits_hit(hit_name: Column, subfamily_id: Column) -> Column:
    """Whether an assignment refines a hit: the same family, and the same subfamily where the hit names one."""
    same_family = F.substring_index(hit_name, ":", 1) == F.substring_index(subfamily_id, ":", 1)
    return same_family & (~F.contains(hit_name, F.lit(":")) | (hit_name == subfamily_id))


def release(versions: DataFrame) -> str:
    """The one dotted number among db_version; none or several are errors."""
    found = sorted(r[0] for r in versions.select("db_version").filter("db_version is not null").distinct().limit(10).collect())
    if len(found) != 1 or not all(p.isdigit() for p in found[0].split(".")):
        raise ValueError(f"Expected one classification release, found {found}")
    return found[0]

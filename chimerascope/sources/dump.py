r"""Tab-separated table dumps with a DDL file: schema from the DDL, \N for null, backslash escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope.functions.sequences import dump_value

_TABLE = re.compile(r"CREATE TABLE `(\w+)` \((.*?)\n\)", re.S)
_COLUMN = re.compile(r"^\s*`(\w+)`\s+(\w+)", re.M)


def spark_type(declared: str) -> str:
    """Integers are bigint, other numbers double, everything else text (dates and enums too)."""
    kind = declared.lower()
    if re.fullmatch(r"(tiny|small|medium|big)?int(eger)?", kind):
        return "bigint"
    return "double" if kind in ("float", "double", "decimal", "real", "numeric") else "string"


def parse_schema(text: str) -> dict[str, list[tuple[str, str]]]:
    """Tables of a DDL text with their columns and Spark types, in order."""
    found = {name: [(c, spark_type(t)) for c, t in _COLUMN.findall(body)] for name, body in _TABLE.findall(text)}
    if not found:
        raise ValueError("The DDL holds no table")
    return found


def read_schema(spark: SparkSession, path: str) -> dict[str, list[tuple[str, str]]]:
    return parse_schema(spark.read.text(path, wholetext=True).first()[0])


def escaped(value: Column) -> Column:
    """The field of a dump that stands for a value."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return F.coalesce(out, F.lit("\\N"))


def read_table(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """A dump file (or a folder or glob of them, gz too) as typed columns. A row with another number of fields is an error that shows the row."""
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    wrong = F.raise_error(F.concat(F.lit(f"Expected {len(columns)} fields, found "), F.size(fields).cast("string"), F.lit(": "), F.substring("value", 1, 200)))
    rows = spark.read.text(path).withColumn("fields", F.when(F.size(fields) == len(columns), fields).otherwise(wrong))
    return rows.select(*[dump_value(F.get("fields", F.lit(i))).cast(kind).alias(name) for i, (name, kind) in enumerate(columns)])


def write_table(df: DataFrame, path: str) -> None:
    """df as a dump, one escaped row a line."""
    df.select(F.concat_ws("\t", *[escaped(F.col(c).cast("string")) for c in df.columns])).write.text(path)

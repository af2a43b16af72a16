"""Secret scans over an incremental ledger of blobs.

Every version of every file is content-addressed. The ledger, a table in the shared store,
keeps where secrets lie in each pair of blob and rule version, never the secrets; a scan
reads only the blobs that it lacks for the current rules, each once however many paths and
versions hold it, and joins the findings back to all of them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope.llm.shared import all_columns, scratch_path, unused_name
from chimerascope.llm.spans import PLACE, count_kind, digest_text, find, places

# Kinds of secrets, the base ones first, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "private_key", "github", "slack", "google", "jwt", "bearer", "url_password")

_WORDS = "(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = _WORDS + "[\"']?\\x20*+[:=]\\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
# A key reaches to its END line, unless another key or no END line follows; then it is the header and base64 lines, or long base64 words, that come next.
_OF_KEY = "[A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
_TO_END = "[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END " + _OF_KEY
_BREAK = "(?:[\\x20\\t\\r\\n]|\\\\[rn])*+"
_KEY_LINE = "(?:[A-Za-z][A-Za-z0-9-]*+:[\\x20\\t][^\\r\\n\\\\]*+|[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/=]++(?=[\\x20\\t]*+(?:[\\r\\n\\\\\"']|\\z)))"
_PRIVATE_KEY = f"-----BEGIN {_OF_KEY}(?:{_TO_END}|(?:{_BREAK}{_KEY_LINE})*+)"
_RULES = (
    ("private_key", _PRIVATE_KEY, "-----BEGIN"),
    ("github", "(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{40,}+)", "gh|git"),
    ("slack", "xox[abeoprs]-[A-Za-z0-9-]{10,}+", "xox"),
    ("google", "(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", "AIza"),
    ("jwt", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\\.eyJ[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+", "eyJ"),
    ("bearer", "(?<![A-Za-z])[Bb]earer\\x20++[A-Za-z0-9._~+/-]{20,}+=*+", "earer"),
    ("url_password", "(?<![a-z])[a-z]{3,12}://[^\\x00-\\x20/:@]++:[^\\x00-\\x20/:@]{3,}+@", "://"),
)
_ACCESS, _HEX = "AKIA[A-Z0-9]++", "(?<![0-9a-f])[0-9a-f]{24,}+"
#: Follows from the rules, so blobs scanned under other rules are scanned again.
RULE_VERSION = hashlib.sha256(repr((KINDS, _ASSIGN, _ACCESS, _HEX, _RULES)).encode()).hexdigest()[:16]
LEDGER = f"blob string, rule_version string, base array<{PLACE}>, spans array<{PLACE}>"


def _contains_any(text: Column, gate: str) -> Column:
    tests = [F.contains(text, F.lit(g)) for g in gate.split("|")]
    found = tests[0]
    for test in tests[1:]:
        found |= test
    return found


def base_spans(text: Column) -> Column:
    """The spans of the base kinds, sorted."""
    value = lambda s: F.length(F.regexp_extract(s["hit"], _ASSIGN, 1)) >= 6
    return F.sort_array(
        F.concat(
            F.filter(find(text, _ASSIGN, 0), value),
            F.filter(find(text, _ACCESS, 1, gate=F.contains(text, F.lit("AKIA"))), lambda s: F.length(s["hit"]) >= 20),
            find(text, _HEX, 2),
        )
    )


def further_spans(text: Column) -> Column:
    """The spans of the further rules."""
    return F.concat(*[find(text, pattern, KINDS.index(kind), gate=_contains_any(text, gate)) for kind, pattern, gate in _RULES])


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of each blob (blob, text), one row a blob, none missing: the columns of the ledger."""
    found = blobs.select("blob", base_spans(F.col("text")).alias("base"), further_spans(F.col("text")).alias("further"))
    return found.select("blob", F.lit(rule_version).alias("rule_version"), places(F.col("base")).alias("base"), places(F.sort_array(F.concat("base", "further"))).alias("spans"))


def versions(files: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text) of every row, a version of a file each; the blob is the SHA-256 of the text, null being empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return files.select(F.col(path).alias("path"), F.sha2(whole, 256).alias("blob"), whole.alias("text"))


class Ledger:
    """The findings of all blobs scanned so far, at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)

    def known(self, rule_version: str = RULE_VERSION) -> DataFrame:
        """One row for each blob scanned under rule_version, even if two writers added it."""
        return self.spark.read.schema(LEDGER).parquet(self.path).filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"])

    def add(self, seen: DataFrame, rule_version: str = RULE_VERSION) -> None:
        """Scans those blobs of seen (path, blob, text) that have no row under rule_version, each once. Written as a whole when all are scanned."""
        known = self.known(rule_version).select("blob")
        fresh = seen.select("blob", "text").join(known, "blob", "left_anti").dropDuplicates(["blob"])
        scan_blobs(fresh, rule_version).write.mode("append").parquet(self.path)


def scan_secrets(files: DataFrame, ledger: Ledger, *, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of every row of files, after the blobs that the ledger lacks have been added to it.

    files: any number of versions of any number of paths. Findings: path, blob, base and
    spans (arrays of start, kind, end; offsets in code points, kind an index into KINDS).
    Whole texts are scanned. Null and empty texts are one and the same empty blob, without
    findings. Repeated rows, and equal texts under any number of paths, give a row each.
    Null paths stay null. An empty table gives none. Only blobs with findings are joined
    back, a row each, so a blob that many paths hold makes a long but splittable side.
    """
    ledger.add(versions(files, path, text))
    return findings(files, ledger, path=path, text=text)


def findings(files: DataFrame, ledger: Ledger, *, path: str = "doc_id", text: str = "text") -> DataFrame:
    """What the ledger knows of every row of files, as scan_secrets returns it; blobs that it lacks have none."""
    seen = versions(files, path, text)
    hits = ledger.known().filter(F.size("spans") > 0).select("blob", "base", "spans")
    none = F.array().cast(f"array<{PLACE}>")
    found = seen.select("path", "blob").join(hits, "blob", "left")
    return found.select("path", "blob", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def report(docs: DataFrame, ledger: Ledger | None = None, *, increments: int = 2) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs.

    The rows come to the ledger in increments, dealt by a hash of doc_id, as the versions
    of a growing store would, and each increment scans only blobs that none before it
    held; then all rows are joined with the ledger. Without one, a new one is made in the
    shared folder.
    """
    ledger = ledger or Ledger(docs.sparkSession, scratch_path(docs.sparkSession, "ledger"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(increments)), F.lit(0))
    for i in range(increments):
        ledger.add(versions(docs.filter(part == i)))
    found = findings(docs, ledger)
    return found.select(
        F.col("path").alias("doc_id"),
        *[count_kind(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])],
        F.sha2(digest_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        digest_text(F.col("spans"), KINDS).alias("spans"),
    )


def redact(docs: DataFrame, ledger: Ledger | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by a mask; all columns, of any name, and all rows stay.

    Findings are joined to texts by blob, so each text is redacted by what was found in it,
    repeated rows alike. Overlapping secrets are replaced as one. Null texts stay null, and
    an empty table stays empty. Without a ledger a new one is made in the shared folder.
    """
    ledger = ledger or Ledger(docs.sparkSession, scratch_path(docs.sparkSession, "ledger"))
    ledger.add(versions(docs))
    blob, at = unused_name(docs, "blob"), unused_name(docs, "secret_spans")
    hits = ledger.known().filter(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(at))
    marked = docs.withColumn(blob, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).join(hits, blob, "left")
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(at, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return marked.withColumn("text", F.when(F.col(at).isNull(), text).otherwise(clean)).select(*all_columns(docs))

"""All registered queries of the engine, over the whole test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope import schemas
from chimerascope.functions import intervals, sequences
from chimerascope.operators import coverage, features, joins, sides, splicing, structure
from chimerascope.plans import pseudo, report
from chimerascope.plans.annotate import annotate
from chimerascope.plans.models import source_counts
from chimerascope.plans.pseudo import table
from chimerascope.plans.staging import staged, staged_path
from chimerascope.sources import fasta, lake, uniprot

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, *, pseudo_tables: bool = False):
    """Registers a query under its function's name, with its SQL; pseudo_tables: the SQL builds on the derived annotation tables."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            head = f"WITH {pseudo.SQL.strip()}" if pseudo_tables else ""
            _SQL[f.__name__] = (head + (", " if pseudo_tables and not sql.lstrip().startswith("SELECT") else " ") + sql.strip()).strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.derived(pseudo.whole_transcripts(spark, sf_dir))


@_query("SELECT tx AS transcript_id, rank AS exon_number, g_start AS genomic_start, g_end AS genomic_end, pre_start AS premrna_start, pre_end AS premrna_end FROM gx", pseudo_tables=True)
def exon_coordinates(spark, sf_dir):
    models = structure.structures(*pseudo.split_tables(spark, sf_dir))
    return models.select("transcript_id", F.explode("transcript_exons").alias("x")).select("transcript_id", "x.*")


@_query(
    """
s AS (SELECT *, 'acceptor' AS type, pre_start AS premrna_position, CASE WHEN strand = 1 THEN g_start ELSE g_end END AS genomic_position FROM gx WHERE rank > 1
  UNION ALL SELECT *, 'donor', pre_end, CASE WHEN strand = 1 THEN g_end ELSE g_start END FROM gx WHERE rank < n),
w AS (SELECT *, genomic_position - CASE WHEN (strand = -1 AND type = 'donor') OR (strand = 1 AND type = 'acceptor') THEN 2 ELSE 1 END AS disruption_start FROM s)
SELECT tx AS transcript_id, rank AS exon_number, type, premrna_position, genomic_position, disruption_start, disruption_start + 3 AS disruption_end FROM w""",
    pseudo_tables=True,
)
def splice_sites_windows(spark, sf_dir):
    return _models(spark, sf_dir).select("transcript_id", F.explode("splice_sites").alias("s")).select("transcript_id", "s.*")


_CDS = """
cds AS (SELECT *, CAST(sum(length) OVER (PARTITION BY tx ORDER BY rank) AS INTEGER) AS cds_end FROM gx),
blocks AS (SELECT *, cds_end - length + 1 AS cds_start FROM cds)"""


@_query(
    _CDS + """, t AS (SELECT tx, max(cds_end) AS total FROM blocks GROUP BY tx)
SELECT tx AS transcript_id, cds_start, cds_end, g_start AS genomic_start, total % 3 = 0 AS whole_codons FROM blocks JOIN t USING (tx)""",
    pseudo_tables=True,
)
def cds_blocks_phase(spark, sf_dir):
    # Settled below the explosion: the optimizer asks there whether a row has blocks, and else derives them for that from the lines in one nested expression.
    rows = structure.settled(_models(spark, sf_dir).select("transcript_id", "cds_start_phase", "cds_blocks"), "cds_blocks")
    length = structure.cds_length(F.col("cds_blocks"))
    rows = structure.settled(rows.withColumn("bases", length), "bases")
    whole = structure.fits_peptide(F.col("bases"), F.col("cds_start_phase"), F.floor(F.col("bases") / 3))
    rows = structure.settled(rows.select("transcript_id", "cds_blocks", whole.alias("whole_codons")), "whole_codons")
    return rows.select("transcript_id", "whole_codons", F.explode("cds_blocks").alias("b")).select("transcript_id", "b.cds_start", "b.cds_end", "b.genomic_start", "whole_codons")


def _cut(models: DataFrame) -> DataFrame:
    """Each transcript broken in the middle of one of its exons: terminus, kept range and the clipped parts."""
    exon = F.get("transcript_exons", (F.col("transcript_id") % F.size("transcript_exons")).cast("int"))
    rows = models.withColumn("at", (exon["premrna_start"] + F.floor((exon["premrna_end"] - exon["premrna_start"]) / 2)).cast("int"))
    rows = rows.withColumn("terminus", F.when(F.col("transcript_id") % 4 < 2, "N").otherwise("C"))
    return rows.withColumns({"kept_start": F.when(F.col("terminus") == "N", 1).otherwise(F.col("at")), "kept_end": F.when(F.col("terminus") == "N", F.col("at")).otherwise(F.col("premrna_length"))})


_KEPT = _CDS + """,
cut AS (SELECT tx, pre_start + CAST(floor((pre_end - pre_start) / 2) AS INTEGER) AS at_base FROM gx WHERE rank = 1 + tx % n),
kept AS (SELECT blocks.*, at_base, CASE WHEN tx % 4 < 2 THEN 1 ELSE at_base END AS k_start, CASE WHEN tx % 4 < 2 THEN at_base ELSE t_end - t_start + 1 END AS k_end FROM blocks JOIN cut USING (tx)),
seg AS (SELECT *, greatest(pre_start, k_start) AS lo, least(pre_end, k_end) AS hi FROM kept WHERE pre_start <= k_end AND k_start <= pre_end)"""


@_query(
    _KEPT + """
SELECT tx AS transcript_id, lo - k_start + 1 AS local_start, hi - k_start + 1 AS local_end, cds_start + lo - pre_start AS cds_start, cds_start + hi - pre_start AS cds_end FROM seg""",
    pseudo_tables=True,
)
def retained_clip(spark, sf_dir):
    rows = _cut(_models(spark, sf_dir))
    return rows.select("transcript_id", F.explode(sides.clipped_blocks(F.col("cds_blocks"), F.col("kept_start"), F.col("kept_end"))).alias("g")).select("transcript_id", "g.*")


def _aa(models: DataFrame) -> DataFrame:
    """A protein interval of each transcript of six coding bases or more, as CDS bases."""
    rows = structure.settled(models, *[c for c in ("cds_blocks", "kept_start", "kept_end") if c in models.columns])
    rows = structure.settled(rows.withColumn("residues", F.floor(structure.cds_length(F.col("cds_blocks")) / 3).cast("int")), "residues").filter("residues >= 2")
    return rows.withColumns({"aa_start": (1 + F.col("transcript_id") % F.col("residues")).cast("int"), "aa_end": F.least(F.col("residues"), (1 + F.col("transcript_id") % F.col("residues") + 9).cast("int"))})


_AA = """
res AS (SELECT tx, CAST(floor(max(cds_end) / 3) AS INTEGER) AS residues FROM blocks GROUP BY tx),
aa AS (SELECT tx, 1 + tx % residues AS aa_start, least(residues, 1 + tx % residues + 9) AS aa_end FROM res WHERE residues >= 2)"""


@_query(
    _KEPT + "," + _AA + """,
c AS (SELECT aa.tx, 3 * aa_start - 2 AS f_start, 3 * aa_end AS f_end, coalesce(sum(greatest(0, least(cds_start + hi - pre_start, 3 * aa_end) - greatest(cds_start + lo - pre_start, 3 * aa_start - 2) + 1)), 0) AS covered
  FROM aa LEFT JOIN seg USING (tx) GROUP BY aa.tx, aa_start, aa_end)
SELECT tx AS transcript_id, CAST(covered AS INTEGER) AS covered, CASE WHEN covered = 0 THEN 'excluded' WHEN covered < f_end - f_start + 1 THEN 'disrupted' ELSE 'included' END AS breakpoint_status FROM c""",
    pseudo_tables=True,
)
def breakpoint_statuses(spark, sf_dir):
    rows = _aa(_cut(_models(spark, sf_dir))).withColumn("segments", sides.clipped_blocks(F.col("cds_blocks"), F.col("kept_start"), F.col("kept_end")))
    start, end = F.col("aa_start") * 3 - 2, F.col("aa_end") * 3
    covered, _ = features.retention(start, end, F.col("segments"))
    rows = rows.select("transcript_id", covered.alias("covered"), (end - start + 1).alias("length"))
    return rows.select("transcript_id", "covered", features.breakpoint_status(F.col("covered"), F.col("length")).alias("breakpoint_status"))


@_query(
    _CDS + "," + _AA + """,
p AS (SELECT tx, strand, g_start, g_end, cds_start, greatest(cds_start, 3 * aa_start - 2) AS lo, least(cds_end, 3 * aa_end) AS hi FROM blocks JOIN aa USING (tx) WHERE cds_start <= 3 * aa_end AND cds_end >= 3 * aa_start - 2),
g AS (SELECT tx, CASE WHEN strand = 1 THEN g_start + lo - cds_start ELSE g_end - (hi - cds_start) END AS s, CASE WHEN strand = 1 THEN g_start + hi - cds_start ELSE g_end - (lo - cds_start) END AS e FROM p)
SELECT tx AS transcript_id, count(*) AS segments, CAST(min(s) AS INTEGER) AS genomic_start, CAST(max(e) AS INTEGER) AS genomic_end, CAST(sum(e - s + 1) AS BIGINT) AS bases FROM g GROUP BY tx""",
    pseudo_tables=True,
)
def peptide_to_genome(spark, sf_dir):
    rows = _aa(_models(spark, sf_dir))
    rows = rows.select("transcript_id", intervals.protein_to_genome(F.col("aa_start"), F.col("aa_end"), F.col("cds_blocks")).alias("s"))
    return rows.select(
        "transcript_id", F.size("s").cast("long").alias("segments"), F.array_min(F.transform("s", lambda x: x["start"])).alias("genomic_start"),
        F.array_max(F.transform("s", lambda x: x["end"])).alias("genomic_end"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"] + 1).alias("bases"),
    )


@_query(
    "SELECT a.tx AS transcript_id, a.rank AS exon, b.rank AS other, least(a.pre_end + 10, b.pre_end) - greatest(a.pre_start - 10, b.pre_start) + 1 AS shared FROM ex a JOIN ex b ON a.tx = b.tx AND a.rank <> b.rank AND a.pre_start - 10 <= b.pre_end AND b.pre_start <= a.pre_end + 10",
    pseudo_tables=True,
)
def interval_overlap_join(spark, sf_dir):
    lines = pseudo.exon_lines(spark, sf_dir)
    wide = lines.select("transcript_id", F.col("rank").alias("exon"), (F.col("pre_start") - 10).alias("a"), (F.col("pre_end") + 10).alias("b"))
    narrow = lines.select("transcript_id", F.col("rank").alias("other"), "pre_start", "pre_end")
    met = joins.overlapping(wide, narrow, ["transcript_id"], left_bounds=("a", "b"), right_bounds=("pre_start", "pre_end")).filter("exon != other")
    return met.select("transcript_id", "exon", "other", (F.least("b", "pre_end") - F.greatest("a", "pre_start") + 1).alias("shared"))


@_query(
    """WITH r AS (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(CASE WHEN event_id % 50 = 0 THEN value * 40 ELSE value END) AS BIGINT) AS e FROM events)
SELECT a.event_id, b.event_id AS other, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS shared FROM r a JOIN r b ON a.event_type = b.event_type AND a.event_id < b.event_id AND a.s <= b.e AND b.s <= a.e"""
)
def dense_overlap_join(spark, sf_dir):
    """Events as intervals of short and long duration, few keys for all of them: all pairs of a type that overlap."""
    start = F.unix_timestamp("ts")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", start.alias("s"), (start + F.floor(F.when(F.col("event_id") % 50 == 0, F.col("value") * 40).otherwise(F.col("value")))).alias("e"))
    other = rows.select(F.col("event_id").alias("other"), "event_type", F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = joins.overlapping(rows, other, ["event_type"], left_bounds=("s", "e"), right_bounds=("s2", "e2")).filter("event_id < other")
    return met.select("event_id", "other", (F.least("e", "e2") - F.greatest("s", "s2") + 1).alias("shared"))


@_query(
    """SELECT user_id, CAST(sum(greatest(0, e - greatest(s, coalesce(m + 1, s)) + 1)) AS BIGINT) AS covered FROM (
  SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (
    SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS e FROM events) q) r GROUP BY user_id"""
)
def covered_length(spark, sf_dir):
    start = F.unix_timestamp("ts")
    rows = table(spark, sf_dir, "events").select("user_id", start.alias("s"), (start + F.floor(F.col("value") * 60)).alias("e"))
    return coverage.covered_by_key(rows, ["user_id"], "s", "e")


@_query(
    """SELECT transcript_id, CAST(intron_start AS INTEGER) AS intron_start, CAST(intron_end AS INTEGER) AS intron_end FROM (
  SELECT tx AS transcript_id, pre_end + 1 AS intron_start, lead(pre_start) OVER (PARTITION BY tx ORDER BY rank) - 1 AS intron_end FROM ex) q WHERE intron_end >= intron_start""",
    pseudo_tables=True,
)
def interval_subtract(spark, sf_dir):
    rows = _models(spark, sf_dir)
    taken = F.transform("transcript_exons", lambda x: intervals.interval(x["premrna_start"], x["premrna_end"]))
    left = intervals.subtract(F.lit(1), F.col("premrna_length"), taken)
    return rows.select("transcript_id", F.explode(left).alias("x")).select("transcript_id", F.col("x.start").alias("intron_start"), F.col("x.end").alias("intron_end"))


@_query(
    """WITH r AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
  SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) q)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY user_id, run, event_type"""
)
def splice_runs(spark, sf_dir):
    rows = coverage.numbered_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@_query(
    """
st AS (SELECT tx, part % 3 <> 0 AS intact, 'acceptor' AS type, pre_start AS pos FROM ex JOIN span USING (tx) WHERE rank > 1
  UNION ALL SELECT tx, part % 3 <> 1, 'donor', pre_end FROM ex JOIN span USING (tx) WHERE rank < n),
o AS (SELECT tx, type, pos, lag(type) OVER (PARTITION BY tx ORDER BY pos, type) AS prev FROM st WHERE intact),
r AS (SELECT tx, type, sum(CASE WHEN prev IS NOT DISTINCT FROM type THEN 0 ELSE 1 END) OVER (PARTITION BY tx ORDER BY pos, type) AS run FROM o),
g AS (SELECT tx, run, type, count(*) AS n FROM r GROUP BY tx, run, type),
b AS (SELECT *, max(run) OVER (PARTITION BY tx) AS last_run FROM g),
k AS (SELECT * FROM b WHERE NOT (run = 1 AND type = 'acceptor') AND NOT (run = last_run AND type = 'donor')),
c AS (SELECT tx, count(*) AS runs, CAST(round(product(n)) AS BIGINT) AS patterns FROM k GROUP BY tx)
SELECT span.tx AS transcript_id, coalesce(runs, 0) AS runs, coalesce(patterns, 1) AS patterns FROM span LEFT JOIN c USING (tx)""",
    pseudo_tables=True,
)
def splice_patterns(spark, sf_dir):
    lines = pseudo.exon_lines(spark, sf_dir)
    site = lambda at, kind, ok: F.struct(F.col(at).alias("position"), F.lit(0).alias("side"), F.when(F.lit(kind) == "donor", 1).otherwise(0).alias("ord"), F.lit(kind).alias("type"), ok.alias("intact"))
    acceptor, donor = site("pre_start", "acceptor", F.col("part") % 3 != 0), site("pre_end", "donor", F.col("part") % 3 != 1)
    ends = lines.groupBy("transcript_id").agg(F.max("rank").alias("n"))
    rows = lines.join(ends, "transcript_id").select("transcript_id", F.array(F.when(F.col("rank") > 1, acceptor), F.when(F.col("rank") < F.col("n"), donor)).alias("s"))
    grouped = rows.groupBy("transcript_id").agg(F.array_sort(F.array_compact(F.flatten(F.collect_list("s")))).alias("sites"))
    grouped = structure.settled(grouped.withColumn("site_runs", splicing.site_runs(F.col("sites"))), "site_runs")
    return grouped.select("transcript_id", F.size("site_runs").cast("long").alias("runs"), splicing.pattern_count(F.col("site_runs")).cast("long").alias("patterns"))


_BASES = "bases AS (SELECT * FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS bases FROM documents) q WHERE length(bases) >= 3)"


@_query(f"WITH {_BASES} SELECT doc_id, reverse(translate(bases, 'ACGT', 'TGCA')) AS reverse_complement FROM bases")
def reverse_complement(spark, sf_dir):
    return pseudo.bases(spark, sf_dir).select("doc_id", sequences.reverse_complement(F.col("bases")).alias("reverse_complement"))


@_query(f"WITH {_BASES} SELECT doc_id, CAST(nullif(instr(bases, 'ATG'), 0) AS INTEGER) AS first_atg FROM bases")
def first_atg(spark, sf_dir):
    return pseudo.bases(spark, sf_dir).select("doc_id", sequences.first_start_codon(F.col("bases")).alias("first_atg"))


@_query(
    f"WITH {_BASES}, s AS (SELECT doc_id, bases, instr(bases, 'ATG') AS first FROM bases), e AS (SELECT doc_id, first, length(regexp_extract(substr(bases, first), '^((?:...)*?(?:TAA|TAG|TGA))', 1)) AS n FROM s WHERE first > 0)"
    " SELECT b.doc_id, CAST(CASE WHEN n > 0 THEN first + n - 3 END AS INTEGER) AS first_stop FROM bases b LEFT JOIN e USING (doc_id)"
)
def first_stop(spark, sf_dir):
    rows = pseudo.bases(spark, sf_dir).withColumn("at", sequences.first_start_codon(F.col("bases")))
    return rows.select("doc_id", sequences.first_stop_codon(F.col("bases"), F.col("at")).alias("first_stop"))


@_query(
    f"WITH {_BASES}, r AS (SELECT doc_id, bases, CAST(1 + doc_id % length(bases) AS INTEGER) AS s FROM bases), q AS (SELECT doc_id, substr(bases, s, least(length(bases), s + 99) - s + 1) AS cut FROM r)"
    " SELECT doc_id AS request_id, CASE WHEN doc_id % 2 = 0 THEN cut ELSE reverse(translate(cut, 'ACGT', 'TGCA')) END AS bases FROM q"
)
def chunk_fetch(spark, sf_dir):
    stored = pseudo.bases(spark, sf_dir)
    chunks = stored.select(F.col("doc_id").alias("sequence_id"), F.inline(joins.cut_chunks(F.col("bases"), 64)))
    start = (1 + F.col("doc_id") % F.length("bases")).cast("int")
    requests = stored.select(
        F.col("doc_id").alias("request_id"), F.col("doc_id").alias("sequence_id"), start.alias("start"), F.least(F.length("bases"), start + 99).alias("end"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1).alias("strand")
    )
    return joins.fetch(requests, chunks, size=64)


def _as_fasta(spark, sf_dir) -> str:
    """The bases of the documents as FASTA files of 60 letters a line; the files' path."""
    wrapped = F.array_join(F.regexp_extract_all("bases", F.lit("[ACGT]{1,60}"), F.lit(0)), "\n")
    path = staged_path(spark, "fasta")
    pseudo.bases(spark, sf_dir).select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" bases of a document\n"), wrapped)).write.text(path)
    return path


@_query(f"WITH {_BASES}, c AS (SELECT doc_id, bases, unnest(range(0, length(bases), 100)) AS o FROM bases) SELECT CAST(doc_id AS VARCHAR) AS sequence_id, CAST(o + 1 AS INTEGER) AS chunk_start, substr(bases, o + 1, 100) AS bases FROM c")
def fasta_chunks(spark, sf_dir):
    return fasta.read_chunks(spark, _as_fasta(spark, sf_dir), "dna", 100).select("sequence_id", "chunk_start", "bases")


@_query(f"WITH {_BASES} SELECT CAST(doc_id AS VARCHAR) AS sequence_id, doc_id || ' bases of a document' AS header, CAST(length(bases) AS INTEGER) AS length, sha256(bases) AS sha256 FROM bases")
def fasta_index(spark, sf_dir):
    return fasta.index(fasta.read_chunks(spark, _as_fasta(spark, sf_dir), "dna", 100)).select("sequence_id", "header", "length", "sha256")


@_query(
    _CDS + """,
kp AS (SELECT *, CAST(sum(length) OVER (PARTITION BY tx ORDER BY rank) AS INTEGER) - length + 1 AS p_start FROM blocks WHERE part % 5 <> 0),
f AS (SELECT tx, bool_and((p_start - 1) % 3 = (cds_start - 1) % 3) AS same FROM kp GROUP BY tx)
SELECT span.tx AS transcript_id, CASE WHEN same THEN 'in_frame' ELSE 'out_of_frame' END AS frame_status FROM span LEFT JOIN f USING (tx)""",
    pseudo_tables=True,
)
def frame_status(spark, sf_dir):
    lines = pseudo.exon_lines(spark, sf_dir).groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("rank", "length", "part"))).alias("x"))
    kept = F.filter("x", lambda e: e["part"] % 5 != 0)
    rows = lines.withColumn("cds", intervals.running_total(F.transform("x", lambda e: e["length"]), F.lit(1)))
    rows = rows.withColumns({"kept": kept, "from": intervals.running_total(F.transform(kept, lambda e: e["length"]), F.lit(1))})
    fragment = lambda e, at: F.struct(at.alias("product_start"), (at + e["length"] - 1).alias("product_end"), F.get("cds", e["rank"] - 1).alias("cds_start"))
    right = sequences.in_frame(F.zip_with("kept", "from", fragment), F.lit(1))
    return rows.select("transcript_id", F.when(right, "in_frame").otherwise("out_of_frame").alias("frame_status"))


@_query(
    """SELECT o_custkey, array_to_string(list_filter(['P', 'F', 'O'], lambda x: list_contains(s, x)), '/') AS statuses FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY o_custkey) q"""
)
def status_combine(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(intervals.combine_statuses(F.collect_set("o_orderstatus"), ("P", "F", "O")).alias("statuses"))


@_query(
    """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_quantity > 25 THEN l_returnflag END AS flag FROM lineitem)
SELECT l_partkey, first(flag ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) FILTER (WHERE flag IS NOT NULL) AS first_flag, max(l_quantity) AS most,
  array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS suppliers,
  CASE WHEN bool_and(l_quantity > 10) THEN 'preserved' WHEN bool_or(l_quantity > 10) THEN 'preserved/lost' ELSE 'lost' END AS splicing FROM r GROUP BY l_partkey"""
)
def feature_group_first_nonnull(spark, sf_dir):
    """Lines of a part as features of one identity, grouped as annotation groups features."""
    given = {"interpro_id": F.lit("entry"), "interpro_name": F.when(F.col("l_quantity") > 25, F.col("l_returnflag")), "feature_id": F.col("l_suppkey").cast("string"), "source": F.lit("lines"), "feature_type": F.lit("domain")}
    fields = [given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in schemas.feature_fields()]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("event_id"), F.lit("T").alias("transcript_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("slot"), F.lit(0).alias("ord"), F.struct(*fields).alias("f"),
        F.lit("included").alias("breakpoint_status"), F.col("l_quantity").alias("retained_percent"), F.array(F.when(F.col("l_quantity") > 10, "preserved").otherwise("lost")).alias("splicing_statuses"), F.array().cast("array<string>").alias("translation_statuses"),
    )
    groups = features.grouped_features(rows)
    return groups.select(F.col("event_id").alias("l_partkey"), F.col("first_name").alias("first_flag"), F.col("breakpoint_retained_percent").alias("most"), F.array_join("feature_ids", ",").alias("suppliers"), F.col("post_splicing_status").alias("splicing"))


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def canonical_anti_join(spark, sf_dir):
    """Orders as sequence records, those with lines as regions: the records that match no region."""
    orders = table(spark, sf_dir, "orders")
    index = orders.select(F.lit("dna").alias("kind"), F.col("o_orderkey").alias("sequence_id"), F.col("o_custkey").alias("length"))
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    regions = orders.join(held, "o_orderkey").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("length"), F.lit("A").alias("version"))
    return fasta.missing_regions(regions, index, assembly="A").select(F.col("sequence_id").alias("o_orderkey"), F.col("length").alias("o_custkey"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_chunks(spark, sf_dir):
    """Lines as chunks of orders: those of unfinished orders belong to no sequence of the index."""
    chunks = table(spark, sf_dir, "lineitem").select(F.lit("dna").alias("kind"), F.col("l_orderkey").alias("sequence_id"), "l_linenumber", "l_partkey")
    index = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.lit("dna").alias("kind"), F.col("o_orderkey").alias("sequence_id"))
    return fasta.without_orphans(chunks, index).select(F.col("sequence_id").alias("l_orderkey"), "l_linenumber", "l_partkey")


def _matches(spark, sf_dir):
    """Parts as isoforms of two features each, orders as peptides, lines as cross references between them; a part and an order have equal sequences if their keys leave the same remainder by 3."""
    part, text = table(spark, sf_dir, "part"), lambda c: c.cast("string")
    accession, letters = F.concat(F.lit("A"), text(F.col("p_partkey"))), lambda key: F.concat(F.lit("MK"), text(F.col(key) % 3))
    kind = lambda n, by: F.struct(F.concat(F.lit(n), text(F.col("p_size") % by)).alias("feature_id"), F.col("p_size").alias("start"), accession.alias("uniprot_accession"), accession.alias("uniprot_isoform"))
    isoforms = part.select(letters("p_partkey").alias("sequence"), F.array(accession).alias("accessions"), F.array().cast("array<string>").alias("protein_ids"), F.array(kind("F", 4), kind("G", 2)).alias("features"))
    peptides = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sequence_id"), text(F.col("o_orderkey")).alias("stable_id"), letters("o_orderkey").alias("bases"))
    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("A"), text(F.col("l_partkey"))).alias("accession"), text(F.col("l_orderkey")).alias("stable_id"))
    return uniprot.candidates(isoforms, peptides, links)


_MATCHES = "WITH m AS (SELECT DISTINCT o_orderkey, p_partkey, p_size, o_orderkey % 3 = p_partkey % 3 AS same FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"


@_query(
    _MATCHES
    + """, f AS (SELECT o_orderkey AS sequence_id, 0 AS ord, 'F' || CAST(p_size % 4 AS VARCHAR) AS feature_id, p_size AS start, 'A' || CAST(p_partkey AS VARCHAR) AS accession FROM m WHERE same
    UNION ALL SELECT o_orderkey, 1, 'G' || CAST(p_size % 2 AS VARCHAR), p_size, 'A' || CAST(p_partkey AS VARCHAR) FROM m WHERE same)
    SELECT sequence_id, feature_id, start, accession FROM f QUALIFY row_number() OVER (PARTITION BY sequence_id, feature_id ORDER BY ord, accession) = 1"""
)
def curated_features(spark, sf_dir):
    """Curated features by peptide: of isoforms that cross references lead to and whose sequences are equal, the first of each feature id."""
    return uniprot.first_features(_matches(spark, sf_dir)).select("sequence_id", "feature_id", "start", F.col("uniprot_accession").alias("accession"))


@_query(_MATCHES + " SELECT count(DISTINCT o_orderkey) FILTER (WHERE same) AS matched_proteins, count(*) FILTER (WHERE NOT same) AS sequence_mismatches FROM m")
def curated_import_counts(spark, sf_dir):
    """What a build tells of its curated import: mismatches counted by the tasks that write the matches, matched peptides from what was written."""
    path = staged_path(spark, "matches")
    seen = lake.write_counted(_matches(spark, sf_dir), path, uniprot.MATCH_COUNTS)
    counts = uniprot.import_counts(1, spark.read.parquet(path), seen["sequence_mismatches"], 0)
    return spark.createDataFrame([(counts["matched_proteins"], counts["sequence_mismatches"])], "matched_proteins long, sequence_mismatches long")


@_query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_return FROM orders")
def exists_flag(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.with_flag(table(spark, sf_dir, "orders").select("o_orderkey"), returned, ["o_orderkey"], "has_return")


@_query(
    """WITH p AS (SELECT p_partkey, 'S' || CAST(p_partkey % 1000 AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.' || CAST(p_size % 3 AS VARCHAR) END AS k FROM part),
s AS (SELECT s_suppkey, 'S' || CAST(s_suppkey AS VARCHAR) AS stable, s_nationkey % 3 AS version FROM supplier)
SELECT p_partkey, s_suppkey FROM p JOIN s ON k IN (stable, stable || '.' || CAST(version AS VARCHAR))"""
)
def disjunctive_key_join(spark, sf_dir):
    key = F.concat(F.lit("S"), (F.col("p_partkey") % 1000).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.concat(F.lit("."), (F.col("p_size") % 3).cast("string"))))
    left = table(spark, sf_dir, "part").select("p_partkey", key.alias("k"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("stable"), (F.col("s_nationkey") % 3).alias("version"))
    return joins.join_either_id(left, right, "k", "stable", "version").select("p_partkey", "s_suppkey")


@_query("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def unique_assignment(spark, sf_dir):
    return joins.unambiguous(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@_query(
    """SELECT coalesce(c_custkey, o_custkey) AS id, CASE WHEN o_custkey IS NOT NULL THEN last_priority ELSE c_mktsegment END AS over, coalesce(c_mktsegment, last_priority) AS under
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer) c FULL JOIN (SELECT o_custkey, max(o_orderpriority) AS last_priority FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey"""
)
def dimension_precedence(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("name"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("name"))
    over = joins.upsert(old, new, "id", ["name"], prefer_new=True).withColumnRenamed("name", "over")
    return over.join(joins.upsert(old, new, "id", ["name"], prefer_new=False).withColumnRenamed("name", "under"), "id")


@_query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS n FROM conversations) q WHERE n = 1")
def first_writer_wins(spark, sf_dir):
    return joins.one_per_key(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.col("turn"), F.col("text")]).select("conv_id", "role", "turn", "text")


@_query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS n FROM conversations) q WHERE n = 1")
def last_writer_wins(spark, sf_dir):
    return joins.one_per_key(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.desc("turn"), F.desc("text")]).select("conv_id", "role", "turn", "text")


@_query(
    """WITH e AS (SELECT o_orderkey, o_orderpriority AS reason, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders)
SELECT reason, count(*) AS n, string_agg(CASE WHEN n <= 3 THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY n) AS examples FROM e GROUP BY reason"""
)
def error_summary_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(": order "), F.col("o_orderkey").cast("string")).alias("error"))
    return joins.error_summary(rows)


@_query("SELECT p_partkey, nullif(translate(lower(p_name), ' -', '__'), '') AS label, CASE WHEN lower(p_type) IN ('economy', 'small') THEN 'excluded' ELSE lower(p_type) END AS source FROM part")
def label_normalise(spark, sf_dir):
    from chimerascope.sources.interpro import entry_type

    source = F.lower("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", entry_type(F.col("p_name")).alias("label"), F.when(source.isin("economy", "small"), "excluded").otherwise(source).alias("source"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_payload_roundtrip(spark, sf_dir):
    packed = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.from_json("props", "k long").alias("props"), "event_type")).alias("payload"))
    read = packed.select("event_id", F.from_json("payload", "props struct<k:long>, event_type string").alias("p"))
    return read.select("event_id", "p.props.k", "p.event_type")


@_query("SELECT page_id, md5(replace(html, chr(13), '')) AS digest, length(replace(html, chr(13), '')) AS n FROM pages")
def dump_unescape(spark, sf_dir):
    from chimerascope.sources.dump import escaped

    page = F.replace("html", F.lit("\r"), F.lit(""))
    rows = table(spark, sf_dir, "pages").select("page_id", sequences.dump_value(escaped(page)).alias("html"))
    return rows.select("page_id", F.md5("html").alias("digest"), F.length("html").cast("long").alias("n"))


@_query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END)::BIGINT AS taxed, median(l_extendedprice) AS middle, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS most
FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def latency_percentiles(spark, sf_dir):
    """Lines as timed operations: what the benchmark report says of each operation and phase."""
    timings = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("operation"), F.col("l_linestatus").alias("phase"), (F.col("l_tax") <= 0).alias("ok"), F.col("l_extendedprice").alias("wall"), F.col("l_quantity").alias("cpu"))
    out = report.summary(timings)
    return out.select(F.col("operation").alias("l_returnflag"), F.col("phase").alias("l_linestatus"), (F.col("successes") + F.col("errors")).alias("n"), F.col("errors").alias("taxed"), F.col("median").alias("middle"), "p95", F.col("max").alias("most"))


@_query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS n FROM events) q WHERE n <= 5")
def slowest_operations(spark, sf_dir):
    timings = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("wall"))
    return report.slowest(timings, tie="event_id").select("event_id", "user_id", F.col("wall").alias("value"))


@_query("SELECT o_custkey, max(o_orderkey % 113) AS latest FROM orders GROUP BY o_custkey")
def latest_release(spark, sf_dir):
    from chimerascope.sources.lake import newest_release

    names = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("release-"), (F.col("o_orderkey") % 113).cast("string")).alias("name"))
    return names.groupBy("o_custkey").agg(newest_release(F.col("name")).alias("latest"))


@_query("SELECT CAST(s_nationkey AS VARCHAR) AS logic_name, CAST(s_suppkey % 3 AS VARCHAR) AS db_version, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, s_suppkey % 3")
def source_inventory(spark, sf_dir):
    """Lines as protein features, suppliers as analyses: how many features each source and version gives."""
    analysis = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("analysis_id"), F.col("s_nationkey").cast("string").alias("logic_name"), (F.col("s_suppkey") % 3).cast("string").alias("db_version"))
    return source_counts({"protein_feature": table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("analysis_id")), "analysis": analysis}).select("logic_name", "db_version", "n")


@_query(
    """WITH r AS (SELECT l_returnflag, '{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_linestatus":"' || l_linestatus || '"}' AS j FROM lineitem)
SELECT l_returnflag, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(j), 1, 15) AS BIGINT)) AS VARCHAR) AS content FROM r GROUP BY l_returnflag"""
)
def content_fingerprint(spark, sf_dir):
    """What exports and resumed builds compare, for the lines of each flag."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), lake.content_sum("l_orderkey", "l_partkey", "l_linestatus").cast("string").alias("content"))


@_query("SELECT * FROM (SELECT DISTINCT n_nationkey AS nation FROM nation) q WHERE nation NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) r")
def set_differences(spark, sf_dir):
    nations, suppliers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    both = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(suppliers)
    return nations.distinct().join(suppliers, "nation", "left_anti").union(both)


@_query()
def sample_ready_ids(spark, sf_dir):
    """A seeded uniform sample of 100 orders with lines; the number is what is asked for."""
    ready = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return ready.orderBy(F.xxhash64(F.lit(42), "l_orderkey"), "l_orderkey").limit(100)


def pseudo_models(spark: SparkSession, sf_dir: str, structures: DataFrame | None = None) -> DataFrame:
    """A model of every order with lines (structures, if they are at hand): bases from the documents, a feature on every exon."""
    docs = pseudo.bases(spark, sf_dir)
    count = docs.count()
    numbered = docs.select((F.col("doc_id") % count).alias("slot"), "bases").groupBy("slot").agg(F.min("bases").alias("bases"))
    rows = (_models(spark, sf_dir) if structures is None else structures).withColumn("slot", F.col("transcript_id") % count).join(numbered, "slot", "left")
    pattern = F.coalesce("bases", F.lit("ATGACGTGA"))
    repeats = (F.floor(F.col("premrna_length") / F.length(pattern)) + 1).cast("int")
    start = lambda b, i: F.greatest(F.floor((b["cds_start"] + 4) / 3).cast("int"), F.lit(1))
    residues = F.floor(structure.cds_length(F.col("cds_blocks")) / 3).cast("int")
    kind = lambda i: F.element_at(F.array(*[F.lit(t) for t in ("domain", "family", "binding_site")]), (i % 3 + 1).cast("int"))
    text = lambda c: c.cast("string")

    def feature(b, i):
        first, last = start(b, i), F.least(residues, start(b, i) + 8)
        none = F.lit(None).cast("string")
        return F.struct(
            F.concat(F.lit("F"), text(i)).alias("feature_id"), F.lit("Pfam").alias("source"), F.when(i % 2 == 0, F.concat(F.lit("IPR"), text((F.col("transcript_id") + i) % 50))).alias("interpro_id"),
            kind(i).alias("interpro_entry_type"), F.concat(F.lit("name "), text(i)).alias("interpro_name"), F.concat(F.lit("feature "), text(i)).alias("description"), first.alias("start"), last.alias("end"),
            (3 * first - 2).alias("cds_start"), (3 * last).alias("cds_end"), none.alias("feature_type"), none.alias("uniprot_accession"), none.alias("uniprot_isoform"),
            none.alias("panther_subfamily_id"), none.alias("panther_subfamily_description"), F.lit(None).cast("array<struct<code:string,source:string,id:string>>").alias("evidence"),
        )

    rows = rows.withColumn("made", F.filter(F.transform("cds_blocks", feature), lambda f: f["start"] <= f["end"]))
    rows = rows.withColumn("transcript_id", F.concat(F.lit("ENST"), text(F.col("transcript_id"))))
    return rows.select(
        "transcript_id", F.lit(1).alias("version"), F.when(F.col("structure_error").isNull(), "ready").otherwise("error").alias("status"),
        F.col("structure_error").alias("model_error"), "chromosome", "strand", F.col("start").alias("transcript_genomic_start"), F.col("end").alias("transcript_genomic_end"), "premrna_length",
        F.substring(F.concat(F.lit("ATG"), F.repeat(pattern, repeats)), F.lit(1), F.col("premrna_length")).alias("premrna_sequence"), "splice_sites", "cds_blocks", F.col("made").alias("protein_features"),
    )


def pseudo_events(spark: SparkSession, sf_dir: str, structures: DataFrame | None = None) -> DataFrame:
    """An event for every even transcript with the next odd one: N part and C part, each broken in the middle of an exon; alone where the other has no lines."""
    cut = _cut(_models(spark, sf_dir) if structures is None else structures)
    place = F.when(F.col("strand") == 1, F.col("start") + F.col("at") - 1).otherwise(F.col("end") - F.col("at") + 1)
    part = cut.select(
        F.floor(F.col("transcript_id") / 2).alias("pair"), F.col("transcript_id") % 2 == 0, F.concat(F.lit("ENST"), F.col("transcript_id").cast("string")).alias("id"),
        F.concat("chromosome", F.lit(":"), place.cast("string")).alias("at"),
    ).toDF("pair", "leads", "id", "at")
    lead = part.filter("leads").select("pair", F.col("id").alias("transcript1_id"), F.col("at").alias("breakpoint1"))
    tail = part.filter("not leads").select("pair", F.col("id").alias("transcript2_id"), F.col("at").alias("breakpoint2"))
    both = lead.join(tail, "pair", "full")
    return both.select(
        F.col("pair").cast("string").alias("event_id"), "transcript1_id", "transcript2_id", "breakpoint1", "breakpoint2", F.lit("N").alias("gene1_terminus"), F.lit("C").alias("gene2_terminus"),
        F.when(F.col("pair") % 7 == 0, "ACGT").otherwise("").alias("inserted_sequence"),
    )


@_query()
def fusion_annotate(spark, sf_dir):
    """The flagship: all derived events annotated against all derived models, one row per event."""
    held = _models(spark, sf_dir).select("transcript_id", "start", "end", "strand", "chromosome", "structure_error", "premrna_length", "transcript_exons", "cds_blocks")
    structures = staged(held, "structures", lean=True).withColumn("splice_sites", structure.splice_sites(F.col("strand"), F.col("transcript_exons")))
    out = annotate(pseudo_events(spark, sf_dir, structures), pseudo_models(spark, sf_dir, structures))
    count = lambda status, name: F.size(F.filter("domains", lambda d: d[name] == status)).alias(f"n_{status}")
    starts = F.array_join(F.transform(F.map_entries("translation_start"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select(
        "event_id", "error", "frame_status", F.size("domains").alias("n_domains"), count("included", "breakpoint_based_status"), count("disrupted", "breakpoint_based_status"),
        count("excluded", "breakpoint_based_status"), F.size(F.filter("domains", lambda d: d["post_translation_status"] == "preserved")).alias("n_preserved"), starts.alias("translation_start"), "assumed_disruptive",
    )

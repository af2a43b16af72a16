"""Building a reference lake from dump files, sequences and feature lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerascope.plans.models import MODEL_COUNTS, check_models, source_label, transcript_models, with_sequences
from chimerascope.sources import dump, fasta, interpro, panther, uniprot
from chimerascope.sources.lake import SPECIES, Build, Lake, file_fingerprint

REQUIRED = ("transcript", "translation", "exon", "exon_transcript", "seq_region", "coord_system", "analysis", "protein_feature", "interpro", "xref")
OPTIONAL = ("object_xref", "external_db")


def build_lake(
    spark: SparkSession, source: str, out: str, *, release: str, ddl: str = "schema.sql", dna: str = "dna.fa", peptides: str = "pep.fa", entries: str | None = None,
    history: dict[str, str] | None = None, classes: str | None = None, curated: str | None = None, assembly: str = "GRCh38", chunk: int = fasta.CHUNK, replace: bool = False,
) -> Lake:
    """Builds and publishes the lake of one release; an interrupted build goes on where it stopped if settings and files are the same, by their content. A second build of the same lake at the same time is an error.

    source holds the DDL, one dump file <table>.txt (or .txt.gz) for each table, and the
    FASTA files. classes may hold {release}, which stands for the one release of the
    family classes that the analyses name. Integrated entries that current translations
    use must have a type in the entry list or in the history, newest version first.
    """
    if not re.fullmatch("[1-9][0-9]*", release):
        raise ValueError(f"The release must be a positive number: {release}")
    schema = dump.read_schema(spark, f"{source}/{ddl}")
    lacking = [t for t in REQUIRED if t not in schema]
    if lacking:
        raise ValueError(f"The DDL lacks {', '.join(lacking)}")
    tables = (*REQUIRED, *(t for t in OPTIONAL if t in schema))
    read = {"dna": f"{source}/{dna}", "peptides": f"{source}/{peptides}", "ddl": f"{source}/{ddl}", "entries": entries, "curated": curated, **{f"history {v}": path for v, path in (history or {}).items()}}
    read |= {t: f"{source}/{t}.txt*" for t in tables}
    read["classes"] = classes and classes.replace("{release}", "*")
    prints = {name: file_fingerprint(spark, path) for name, path in read.items()}
    settings = {"release": release, "assembly": assembly, "chunk": chunk, "classes": classes, "files": prints}
    with Build(spark, out, settings, replace=replace) as build:
        return _built(spark, build, source, schema, tables, release=release, dna=dna, peptides=peptides, entries=entries, history=history, classes=classes, curated=curated, assembly=assembly, chunk=chunk)


def _built(
    spark: SparkSession, build: Build, source: str, schema: dict, tables: tuple[str, ...], *, release: str, dna: str, peptides: str, entries: str | None, history: dict[str, str] | None,
    classes: str | None, curated: str | None, assembly: str, chunk: int,
) -> Lake:
    raw: dict[str, DataFrame] = {}
    for name in tables:
        raw[name] = build.stage(f"raw_{name}", lambda name=name: dump.read_table(spark, f"{source}/{name}.txt*", schema[name]))
    if raw["coord_system"].filter(F.col("version") == assembly).isEmpty():
        raise ValueError(f"The source has no coordinate system of {assembly}")
    records = build.stage("seq_records", lambda: fasta.read_chunks(spark, f"{source}/{dna}", "dna", chunk).union(fasta.read_chunks(spark, f"{source}/{peptides}", "pep", chunk)))
    index = build.stage("seq_index", lambda: fasta.index(records))
    absent = {"dna", "pep"} - {r["kind"] for r in index.select("kind").distinct().collect()}
    if absent:
        raise ValueError(f"No sequences of kind {', '.join(sorted(absent))}")
    chunks = build.stage("seq_chunks", lambda: fasta.without_orphans(records.select("kind", "sequence_id", "chunk_start", "bases"), index))
    regions = raw["seq_region"].join(raw["coord_system"].select("coord_system_id", "version"), "coord_system_id")
    odd = fasta.missing_regions(regions, index, assembly=assembly).head()
    if odd is not None:
        raise ValueError(f"Sequence {odd['sequence_id']} of {odd['length']} bases matches no region; lengths by name: {odd['candidates']}")
    old = [(version, interpro.read_entries(spark, path)) for version, path in (history or {}).items()]
    named = build.stage("entries", lambda: interpro.resolved(interpro.core_names(raw["xref"]), None, interpro.read_entries(spark, entries) if entries else None, old))
    untyped = [r[0] for r in interpro.unresolved(interpro.used_entries(raw), named).orderBy("interpro_id").limit(10).collect()]
    if untyped:
        raise ValueError(f"Entries in use without a type: {', '.join(untyped)}")
    found, imported = None, {}
    if curated:
        held = fasta.whole(records.filter("kind = 'pep'"))
        links = uniprot.cross_references(raw)
        chosen = build.stage("curated_entries", lambda: uniprot.read_entries(spark, curated), {"n": "count(*)"})
        isoforms = build.stage("isoforms", lambda: uniprot.proteins(chosen))
        matches = build.stage("curated_matches", lambda: uniprot.candidates(isoforms, held, links), uniprot.MATCH_COUNTS)
        found = build.stage("curated", lambda: uniprot.first_features(matches), {"n": "count(*)"})
        seen = build.counts
        counted = uniprot.import_counts(seen["curated_entries"]["n"], matches, seen["curated_matches"]["sequence_mismatches"], seen["curated"]["n"])
        imported = {f"curated_{k}": str(v) for k, v in counted.items()}
    if classes and "{release}" in classes:
        classes = classes.replace("{release}", panther.release(raw["analysis"].filter(source_label(raw["analysis"]) == "PANTHER")))
    families = build.stage("classes", lambda: panther.read_classes(spark, classes)) if classes else None
    bare = build.stage("structures", lambda: transcript_models(raw, index, named, curated=found, classes=families, assembly=assembly), MODEL_COUNTS)
    counts = check_models(bare, build.counts["structures"])
    build.stage("models", lambda: with_sequences(bare, chunks, size=chunk))
    return build.finish({"release": release, "species": SPECIES, "assembly": assembly, "chunk": str(chunk), **{f"n_{k}": str(v) for k, v in counts.items()}, **imported})

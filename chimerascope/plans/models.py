"""Building the table of transcript models from raw annotation tables, sequence index and feature dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerascope.functions.intervals import protein_to_genome
from chimerascope.operators import structure
from chimerascope.operators.joins import fetch, join_either_id, with_flag
from chimerascope.sources import panther

# Feature sources that map structures, not domains.
STRUCTURE_SOURCES = ("sifts", "alphafold")


def _int(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("int").alias(alias or name)


def source_label(analysis: DataFrame) -> Column:
    """The database of an analysis where it has one, else its name; the database column is optional."""
    name = F.nullif(F.col("logic_name"), F.lit(""))
    label = F.coalesce(F.nullif(F.col("db"), F.lit("")), name) if "db" in analysis.columns else name
    return F.when(F.lower(name).isin(*STRUCTURE_SOURCES), name).when(F.lower(label) == "panther", "PANTHER").otherwise(label)


def source_counts(raw: dict[str, DataFrame]) -> DataFrame:
    """(logic_name, db, db_version, n): how many protein features each analysis gives; db and db_version are null where the dump lacks them."""
    analysis = raw["analysis"]
    optional = [F.col(c) if c in analysis.columns else F.lit(None).cast("string").alias(c) for c in ("db", "db_version")]
    return raw["protein_feature"].join(analysis.select("analysis_id", "logic_name", *optional), "analysis_id").groupBy("logic_name", "db", "db_version").agg(F.count("*").alias("n"))


def canonical(raw: dict[str, DataFrame]) -> DataFrame:
    """Current transcripts with region, assembly, canonical translation and whether they have any translation."""
    t = raw["transcript"].filter("is_current = 1").select(
        "transcript_id", "stable_id", "version", "seq_region_id", _int("seq_region_start", "start"), _int("seq_region_end", "end"),
        _int("seq_region_strand", "strand"), "canonical_translation_id",
    )
    regions = raw["seq_region"].join(raw["coord_system"].select("coord_system_id", F.col("version").alias("assembly_name")), "coord_system_id")
    t = t.join(regions.select("seq_region_id", F.col("name").alias("chromosome"), "assembly_name"), "seq_region_id")
    t = with_flag(t, raw["translation"], ["transcript_id"], "has_translation")
    p = raw["translation"].select(
        F.col("translation_id").alias("canonical_translation_id"), F.col("transcript_id").alias("p_transcript"), F.col("stable_id").alias("translation_stable"),
        _int("version", "translation_version"), _int("seq_start"), "start_exon_id", _int("seq_end"), "end_exon_id",
    )
    joined = t.join(p, "canonical_translation_id", "left")
    return joined.filter("p_transcript is null or p_transcript = transcript_id").drop("p_transcript")


def exon_table(raw: dict[str, DataFrame]) -> DataFrame:
    e = raw["exon"].select(
        "exon_id", "seq_region_id", _int("seq_region_start", "start"), _int("seq_region_end", "end"), _int("seq_region_strand", "strand"), _int("phase")
    )
    return raw["exon_transcript"].join(e, "exon_id").select("transcript_id", "exon_id", "rank", "start", "end", "strand", "phase", "seq_region_id")


def signature_features(raw: dict[str, DataFrame], entries: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Features of translations with their source, integrated entry and family assignment; one row for each entry that a signature belongs to."""
    labels = raw["analysis"].select("analysis_id", source_label(raw["analysis"]).alias("source"))
    f = raw["protein_feature"].select(
        "protein_feature_id", "translation_id", _int("seq_start", "start"), _int("seq_end", "end"), "hit_name", "hit_description", "analysis_id"
    )
    rows = f.join(labels, "analysis_id", "left").join(raw["interpro"].select(F.col("id").alias("hit_name"), F.col("interpro_ac").alias("interpro_id")), "hit_name", "left")
    rows = rows.filter(~F.coalesce(F.lower("source").isin(*STRUCTURE_SOURCES), F.lit(False)))
    rows = rows.join(entries.select("interpro_id", F.col("name").alias("interpro_name"), F.col("entry_type").alias("interpro_entry_type")), "interpro_id", "left")
    own = F.when((F.upper("source") == "PANTHER") & F.contains("hit_name", F.lit(":SF")), F.col("hit_name"))
    rows = rows.withColumns({"sub_id": own, "sub_name": F.when(own.isNotNull(), F.col("hit_description"))})
    if classes is not None and {"object_xref", "xref"} <= raw.keys() and "xref_id" in raw["xref"].columns:
        assigned = panther.assignments(classes, raw["xref"], raw["object_xref"])
        fits = (F.col("source") == "PANTHER") & F.coalesce(panther.fits_hit(F.col("hit_name"), F.col("subfamily_id")), F.lit(False))
        rows = rows.join(assigned, "translation_id", "left")
        rows = rows.withColumns({"sub_id": F.when(fits, F.col("subfamily_id")).otherwise(F.col("sub_id")), "sub_name": F.when(fits, F.col("subfamily_name")).otherwise(F.col("sub_name"))})
    none = F.lit(None).cast("string")
    return rows.select(
        "translation_id", F.struct(F.lit(0).alias("kind"), F.col("protein_feature_id").cast("string").alias("id"), F.coalesce("interpro_id", F.lit("")).alias("entry")).alias("order"),
        F.col("protein_feature_id").alias("number"), F.nullif("hit_name", F.lit("")).alias("feature_id"), F.nullif("source", F.lit("")).alias("source"), "interpro_id", "interpro_entry_type",
        "interpro_name", F.coalesce(F.nullif("hit_description", F.lit("")), "interpro_name").alias("description"), "start", "end", none.alias("feature_type"), none.alias("uniprot_accession"),
        none.alias("uniprot_isoform"), F.col("sub_id").alias("panther_subfamily_id"), F.col("sub_name").alias("panther_subfamily_description"),
        F.lit(None).cast("array<struct<code:string,source:string,id:string>>").alias("evidence"),
    )


def curated_features(curated: DataFrame, translations: DataFrame) -> DataFrame:
    """Sequence-verified features (sequence_id and the feature's columns) by translation; a sequence id may carry the version or not."""
    met = join_either_id(curated, translations.select("translation_id", "stable_id", "version"), "sequence_id", "stable_id", "version")
    none = F.lit(None).cast("string")
    return met.select(
        "translation_id", F.struct(F.lit(1).alias("kind"), F.col("feature_id").alias("id"), F.lit("").alias("entry")).alias("order"), F.lit(None).cast("long").alias("number"), "feature_id",
        F.lit("UniProtKB").alias("source"), none.alias("interpro_id"), none.alias("interpro_entry_type"), none.alias("interpro_name"), "description", "start", "end", "feature_type",
        "uniprot_accession", "uniprot_isoform", none.alias("panther_subfamily_id"), none.alias("panther_subfamily_description"), "evidence",
    )


def transcript_models(raw: dict[str, DataFrame], index: DataFrame, entries: DataFrame, *, curated: DataFrame | None = None, classes: DataFrame | None = None, assembly: str = "GRCh38") -> DataFrame:
    """One row per current transcript: status ready, noncoding or error (with the first thing that is wrong), and its typed model.

    raw: transcript, translation, exon, exon_transcript, seq_region, coord_system, analysis,
    protein_feature, interpro, and xref and object_xref where there are. index: the
    sequence index (kind, sequence_id, stable_id, length). entries: interpro_id, name,
    entry_type. A feature outside its peptide makes the whole transcript an error.
    """
    tx = canonical(raw)
    ends = tx.select("transcript_id", "seq_start", "start_exon_id", "seq_end", "end_exon_id").filter("start_exon_id is not null")
    rows = structure.structures(tx.drop("seq_start", "start_exon_id", "seq_end", "end_exon_id"), exon_table(raw), ends)
    dna = index.filter("kind = 'dna'").select(F.col("sequence_id").alias("chromosome"), F.col("length").alias("region_length"))
    rows = rows.join(dna, "chromosome", "left")
    asked = tx.filter("translation_stable is not null").select("transcript_id", F.explode(F.array("translation_stable", F.concat_ws(".", "translation_stable", F.col("translation_version").cast("string")))).alias("sequence_id"))
    peptides = asked.join(index.filter("kind = 'pep'").select("sequence_id", "length"), "sequence_id").groupBy("transcript_id").agg(F.count("*").alias("peptides"), F.max("length").cast("int").alias("protein_length"))
    rows = rows.join(peptides, "transcript_id", "left")
    found = signature_features(raw, entries, classes)
    if curated is not None:
        found = found.unionByName(curated_features(curated, raw["translation"]))
    found = found.join(tx.select(F.col("canonical_translation_id").alias("translation_id"), "transcript_id"), "translation_id")
    ordered = F.struct(F.col("order.kind").alias("kind"), F.coalesce("number", F.lit(0)).alias("number"), F.col("order.id").alias("id"), F.col("order.entry").alias("entry"), *[c for c in found.columns if c not in ("transcript_id", "translation_id", "order", "number")])
    rows = rows.join(found.groupBy("transcript_id").agg(F.sort_array(F.collect_list(ordered)).alias("found")), "transcript_id", "left")
    coding = F.col("translation_stable").isNotNull()
    bases = structure.cds_length(F.col("cds_blocks"))
    outside = F.get(F.filter("found", lambda f: ~((f["start"] >= 1) & (f["start"] <= f["end"]) & (f["end"] <= F.col("protein_length")))), F.lit(0))
    text = lambda c: c.cast("string")
    problem = F.coalesce(
        F.when(F.col("assembly_name") != assembly, F.concat(F.lit("Unsupported transcript coordinate system: "), F.col("assembly_name"))),
        F.when(F.col("canonical_translation_id").isNotNull() & ~coding, F.lit("Canonical translation is missing from source table")),
        F.when(F.col("canonical_translation_id").isNull() & F.col("has_translation"), F.lit("Transcript has translations but no canonical translation")),
        F.col("structure_error"),
        F.when(F.col("region_length").isNull(), F.lit("Transcript sequence region is absent from genomic sequences")),
        F.when(F.col("end") > F.col("region_length"), F.lit("Transcript span exceeds its sequence region")),
        F.when(coding & (F.coalesce("peptides", F.lit(0)) != 1), F.lit("Canonical translation peptide is missing, ambiguous or of another version")),
        F.when(coding & ~structure.fits_peptide(bases, F.col("cds_start_phase"), F.col("protein_length")), F.concat(F.lit("CDS/peptide length mismatch: "), text(bases), F.lit(" bases, "), text(F.col("protein_length")), F.lit(" residues"))),
        F.when(coding & outside.isNotNull() & (outside["kind"] == 0), F.concat(F.lit("Protein feature falls outside peptide: "), F.coalesce(outside["feature_id"], F.lit("")))),
        F.when(coding & outside.isNotNull(), F.lit("Verified UniProt feature falls outside peptide")),
    )
    rows = rows.withColumn("problem", problem)

    def feature(f: Column) -> Column:
        names = ("feature_id", "source", "interpro_id", "interpro_entry_type", "interpro_name", "description", "start", "end")
        later = ("feature_type", "uniprot_accession", "uniprot_isoform", "panther_subfamily_id", "panther_subfamily_description", "evidence")
        return F.struct(
            *[f[n].alias(n) for n in names], ((f["start"] - 1) * 3 + 1).cast("int").alias("cds_start"), (f["end"] * 3).cast("int").alias("cds_end"),
            protein_to_genome(f["start"], f["end"], F.col("cds_blocks")).alias("segments"), *[f[n].alias(n) for n in later],
        )

    good = F.col("problem").isNull()
    status = F.when(~good, "error").when(coding, "ready").otherwise("noncoding")
    return rows.select(
        F.col("stable_id").alias("transcript_id"), F.col("version").cast("int").alias("version"), F.col("translation_stable").alias("translation_id"), F.col("translation_version").cast("int").alias("translation_version"),
        status.alias("status"), F.when(~good, F.concat("stable_id", F.lit(": "), F.col("problem"))).alias("model_error"), "chromosome", "assembly_name", F.col("strand").cast("int").alias("strand"),
        F.col("start").cast("int").alias("transcript_genomic_start"), F.col("end").cast("int").alias("transcript_genomic_end"), F.col("premrna_length").cast("int").alias("premrna_length"), "protein_length", "cds_start_phase",
        F.lit(None).cast("string").alias("premrna_sequence"), "transcript_exons", "splice_sites", "cds_blocks",
        F.when(good & coding, F.coalesce(F.transform("found", feature), F.array())).alias("protein_features"), F.col("transcript_id").alias("internal_id"),
    )


# What is counted of models while they are written.
MODEL_COUNTS = {
    "ready": "count_if(status = 'ready')", "noncoding": "count_if(status = 'noncoding')", "error": "count_if(status = 'error')",
    "protein_features": "coalesce(sum(if(status = 'ready', size(protein_features), 0)), 0)",
    "untyped": "coalesce(sum(if(status = 'ready', size(filter(protein_features, f -> f.interpro_id is not null and f.interpro_entry_type is null)), 0)), 0)",
}


def check_models(models: DataFrame, counts: dict[str, int]) -> dict[str, int]:
    """The counts (MODEL_COUNTS) by status and of features of ready transcripts; no ready transcript, or an entry without a type on one, is an error. The models are read only to name such entries."""
    if counts["untyped"]:
        features = models.filter("status = 'ready'").select(F.explode("protein_features").alias("f")).filter("f.interpro_id is not null and f.interpro_entry_type is null")
        missing = [r[0] for r in features.select("f.interpro_id").distinct().orderBy("interpro_id").limit(10).collect()]
        raise ValueError(f"Entries without a type: {', '.join(missing)}")
    if not counts["ready"]:
        raise ValueError("No transcript is ready")
    return {name: counts[name] for name in ("ready", "noncoding", "error", "protein_features")}


def with_sequences(models: DataFrame, chunks: DataFrame, *, size: int) -> DataFrame:
    """models with their pre-mRNA, read from the chunks that hold it; only ready models are read."""
    asked = models.filter("status = 'ready'").select(
        F.col("transcript_id").alias("request_id"), F.col("chromosome").alias("sequence_id"), F.col("transcript_genomic_start").alias("start"), F.col("transcript_genomic_end").alias("end"), "strand"
    )
    bases = fetch(asked, chunks.filter("kind = 'dna'").select("sequence_id", "chunk_start", F.col("bases")), size=size).join(asked.select("request_id", "start", "end"), "request_id")
    whole = F.when(F.length("bases") == F.col("end") - F.col("start") + 1, F.col("bases")).otherwise(F.raise_error(F.concat(F.lit("Missing or damaged sequence chunks of "), F.col("request_id"))))
    read = bases.select(F.col("request_id").alias("transcript_id"), whole.alias("read"))
    return models.join(read, "transcript_id", "left").withColumn("premrna_sequence", F.col("read")).drop("read")

"""A made-up reference built from dump files, sequences and feature lists, end to end; what it should hold is worked out base by base."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from chimerascope import schemas
from chimerascope.operators import joins
from chimerascope.plans import report
from chimerascope.plans.annotate import annotate_one
from chimerascope.plans.build import build_lake
from chimerascope.plans.models import source_counts
from chimerascope.sources import dump, fasta, interpro, lake as lakes, panther
from chimerascope.sources.lake import Lake, Store, find_release, install, select_reference
from chimerascope.streaming.annotate import annotate_stream

RNG = random.Random(77)
GENOME = {"5": "".join(RNG.choice("ACGT") for _ in range(800)), "X": "".join(RNG.choice("ACGT") for _ in range(610))}
INT, TEXT, REAL = "int(10)", "varchar(200)", "double"
COLUMNS = {
    "seq_region": {"seq_region_id": INT, "name": TEXT, "coord_system_id": INT, "length": INT},
    "coord_system": {"coord_system_id": INT, "version": TEXT},
    "transcript": {"transcript_id": INT, "seq_region_id": INT, "seq_region_start": INT, "seq_region_end": INT, "seq_region_strand": "tinyint(2)", "is_current": "tinyint(1)", "canonical_translation_id": INT, "stable_id": TEXT, "version": "smallint(5)"},
    "translation": {"translation_id": INT, "transcript_id": INT, "seq_start": INT, "start_exon_id": INT, "seq_end": INT, "end_exon_id": INT, "stable_id": TEXT, "version": INT},
    "exon": {"exon_id": INT, "seq_region_id": INT, "seq_region_start": INT, "seq_region_end": INT, "seq_region_strand": INT, "phase": INT},
    "exon_transcript": {"exon_id": INT, "transcript_id": INT, "rank": INT},
    "analysis": {"analysis_id": INT, "logic_name": TEXT, "db": TEXT, "db_version": TEXT},
    "protein_feature": {"protein_feature_id": INT, "translation_id": INT, "seq_start": INT, "seq_end": INT, "hit_name": TEXT, "hit_description": "text", "analysis_id": INT, "evalue": REAL},
    "interpro": {"interpro_ac": TEXT, "id": TEXT},
    "xref": {"xref_id": INT, "external_db_id": INT, "dbprimary_acc": TEXT, "display_label": TEXT, "description": "text"},
    "object_xref": {"object_xref_id": INT, "ensembl_id": INT, "ensembl_object_type": TEXT, "xref_id": INT},
    "external_db": {"external_db_id": INT, "db_name": TEXT},
}
# number: chromosome, strand, where it starts, lengths of its exons and of the introns between, coding bases left out at either end, phase, residues more than the CDS has
PLAN = {
    21: ("5", 1, 40, (17, 26, 30), (9, 14), (5, 8), 0, 0), 22: ("X", -1, 120, (33, 21), (40,), (9, 9), 0, 0), 23: ("X", 1, 400, (20, 22), (11,), (3, 5), 2, 0),
    24: ("5", -1, 500, (30, 30), (20,), None, 0, 0), 25: ("5", 1, 300, (24, 24), (16,), (0, 0), 0, 3), 26: ("X", 1, 30, (36,), (), (3, 3), 0, 0),
}
FEATURES = {21: [("SIG1", "first", 1, 2, 9), ("SIG2", "\\N", 1, 4, 9), ("SIG1", "first", 1, 11, 14), ("PTHR7", "fam", 3, 1, 12)], 22: [("SIG1", "first", 1, 3, 7), ("2xyz", "", 2, 1, 900)], 26: [("SIG2", "", 1, 9, 11)]}


def complement(bases):
    return bases[::-1].translate(str.maketrans("ACGT", "TGCA"))


def planned():
    """The dump's rows, the peptides, and for each transcript its pre-mRNA and the genomic place of each coding base in order of translation."""
    rows, peptides, want = {name: [] for name in COLUMNS}, {}, {}
    regions = {"5": 50, "X": 51}
    rows["seq_region"] = [(n, name, 7, len(GENOME[name])) for name, n in regions.items()]
    rows["coord_system"] = [(7, "GRCh38")]
    for number, (chromosome, strand, first, lengths, introns, left_out, phase, more) in PLAN.items():
        spans, at = [], first
        for length, gap in zip(lengths if strand == 1 else lengths[::-1], (*(introns if strand == 1 else introns[::-1]), 0), strict=True):
            spans.append((at, at + length - 1))
            at += length + gap
        spans = spans[::strand]
        low, high = min(a for a, _ in spans), max(b for _, b in spans)
        places = [p for a, b in spans for p in (range(a, b + 1) if strand == 1 else range(b, a - 1, -1))]
        coding = [] if left_out is None else places[left_out[0] : len(places) - left_out[1]]
        rows["transcript"].append((number, regions[chromosome], low, high, strand, 1, number + 100 if coding else "\\N", f"ENST{number:011d}", 2))
        ids = [number * 10 + i for i in range(len(spans))]
        rows["exon"] += [(e, regions[chromosome], a, b, strand, phase if coding and i == 0 else -1) for i, (e, (a, b)) in enumerate(zip(ids, spans, strict=True))]
        rows["exon_transcript"] += [(e, number, i + 1) for i, e in enumerate(ids)]
        if coding:
            rows["translation"].append((number + 100, number, left_out[0] + 1, ids[0], lengths[-1] - left_out[1], ids[-1], f"ENSP{number:011d}", 1))
            peptides[f"ENSP{number:011d}.1"] = "".join(RNG.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range((len(coding) + phase) // 3 + more))
        whole = GENOME[chromosome][low - 1 : high]
        want[f"ENST{number:011d}"] = (whole if strand == 1 else complement(whole), [(p, phase + i + 1) for i, p in enumerate(coding)])
    rows["transcript"].append((99, 50, 1, 9, 1, 0, "\\N", "ENST00000000099", 1))
    rows["analysis"] = [(1, "pfam", "Pfam", "36"), (2, "sifts", "SIFTS", "1"), (3, "hmmpanther", "PANTHER", "17.0")]
    n = 0
    for number, features in FEATURES.items():
        for hit, text, analysis, a, b in features:
            n += 1
            rows["protein_feature"].append((n, number + 100, a, b, hit, text, analysis, 0.25))
    rows["interpro"] = [("IPR000011", "SIG1"), ("IPR000011", "SIG2"), ("IPR000012", "UNUSED")]
    rows["xref"] = [(1, 1, "IPR000011", "label", "a core\\tname"), (2, 1, "ipr000012", "second", ""), (3, 2, "Q9", "Q9", ""), (4, 3, "Q9", "Q9", ""), (5, 2, "K1", "K1", "")]
    rows["external_db"] = [(1, "Interpro"), (2, "Uniprot/SWISSPROT"), (3, "Other")]
    rows["object_xref"] = [(1, 121, "Translation", 3), (2, 122, "Translation", 4), (3, 121, "Gene", 5), (4, 121, "Translation", 5)]
    return rows, peptides, want


ROWS, PEPTIDES, WANT = planned()
P21, P22 = PEPTIDES["ENSP00000000021.1"], PEPTIDES["ENSP00000000022.1"]


def xml():
    """Two entries: one that names the second peptide itself, and one that only the dump's cross references lead to the first."""
    site = lambda kind, a, b, name: f'<feature type="{kind}" id="{name}" description="{name}"><location><begin position="{a}"/><end position="{b}"/></location></feature>'
    head = '<entry dataset="Swiss-Prot"><accession>{0}</accession><organism><dbReference type="NCBI Taxonomy" id="9606"/></organism>'
    own = '<dbReference type="Ensembl" id="T"><property type="protein sequence ID" value="ENSP00000000022.1"/></dbReference>'
    one = head.format("Z1") + own + site("domain", 2, 5, "inner") + f'<sequence length="{len(P22)}">{P22}</sequence></entry>'
    other = head.format("Q9") + site("active site", 6, 6, "spot") + f'<sequence length="{len(P21)}">{P21}</sequence></entry>'
    return f'<uniprot xmlns="http://uniprot.org/uniprot">{one}{other}</uniprot>'


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("source")
    ddl = [f"CREATE TABLE `{name}` (\n" + ",\n".join(f"  `{c}` {t} DEFAULT NULL" for c, t in columns.items()) + ",\n  KEY `k` (`x`)\n) ENGINE=MyISAM;\n" for name, columns in COLUMNS.items()]
    (folder / "schema.sql").write_text("-- dump\n" + "\n".join(ddl))
    for name, rows in ROWS.items():
        (folder / f"{name}.txt").write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
    wrap = lambda text: "\n".join(text[i : i + 70] for i in range(0, len(text), 70))
    (folder / "dna.fa").write_text("".join(f">{n} dna\n{wrap(b if n == '5' else b.lower())}\n" for n, b in GENOME.items()))
    (folder / "pep.fa").write_text("".join(f">{n} pep\n{wrap(b)}\n" for n, b in PEPTIDES.items()))
    (folder / "entries.tsv").write_text("ENTRY_AC\tENTRY_TYPE\tENTRY_NAME\nIPR000011\tActive-site like\tGiven name\n")
    (folder / "untyped.tsv").write_text("ENTRY_AC\tENTRY_TYPE\tENTRY_NAME\nIPR000011\t\tGiven name\n")
    (folder / "older.tsv").write_text("ENTRY_AC\tENTRY_TYPE\tENTRY_NAME\nIPR000011\tMotif\tOld name\n")
    (folder / "families-17.0.tsv").write_text("HUMAN|HGNC=1|UniProtKB=K1\tK1\tSYM\tPTHR7:SF4\tFamily\tSeventh subfamily\tGO\n")
    (folder / "curated.xml").write_text(xml())
    return folder


def settings(source):
    return {"release": "110", "entries": f"{source}/entries.tsv", "curated": f"{source}/curated.xml", "classes": f"{source}/families-{{release}}.tsv", "chunk": 90}


@pytest.fixture(scope="module")
def lake(spark, source, tmp_path_factory):
    return build_lake(spark, str(source), str(tmp_path_factory.mktemp("lakes") / "release-110"), **settings(source))


def test_models_base_by_base(lake):
    models = {r["transcript_id"]: r for r in lake.models().collect()}
    assert models.keys() == WANT.keys()
    status = {k: (r["status"], r["model_error"]) for k, r in models.items()}
    assert [status[f"ENST{n:011d}"][0] for n in PLAN] == ["ready", "ready", "ready", "noncoding", "error", "error"]
    assert "CDS/peptide length mismatch" in status["ENST00000000025"][1] and "outside peptide: SIG2" in status["ENST00000000026"][1]
    for name, row in models.items():
        if row["status"] != "ready":
            continue
        bases, coding = WANT[name]
        assert row["premrna_sequence"] == bases and row["premrna_length"] == len(bases)
        got = [(p, b["cds_start"] + i) for b in row["cds_blocks"] for i, p in enumerate(range(b["genomic_start"], b["genomic_end"] + 1)[:: row["strand"]])]
        assert got == coding
        place = lambda g, row=row: g - row["transcript_genomic_start"] + 1 if row["strand"] == 1 else row["transcript_genomic_end"] - g + 1
        assert all((b["premrna_start"], b["premrna_end"]) == tuple(sorted((place(b["genomic_start"]), place(b["genomic_end"])))) for b in row["cds_blocks"])
        where = dict((n, g) for g, n in coding)
        for f in row["protein_features"]:
            held = sorted(where[n] for n in range(3 * f["start"] - 2, 3 * f["end"] + 1) if n in where)
            assert sorted(g for s in f["segments"] for g in range(s["start"], s["end"] + 1)) == held
    assert {k: v for k, v in lake.metadata.items() if k.startswith("n_")} == {"n_ready": "3", "n_noncoding": "1", "n_error": "2", "n_protein_features": "7"}
    assert [(r["reason"], r["n"], r["examples"]) for r in lake.error_summary().collect()] == [("CDS/peptide length mismatch", 1, "ENST00000000025"), ("Protein feature falls outside peptide", 1, "ENST00000000026")]


def test_features_of_all_sources(lake):
    features = {(r["transcript_id"][-2:], f["feature_id"], f["start"]): f for r in lake.models().filter("status = 'ready'").collect() for f in r["protein_features"]}
    assert set(features) == {("21", "SIG1", 2), ("21", "SIG2", 4), ("21", "SIG1", 11), ("21", "PTHR7", 1), ("21", "spot", 6), ("22", "SIG1", 3), ("22", "inner", 2)}
    signature, family, spot = features["21", "SIG2", 4], features["21", "PTHR7", 1], features["21", "spot", 6]
    assert (signature["source"], signature["interpro_id"], signature["interpro_name"], signature["interpro_entry_type"], signature["description"]) == ("Pfam", "IPR000011", "Given name", "active_site_like", "Given name")
    assert (family["source"], family["panther_subfamily_id"], family["panther_subfamily_description"]) == ("PANTHER", "PTHR7:SF4", "Seventh subfamily")
    assert (spot["source"], spot["feature_type"], spot["uniprot_accession"]) == ("UniProtKB", "active_site", "Q9")
    assert {k: v for k, v in lake.metadata.items() if k.startswith("curated")} == {"curated_reviewed_entries": "2", "curated_matched_proteins": "2", "curated_features": "2", "curated_sequence_mismatches": "0"}
    assert lake.entry("IPR000011") == {"interpro_id": "IPR000011", "name": "Given name", "entry_type": "active_site_like"} and lake.entry("IPR9") is None


def test_checked_reads(spark, lake):
    for a, b, strand in ((1, 1, 1), (85, 300, 1), (90, 91, -1), (1, 800, -1)):
        cut = GENOME["5"][a - 1 : b]
        assert lake.sequence("dna", "5", a, b, strand) == (cut if strand == 1 else complement(cut))
    assert lake.sequence("pep", "ENSP00000000022") == P22 and lake.sequence("dna", "X") == GENOME["X"]
    for wrong in (("dna", "5", 0, 3), ("dna", "5", 4, 3), ("dna", "X", 600, 611), ("dna", "7"), ("pep", "ENSP00000000022.1", 1, 2, -1), ("dna", "5", 1, 2, 0)):
        with pytest.raises(ValueError):
            lake.sequence(*wrong)
    kinds = "kind string, sequence_id string, stable_id string, length int"
    index = spark.createDataFrame([("pep", "P.1", "P", 4), ("pep", "P.2", "P", 4), ("dna", "c", "c", 9)], kinds)
    chunks = spark.createDataFrame([("pep", "P.1", 1, "MKLM"), ("dna", "c", 1, "ACGT"), ("dna", "gone", 1, "ACGT")], "kind string, sequence_id string, chunk_start int, bases string")
    asked = spark.createDataFrame([(1, "pep", "P", 1, 2, 1), (2, "pep", "P.1", 2, 3, 1), (3, "dna", "c", 3, 6, 1)], "request_id int, kind string, sequence_id string, start int, end int, strand int")
    got = {r["request_id"]: (r["bases"], r["error"]) for r in joins.read_intervals(asked, index, chunks, size=4).collect()}
    assert got == {1: (None, "Sequence is missing or ambiguous"), 2: ("KL", None), 3: (None, "Missing or damaged sequence chunks")}
    assert {r["sequence_id"] for r in fasta.without_orphans(chunks, index).collect()} == {"P.1", "c"}


def test_transcript_reads(lake):
    one = lake.transcript("ENST00000000022.2")
    assert one["premrna_sequence"] == WANT["ENST00000000022"][0] and one["version"] == 2
    assert lake.transcript("ENST00000000022", include_sequence=False).get("premrna_sequence") is None
    errors = {"ENST00000000022.3": "version differs", "ENST00000000024": "no translation", "ENST00000000025": "length mismatch", "ENST00000000077": "not in the reference", "X1": "Invalid"}
    assert all(text in lake.transcript(name)["error"] for name, text in errors.items())


def test_features_follow_the_cut(spark, lake):
    _, coding = WANT["ENST00000000021"]
    cut = coding[20][0]
    got = annotate_one(spark, lake.models(), transcript1_id="ENST00000000021", breakpoint1=f"5:{cut}", gene1_terminus="N")
    kept = {n for g, n in coding if g <= cut}
    for d in got["domains"]:
        whole = set(range(3 * d["start"] - 2, 3 * d["end"] + 1))
        assert d["breakpoint_retained_percent"] == round(100 * len(whole & kept) / len(whole), 1)
    assert {d["name"] for d in got["domains"]} == {"spot"}


def test_export_and_install(spark, lake, tmp_path):
    lake.export(f"{tmp_path}/export", revision=2)
    with pytest.raises(FileExistsError):
        lake.export(f"{tmp_path}/export", revision=2)
    put = install(spark, f"{tmp_path}/export", f"{tmp_path}/release-7")
    assert put.metadata == lake.metadata
    assert find_release(Store(spark), str(tmp_path)) == f"{tmp_path}/release-7" and lakes.resolve(spark, cache=str(tmp_path)).path == put.path
    with pytest.raises(FileNotFoundError):
        find_release(Store(spark), str(tmp_path), 8)
    with pytest.raises(ValueError, match="release"):
        Lake(spark, put.path, release="111")
    changed = spark.read.parquet(f"{tmp_path}/export/entries").withColumn("name", F.lit("other"))
    shutil.copytree(f"{tmp_path}/export", f"{tmp_path}/damaged")
    changed.write.mode("overwrite").parquet(f"{tmp_path}/damaged/entries")
    with pytest.raises(ValueError, match="entries .* changed"):
        install(spark, f"{tmp_path}/damaged", f"{tmp_path}/release-9")
    assert not lakes.committed(Store(spark), f"{tmp_path}/release-9")


def test_resume_only_with_the_same_files(spark, source, lake, tmp_path):
    own = tmp_path / "source"
    shutil.copytree(source, own)
    with pytest.raises(ValueError, match="IPR000011"):
        build_lake(spark, str(own), f"{tmp_path}/out", **settings(own) | {"entries": f"{own}/untyped.tsv"})
    (own / "seq_region.txt").write_text((own / "seq_region.txt").read_text().replace(str(len(GENOME["X"])), "611"))
    with pytest.raises(ValueError, match="matches no region"):
        build_lake(spark, str(own), f"{tmp_path}/out", **settings(own))
    shutil.copy(source / "seq_region.txt", own / "seq_region.txt")
    again = build_lake(spark, str(own), f"{tmp_path}/out", **settings(own) | {"entries": f"{own}/untyped.tsv", "history": {"98.0": f"{own}/older.tsv"}})
    assert again.entry("IPR000011") == {"interpro_id": "IPR000011", "name": "Given name", "entry_type": "motif"}
    with pytest.raises(FileExistsError):
        build_lake(spark, str(own), f"{tmp_path}/out", **settings(own))


def test_stream(spark, lake, tmp_path):
    from chimerascope.plans import staging

    rows = [{"event_id": "e1", "transcript1_id": "ENST00000000021", "breakpoint1": "5:60", "gene1_terminus": "N"}, {"event_id": "e2", "transcript1_id": "ENST00000000098", "breakpoint1": "5:1", "gene1_terminus": "N"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    events, before = spark.readStream.schema(schemas.ddl(schemas.EVENT)).json(f"{tmp_path}/in"), staging.mark()
    annotate_stream(events, lake.models(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r["event_id"]: r["error"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["e1"] is None and "not in the reference" in got["e2"] and staging.mark() == before


def test_cases_and_report(spark, tmp_path):
    write = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and f"{tmp_path}/{name}"
    good = [{"event_id": "a", "transcript1_id": "T"}, {"event_id": "b", "gene1_terminus": "N"}]
    assert report.load_cases(spark, write("good.json", good)).count() == 2
    for name, bad in {"key": [{"event_id": "a", "gene": "x"}], "kind": [{"event_id": "a", "breakpoint1": 7}], "twice": [good[0], good[0]], "nameless": [{"transcript1_id": "T"}, good[1]]}.items():
        with pytest.raises(ValueError):
            report.load_cases(spark, write(f"{name}.json", bad)).collect()
    timings = spark.createDataFrame([("o", "p", i % 10 > 0, float(i), 1.0, i) for i in range(1, 41)], "operation string, phase string, ok boolean, wall double, cpu double, n int")
    report.write_report(timings, f"{tmp_path}/report", tie="n")
    row = spark.read.json(f"{tmp_path}/report/summary").first()
    assert (row["successes"], row["errors"], row["wall"], row["median"], row["p95"], row["max"]) == (36, 4, 820.0, 20.5, 38.0, 40.0)
    assert [r["n"] for r in spark.read.json(f"{tmp_path}/report/slowest").orderBy(F.desc("wall")).collect()] == [40, 39, 38, 37, 36]
    with pytest.raises(FileExistsError):
        report.write_report(timings, f"{tmp_path}/report", tie="n")


def test_source_counts(spark):
    found = spark.createDataFrame([(1,), (1,), (2,)], "analysis_id int")
    analysis = spark.createDataFrame([(1, "pfam", "36"), (2, "smart", None)], "analysis_id int, logic_name string, db_version string")
    assert {tuple(r) for r in source_counts({"protein_feature": found, "analysis": analysis}).collect()} == {("pfam", None, "36", 2), ("smart", None, None, 1)}


def test_dump_rows(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\ta\\tb\\\\n\\q\\N\t\\N\r\n")
    row = dump.read_table(spark, f"{tmp_path}/t.txt", [("a", "bigint"), ("b", "string"), ("c", "double")]).first()
    assert tuple(row) == (1, "a\tb\\nqN", None)
    (tmp_path / "bad.txt").write_text("1\t2\n")
    with pytest.raises(Exception, match="Expected 3 fields, found 2"):
        dump.read_table(spark, f"{tmp_path}/bad.txt", [("a", "bigint"), ("b", "string"), ("c", "double")]).collect()
    with pytest.raises(ValueError):
        dump.parse_schema("SELECT 1")


def test_fasta_checks(spark, tmp_path):
    (tmp_path / "bad.fa").write_text(">x\nACGZ\n")
    with pytest.raises(Exception, match="alphabet"):
        fasta.index(fasta.read_chunks(spark, f"{tmp_path}/bad.fa", "dna")).collect()
    (tmp_path / "empty.fa").write_text(">x\n>y\nAC\n")
    with pytest.raises(Exception, match="Empty FASTA"):
        fasta.index(fasta.read_chunks(spark, f"{tmp_path}/empty.fa", "dna")).collect()


def test_history_fills_missing_types_only(spark):
    kinds = "interpro_id string, entry_type string, name string"
    core = spark.createDataFrame([("IPR1", None, "core"), ("IPR2", None, "core")], kinds)
    supplied = spark.createDataFrame([("IPR2", "domain", None)], kinds)
    old, newer = spark.createDataFrame([("IPR1", "family", "x"), ("IPR2", "family", "x")], kinds), spark.createDataFrame([("IPR1", "site", "y")], kinds)
    got = {r["interpro_id"]: (r["name"], r["entry_type"]) for r in interpro.resolved(core, None, supplied, [("9.0", old), ("10.0", newer)]).collect()}
    assert got == {"IPR1": ("core", "site"), "IPR2": ("x", "domain")}
    used = spark.createDataFrame([("IPR1",), ("IPR7",)], "interpro_id string")
    assert [r[0] for r in interpro.unresolved(used, interpro.resolved(core, None, supplied, [("9.0", old)])).collect()] == ["IPR7"]


@pytest.mark.parametrize("row", ["HUMAN|HGNC=1|UniProtKB=P1\tP1\tSYM\tPTHR1:SF2\tFamily\tSubfamily", "HUMAN|HGNC=1|UniProtKB=P1\t\tPTHR1:SF2\tFamily\tSubfamily\tGO"])
def test_family_layouts(spark, tmp_path, row):
    (tmp_path / "c.txt").write_text(row + "\n")
    classes = panther.read_classes(spark, f"{tmp_path}/c.txt")
    assert [tuple(r) for r in classes.collect()] == [("P1", "PTHR1:SF2", "Subfamily")]
    xref = spark.createDataFrame([(5, "P1"), (6, "P1")], "xref_id long, dbprimary_acc string")
    links = spark.createDataFrame([(5, 50, "Translation"), (6, 51, "Gene")], "xref_id long, ensembl_id long, ensembl_object_type string")
    assert [tuple(r) for r in panther.assignments(classes, xref, links).collect()] == [(50, "PTHR1:SF2", "Subfamily")]
    fits = spark.createDataFrame([("PTHR1", "PTHR1:SF2"), ("PTHR1:SF3", "PTHR1:SF2"), ("PTHR2", "PTHR1:SF2")], "h string, s string").select(panther.fits_hit(F.col("h"), F.col("s")))
    assert [r[0] for r in fits.collect()] == [True, False, False]


def test_catalog(spark):
    rows = [("110", 1, {"assembly": "GRCh38"}), ("110", 2, {"assembly": "GRCh38"}), ("111", 3, {"assembly": "GRCh37"})]
    catalog = spark.createDataFrame(rows, "release string, build_revision int, metadata map<string,string>")
    assert select_reference(catalog, release="110", assembly="GRCh38")["build_revision"] == 2
    with pytest.raises(ValueError):
        select_reference(catalog, release="112")
    with pytest.raises(ValueError, match="lacks"):
        select_reference(catalog.drop("metadata"), release="110")


def test_one_class_release(spark):
    kinds = "db_version string"
    assert panther.release(spark.createDataFrame([("17.0",), ("17.0",)], kinds)) == "17.0"
    for bad in ([("17.0",), ("18.0",)], [("v17",)], [(None,)]):
        with pytest.raises(ValueError):
            panther.release(spark.createDataFrame(bad, kinds))


def test_domains_of_transcripts(spark, lake):
    ids = spark.createDataFrame([("ENST00000000022.2",), ("ENST00000000025",)], "transcript_id string")
    rows = lake.protein_domains(ids).collect()
    assert {r["feature_id"] for r in rows if r["error"] is None} == {"SIG1", "inner"}
    assert [r["asked_id"] for r in rows if r["error"] is not None] == ["ENST00000000025"]
    assert lakes.protein_domains(spark, "ENST00000000022", lake.path)["version"] == 2


def test_changed_classes_are_read_anew(spark, source, tmp_path):
    own = tmp_path / "source"
    shutil.copytree(source, own)
    untyped = settings(own) | {"entries": f"{own}/untyped.tsv"}
    prints = lambda: json.loads((tmp_path / "out/snapshots/000001/settings").read_text())["files"]["classes"]
    with pytest.raises(ValueError, match="IPR000011"):
        build_lake(spark, str(own), f"{tmp_path}/out", **untyped)
    before = prints()
    (own / "families-17.0.tsv").write_text((own / "families-17.0.tsv").read_text().replace("Seventh", "Other"))
    with pytest.raises(ValueError, match="IPR000011"):
        build_lake(spark, str(own), f"{tmp_path}/out", **untyped)
    assert prints() != before
    with pytest.raises(ValueError, match="positive"):
        build_lake(spark, str(own), f"{tmp_path}/out", **settings(own) | {"release": "x"})
    with pytest.raises(ValueError, match="coordinate system"):
        build_lake(spark, str(own), f"{tmp_path}/other", **settings(own) | {"assembly": "T2T"})

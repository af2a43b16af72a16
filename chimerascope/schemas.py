"""The columns of the tables that the engine reads and writes, in order, with their Spark types."""

from __future__ import annotations


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


EVENT = dict.fromkeys(
    ("event_id", "transcript1_id", "transcript2_id", "breakpoint1", "breakpoint2", "gene1_terminus", "gene2_terminus", "inserted_sequence"), "string"
)
EXON = "struct<exon_number:int,genomic_start:int,genomic_end:int,premrna_start:int,premrna_end:int>"
SITE = "struct<type:string,exon_number:int,genomic_position:int,premrna_position:int,disruption_start:int,disruption_end:int>"
BLOCK = "struct<genomic_start:int,genomic_end:int,premrna_start:int,premrna_end:int,cds_start:int,cds_end:int,strand:int>"
EVIDENCE = "struct<code:string,source:string,id:string>"
_FEATURE_FIELDS = {
    **dict.fromkeys(("feature_id", "source", "interpro_id", "interpro_entry_type", "interpro_name", "description"), "string"), **dict.fromkeys(("start", "end", "cds_start", "cds_end"), "int"),
    "segments": "array<struct<start:int,end:int>>",
    **dict.fromkeys(("feature_type", "uniprot_accession", "uniprot_isoform", "panther_subfamily_id", "panther_subfamily_description"), "string"), "evidence": f"array<{EVIDENCE}>",
}
FEATURE = "struct<" + ",".join(f"{name}:{kind}" for name, kind in _FEATURE_FIELDS.items()) + ">"


def feature_fields() -> list[tuple[str, str]]:
    return list(_FEATURE_FIELDS.items())


MODEL = {
    "transcript_id": "string", "version": "int", "translation_id": "string", "translation_version": "int", "status": "string", "model_error": "string",
    "chromosome": "string", "assembly_name": "string", "strand": "int", "transcript_genomic_start": "int", "transcript_genomic_end": "int",
    "premrna_length": "int", "protein_length": "int", "cds_start_phase": "int", "premrna_sequence": "string", "transcript_exons": f"array<{EXON}>",
    "splice_sites": f"array<{SITE}>", "cds_blocks": f"array<{BLOCK}>", "protein_features": f"array<{FEATURE}>",
}

"""Explicit types of the model's tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

MENTION = "struct<text:string,start:int,end:int,score:double,ner_model_version:string,entity_type:string>"
LINK = f"struct<mention:{MENTION},ontology_id:string,confidence:double,method:string,linker_version:string>"
_DDL = {
    "chunks": f"chunk_id string, text string, source_doc_id string, source_type string, section_type string, year int, source_metadata string, embedding array<float>, embedding_model string, mentions array<{MENTION}>, entity_links array<{LINK}>, term_ids array<string>, shelf_ids array<string>, theme_ids array<string>, enrichment_version string, created_at timestamp",
    "links": "chunk_id string, term_id string, surface string, entity_type string, confidence double, method string",
    "terms": "id string, label string, synonyms array<string>, related_synonyms array<string>, parent_ids array<string>, ancestor_ids array<string>, obsolete boolean",
    "entities": "ontology_id string, prefix string, label string, synonyms array<string>, ancestor_ids array<string>, facet_hint string, mention_count bigint, chunk_count bigint, chunk_ids array<string>, last_seen timestamp",
    "shelves": "shelf_id string, label string, display_label string, facet string, depth int, term_id string, parent_shelf_id string, chunk_count bigint, support_direct bigint, support_lifted bigint, see_also array<string>, status string",
    "themes": "theme_id string, label string, parent_theme_id string, shelf_ids array<string>, chunk_count bigint, discovered_by string, discovery_version string, facet string, discovery_pass string, keyword_terms array<string>, term_signature array<string>, config_hash string, version string",
    "cards": "card_id string, target_id string, target_type string, title string, summary string, tip string, evidence_quality string, controversy_note string, confidence_note string, cited_chunk_ids array<string>, evidence_sentences array<string>, llm_model string, prompt_version string, safety_flagged boolean, generated_at timestamp, embedding array<float>, embedding_model string",
    "shelf_edges": "chunk_id string, shelf_id string, lifted_from array<string>",
    "theme_edges": "chunk_id string, theme_id string, primary boolean, weight double",
    "mention_edges": "chunk_id string, ontology_id string, confidence double, method string",
    "artifacts": "artifact_id string, phase string, config_hash string, upstream_artifact_ids array<string>, record_count bigint, schema_version string, created_at timestamp",
    "gold": "text string, expected_id string, tier string",
}


def schema_of(table: str) -> T.StructType:
    """The struct type of a table; parsing needs an active session."""
    return T.StructType.fromDDL(_DDL[table])

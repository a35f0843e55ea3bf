"""Schemas of the stored tables."""

from __future__ import annotations

VECTOR = "array<float>"
CORPUS = "corpus_name string, context string"
QUESTIONS = "id string, source string, question string, answer string, question_type string, evidence string, evidence_relations string"
PASSAGES = f"passage_id string, text string, embedding {VECTOR}"
UNITS = f"su_id string, text string, embedding {VECTOR}"
PASSAGE_UNITS = "passage_id string, pos int, su_id string"
MENTIONS = "mention_id string, passage_id string, su_id string, surface_text string, normalized_name string, entity_type string, description string, char_start int, char_end int, grounded boolean"
SUPPORT = "mention_id string, passage_id string, su_id string, entity_id string"
EXTRACTIONS_VERSION, ENTITIES_VERSION = 2, 1
ENTITIES = (
    "entity_id string, canonical_name string, canonical_description string, entity_type string, aliases array<string>, description_variants array<string>, "
    f"mention_count long, su_count int, passage_count int, embedding_text string, embedding {VECTOR}"
)
PREDICTIONS = "question string, pred_answer string, gold_answer string, sorted_passage array<string>, sorted_passage_scores array<double>"
PLAN = "struct<original_query:string,is_complex:boolean,reasoning:string,sub_queries:array<struct<id:string,query:string,purpose:string,answer_type:string>>,synthesis_instruction:string>"

"""Schemas and vocabularies. Times are UTC timestamps; seq is ingest order and breaks every tie."""

from __future__ import annotations

#: The fields' names.
ENTITIES = "id string not null, type string, name string, summary string, consolidated boolean not null, consolidation_run_id string, created_at timestamp, seq bigint"
EDGES = (
    "id string not null, source string not null, target string not null, relation string not null, fact string, valid_from timestamp, valid_until timestamp,"
    " confidence double, source_type string, source_id string, ingested_at timestamp, extracted_by string, seq bigint"
)
EPISODES = "id string not null, text string, source_type string, source_id string, reference_time timestamp, ingested_at timestamp, metadata string, seq bigint"
EXTRACTION = (
    "nodes array<struct<name:string,type:string>>, edges array<struct<source:string,target:string,relation:string,fact:string>>,"
    " unmapped_entities array<struct<name:string,attempted_type:string,fact:string,reason:string>>,"
    " unmapped_relations array<struct<source:string,target:string,attempted_relation:string,fact:string,reason:string>>"
)
INTENT = "pattern string, anchor_entity string, relation string, direction string, target_entity string"
CONSOLIDATION = "summary string, semantic_edges array<struct<relation:string,target:string,fact:string>>, episodic_only array<string>"

MENTION = "MENTIONED_IN"
#: Fixed value: the fact of a mention.
MENTION_FACT = "entity mentioned in this episode"
#: The vocabularies that stores, prompts and answers share.
NODE_TYPES = ("person", "service", "team", "tool", "concept")
STANDING_RELATIONS = ("MEMBER_OF", "OWNS", "DEPENDS_ON", "USES", "REPORTED", "RESOLVED_BY")
RELATIONS = (*STANDING_RELATIONS, MENTION)
PATTERNS = ("direct_lookup", "neighborhood", "path", "impact", "history")
DIRECTIONS = ("in", "out")
TABLES = {"entities": ENTITIES, "edges": EDGES, "episodes": EPISODES}

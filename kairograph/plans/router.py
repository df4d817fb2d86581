"""A question's intent, checked and run as one of the five patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairograph.clients import Client, json_schema, validated
from kairograph.operators import rank, traverse
from kairograph.operators.lookup import Graph
from kairograph.schema import DIRECTIONS, INTENT, PATTERNS, RELATIONS


@dataclass
class Intent:
    pattern: str
    anchor_entity: str
    relation: str | None = None
    direction: str | None = None
    target_entity: str | None = None


def route(question: str, client: Client) -> Intent:
    """The client's intent; anything outside the vocabularies raises."""
    kind = T._parse_datatype_string(INTENT)  # noqa: SLF001
    allowed, optional = {"pattern": PATTERNS, "relation": RELATIONS, "direction": DIRECTIONS}, ("relation", "direction", "target_entity")
    raw = client.ask("route", {"question": question}, json_schema(kind, allowed, optional))
    return Intent(**validated(raw, kind, allowed, optional=optional))


def check(graph: Graph, intent: Intent) -> dict | None:
    """An error as a dict, or None. One job looks up both ids. The errors' texts and keys, which callers read."""
    wanted = [x for x in (intent.anchor_entity, intent.target_entity) if x is not None]
    found = {(r.id, r.kind) for r in graph.entities.select("id", F.lit("entity").alias("kind")).union(graph.episodes.select("id", F.lit("episode").alias("kind"))).where(F.col("id").isin(wanted)).collect()}
    ids = {i for i, _ in found}
    if intent.anchor_entity not in ids:
        return {"error": "entity not found", "anchor_entity": intent.anchor_entity}
    if intent.pattern == "path" and intent.target_entity is None:
        return {"error": "path query missing target_entity"}
    if intent.pattern == "path" and intent.target_entity not in ids:
        return {"error": "target entity not found", "target_entity": intent.target_entity}
    for end in (intent.anchor_entity, intent.target_entity if intent.pattern == "path" else intent.anchor_entity):
        if (end, "entity") not in found:
            return {"error": "not an entity", "anchor_entity": end}
    if intent.pattern in ("direct_lookup", "impact", "history") and intent.relation is None:
        return {"error": f"{intent.pattern} query missing relation"}
    if intent.pattern not in PATTERNS:
        return {"error": "unknown pattern", "pattern": intent.pattern}
    return None


def execute(graph: Graph, intent: Intent, now, mode: str = "compat") -> DataFrame:
    """Found edges with score and rank: history in time order and unfiltered, the others live and by score."""
    anchor, relation = intent.anchor_entity, intent.relation
    if intent.pattern == "history":
        found = rank.scored(traverse.history(graph, anchor, relation, intent.direction or "out"), now)
        return rank.placed(found, "rank", "valid_from", "seq")
    if intent.pattern == "direct_lookup":
        found = traverse.direct_lookup(graph, anchor, relation, intent.direction or "out")
    elif intent.pattern == "neighborhood":
        found = traverse.neighbourhood(graph, anchor)
    elif intent.pattern == "path":
        found = traverse.shortest_path(graph, anchor, intent.target_entity, mode)
    else:
        found = traverse.impact(graph, anchor, relation, intent.direction or "in")
    return rank.ranked(rank.live(rank.scored(found, now)))


def query(graph: Graph, question: str, client: Client, now) -> DataFrame | dict:
    """Ranked edges, or an error as a dict."""
    intent = route(question, client)
    return check(graph, intent) or execute(graph, intent, now)

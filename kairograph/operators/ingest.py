"""Extracted episodes to graph rows, as sets.

One episode after another would give: a new name's id is its slug, the first mention's type and name win, the first
fact of an open (source, target, relation) wins. With seq for the episode's place and pos for an item's, the same rows
come from windows over a whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions.text import normalize
from kairograph.operators.lookup import Graph, first_per
from kairograph.operators.resolve import canonical
from kairograph.schema import MENTION, MENTION_FACT


@dataclass
class Ingested:
    nodes: DataFrame  # id, type, name, episode_id, seq, pos
    edges: DataFrame  # source, target, relation, fact, valid_from, episode_id, seq, pos
    rejects: DataFrame  # episode_id, source, target, relation, fact: an end that the episode doesn't list
    mentions: DataFrame  # source, target, relation, fact, valid_from
    touched: DataFrame  # id


def explode_nodes(extracted: DataFrame) -> DataFrame:
    return extracted.select("episode_id", "seq", "reference_time", F.posexplode("nodes").alias("pos", "n")).select("episode_id", "seq", "reference_time", "pos", "n.name", "n.type")


def explode_edges(extracted: DataFrame) -> DataFrame:
    return extracted.select("episode_id", "seq", "reference_time", F.posexplode("edges").alias("pos", "e")).select(
        "episode_id", "seq", "reference_time", "pos", F.col("e.source").alias("source_name"), F.col("e.target").alias("target_name"), "e.relation", "e.fact"
    )


def plan(nodes: DataFrame, edges: DataFrame, graph: Graph) -> Ingested:
    """nodes and edges as exploded; episode_id unique in the batch. Nothing is written."""
    named = nodes.withColumn("norm_name", normalize(F.col("name"))).join(canonical(graph.entities), "norm_name", "left")
    named = named.withColumn("id", F.coalesce("entity_id", F.replace("norm_name", F.lit(" "), F.lit("_")))).drop("norm_name", "entity_id")
    new = first_per(named.join(graph.ids().distinct(), "id", "left_anti"), ["id"], "seq", "pos")
    # a name listed twice in an episode has one id
    ids = named.groupBy("episode_id", "name").agg(F.first("id").alias("id"))
    linked = edges.join(ids.select("episode_id", F.col("name").alias("source_name"), F.col("id").alias("source")), ["episode_id", "source_name"], "left")
    linked = linked.join(ids.select("episode_id", F.col("name").alias("target_name"), F.col("id").alias("target")), ["episode_id", "target_name"], "left")
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    key = ["source", "target", "relation"]
    fresh = linked.where(whole).join(graph.open_edges().select(*key).distinct(), key, "left_anti")
    kept = first_per(fresh, key, "seq", "pos").withColumn("valid_from", F.col("reference_time"))
    distinct = named.groupBy("id", "episode_id").agg(F.min("reference_time").alias("valid_from"))
    mentions = distinct.select(
        F.col("id").alias("source"), F.col("episode_id").alias("target"), F.lit(MENTION).alias("relation"),
        F.lit(MENTION_FACT).alias("fact"), "valid_from",
    )
    mentions = mentions.join(graph.open_edges().select(*key).distinct(), key, "left_anti")
    rejects = linked.where(~whole).select("episode_id", F.col("source_name").alias("source"), F.col("target_name").alias("target"), "relation", "fact")
    return Ingested(
        new.select("id", "type", "name", "episode_id", "seq", "pos"),
        kept.select(*key, "fact", "valid_from", "episode_id", "seq", "pos"),
        rejects,
        mentions.select("source", "target", "relation", "fact", "valid_from"),
        named.select("id").distinct(),
    )


def new_episodes(incoming: DataFrame, graph: Graph) -> DataFrame:
    """Rows whose source_id no episode has, the first (by seq) of each; rows without a source_id all stay."""
    known = graph.episodes.where("source_id is not null").select("source_id").distinct()
    named = first_per(incoming.where("source_id is not null").join(known, "source_id", "left_anti"), ["source_id"], "seq")
    return named.unionByName(incoming.where("source_id is null"))


def write(store, episodes: DataFrame, extracted: DataFrame) -> dict[str, int]:
    """Append a batch to a Store: episodes (id, text, ...), extracted (episode_id, seq, reference_time, nodes, edges).

    Episodes come last: after a crash in between, the batch's source ids aren't in the store yet, the batch runs again,
    and what it had written by then is known to the plan and left out.
    """
    from kairograph.operators.settle import settle
    from kairograph.operators.store import edge_id

    graph = store.graph()
    extracted = settle(extracted)  # the model is asked once
    found = plan(explode_nodes(extracted), explode_edges(extracted), graph)
    nodes, edges, mentions, rejects = settle(found.nodes), settle(found.edges), settle(found.mentions), settle(found.rejects)
    dirty = settle(graph.entities.where(F.coalesce("consolidated", F.lit(False))).join(found.touched, "id", "left_semi").select("id"))
    now = F.current_timestamp()
    order = F.struct("seq", "pos").alias("__order")
    store.append("entities", nodes.select("id", "type", "name", F.lit(False).alias("consolidated"), now.alias("created_at"), order))
    for rows, more in ((edges, [order]), (mentions, [])):
        base = [edge_id(F.col("valid_from").cast("string"), F.lit("ingest")).alias("id"), "source", "target", "relation", "fact", "valid_from"]
        store.append("edges", rows.select(*base, F.lit(1.0).alias("confidence"), now.alias("ingested_at"), *more))
    if not dirty.isEmpty():
        store.patch_many("entities", dirty.withColumn("consolidated", F.lit(False)))
    store.append("episodes", episodes)
    return {"episodes": episodes.count(), "nodes": nodes.count(), "edges": edges.count(), "mentions": mentions.count(), "rejects": rejects.count()}

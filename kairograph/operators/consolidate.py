"""All episodes of an entity to a summary and standing facts, for every pending entity at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.clients import ask
from kairograph.functions.temporal import utc
from kairograph.operators.lookup import Graph, episodes_of, first_per, pending
from kairograph.operators.parts import MOST, texts_in_parts
from kairograph.operators.resolve import resolve
from kairograph.operators.settle import settle
from kairograph.schema import CONSOLIDATION, STANDING_RELATIONS


def material(graph: Graph, most: int = MOST) -> DataFrame:
    """(id, name, seq, part, episodes) of pending entities that have episodes; the others stay pending. A row holds `most` characters at most."""
    todo = pending(graph.entities).select("id", "name", "seq")
    mentioned = episodes_of(graph).join(todo.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return todo.join(texts_in_parts(mentioned, most).withColumnRenamed("entity_id", "id"), "id")


def summaries(results: DataFrame, client, most: int = MOST, answers=None) -> DataFrame:
    """(id, summary) of results (id, name, seq, part, summary): the summaries of several parts are summarised again, as often as that makes them fewer."""
    done, level, n = None, results.select("id", "name", "seq", "part", "summary"), None
    while True:
        parts = settle(level.withColumn("__parts", F.count("*").over(Window.partitionBy("id"))))
        whole = parts.where("__parts = 1").select("id", "summary")
        done = whole if done is None else done.union(whole)
        rest = parts.where("__parts > 1")
        left = rest.count()
        if not left:
            return done
        if n is not None and left >= n:  # summaries as long as what they sum up
            told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "summary"))), lambda x: x["summary"]), "\n")
            return done.union(rest.groupBy("id").agg(told.alias("summary")))
        n = left
        again = texts_in_parts(rest.select(F.col("id").alias("entity_id"), F.col("part").alias("reference_time"), "seq", F.col("summary").alias("text")), most)
        named = rest.select("id", "name", "seq").distinct().join(again.withColumnRenamed("entity_id", "id"), "id")
        level = settle(ask(named, client, "consolidate", CONSOLIDATION, relations=STANDING_RELATIONS, answers=answers))


def standing_edges(results: DataFrame) -> DataFrame:
    """(source, relation, target_name, fact, seq, pos) of results (id, seq, part, semantic_edges)."""
    return results.select(F.col("id").alias("source"), "seq", "part", F.posexplode("semantic_edges").alias("at", "e")).select(
        "source", "e.relation", F.col("e.target").alias("target_name"), "e.fact", "seq", F.struct("part", "at").alias("pos")
    )


def split_edges(found: DataFrame, graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(edges to add, unresolved): targets by normalised name; the first of each key that isn't open."""
    named = resolve(found, graph, "target_name").withColumnRenamed("entity_id", "target")
    key = ["source", "target", "relation"]
    fresh = named.where("target is not null").join(graph.open_edges().select(*key).distinct(), key, "left_anti")
    return first_per(fresh, key, "seq", "pos"), named.where("target is null").select("source", "relation", "target_name", "fact")


def consolidate_all(store, client, now=None, run_id: str | None = None, unresolved_path: str | None = None, most: int = MOST) -> dict:
    """Consolidate every pending entity; counters count successes only. No prompt holds over `most` characters of episodes.

    Answers are kept beside the store, so a run that failed asks only what it had not been told.

    Unresolved targets are tried once more against the graph as written, and the rest is appended to unresolved_path
    as Parquet. episodic_only comes back as a DataFrame (id, episodic_only), a row for each part of an entity's episodes.
    """
    now = now or dt.datetime.now(dt.UTC)
    run_id = run_id or now.isoformat()
    graph = store.graph()
    answers = store.answers()
    results = settle(ask(material(graph, most), client, "consolidate", CONSOLIDATION, relations=STANDING_RELATIONS, answers=answers))
    told = settle(summaries(results, client, most, answers))
    add, unresolved = (settle(x) for x in split_edges(standing_edges(results), graph))
    store.patch_many("entities", told.select("id", "summary", F.lit(True).alias("consolidated"), F.lit(run_id).alias("consolidation_run_id")))

    def write(rows: DataFrame) -> int:
        from kairograph.operators.store import edge_id

        edges = settle(rows.withColumn("valid_from", utc(now)))
        store.append("edges", edges.select(edge_id(F.lit(run_id)).alias("id"), "source", "target", "relation", "fact", "valid_from", F.lit(1.0).alias("confidence"), utc(now).alias("ingested_at")))
        return edges.count()

    added = write(add)
    second, rest = split_edges(unresolved.select("*", F.lit(0).alias("seq"), F.lit(0).alias("pos")), store.graph())
    second, rest = settle(second), settle(rest)
    late = write(second) if not second.isEmpty() else 0
    left = rest.count()
    if left and unresolved_path:
        rest.write.mode("append").parquet(unresolved_path)
    return {"consolidated": told.count(), "edges_added": added, "resolved_second": late, "unresolved": left, "episodic_only": results.select("id", "episodic_only")}

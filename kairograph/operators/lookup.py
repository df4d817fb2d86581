"""Scans, point lookups and as-of reads over a graph's three tables."""

from __future__ import annotations


from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.temporal import is_open, utc, valid_at
from kairograph.schema import MENTION


@dataclass
class Graph:
    """entities, edges, episodes: latest versions, with the columns of kairograph.schema.

    by_target: the edges again, from files sorted by target, if there are such files.
    """

    entities: DataFrame
    edges: DataFrame
    episodes: DataFrame
    by_target: DataFrame | None = None

    def edges_from(self, near: str) -> DataFrame:
        """The edges, as they are best read by that end."""
        return self.by_target if near == "target" and self.by_target is not None else self.edges

    def ids(self) -> DataFrame:
        """Ids of either kind of node."""
        return self.entities.select("id").union(self.episodes.select("id"))

    def open_edges(self) -> DataFrame:
        return self.edges.where(is_open())


class UnknownNode(ValueError):
    pass


def entity(graph: Graph, id: str) -> DataFrame:
    return graph.entities.where(F.col("id") == id)


def episode(graph: Graph, id: str) -> DataFrame:
    return graph.episodes.where(F.col("id") == id)


def exists(graph: Graph, id: str) -> bool:
    """Whether an entity or an episode has the id."""
    return not graph.ids().where(F.col("id") == id).limit(1).isEmpty()


def episode_by_source(graph: Graph, source_id: str) -> DataFrame:
    """The first episode of an external id, or no row."""
    return graph.episodes.where(F.col("source_id") == source_id).orderBy("seq", "id").limit(1)


def edge_filter(near: str, id: str | None = None, relation: str | None = None, active_only: bool = True) -> Column:
    """Conjunction of what is given; an empty relation is no filter."""
    parts = [F.lit(True)]
    if id is not None:
        parts.append(F.col(near) == id)
    if relation:
        parts.append(F.col("relation") == relation)
    if active_only:
        parts.append(is_open())
    return reduce(Column.__and__, parts)


def ends(direction: str) -> tuple[str, str]:
    """Columns of the near and the far end; anything but 'out' means 'in'."""
    return ("source", "target") if direction == "out" else ("target", "source")


def edges_of(graph: Graph, id: str, direction: str = "out", relation: str | None = None, active_only: bool = True) -> DataFrame:
    near = ends(direction)[0]
    return graph.edges_from(near).where(edge_filter(near, id, relation, active_only))


def _known(graph: Graph, id: str) -> None:
    if not exists(graph, id):
        raise UnknownNode(f"no node has the id {id}")


def current_facts(graph: Graph, id: str) -> DataFrame:
    _known(graph, id)
    return edges_of(graph, id)


def facts_at(graph: Graph, id: str, moment) -> DataFrame:
    _known(graph, id)
    return graph.edges.where((F.col("source") == id) & valid_at(utc(moment)))


def facts_at_many(graph: Graph, asked: DataFrame) -> DataFrame:
    """asked (source, moment): each with the edges valid then; an equi-join on source, intervals compared in it."""
    a, e = asked.alias("a"), graph.edges.alias("e")
    within = F.expr("e.source = a.source and e.valid_from <= a.moment and (e.valid_until is null or e.valid_until > a.moment)")
    return a.join(e, within).select("a.moment", "e.*")


def episodes_of(graph: Graph, id: str | None = None) -> DataFrame:
    """(entity_id, episode columns) over mentions, open or closed, as often as they are mentioned; all entities if id is None."""
    mentions = graph.edges.where(edge_filter("source", id, MENTION, active_only=False)).select(F.col("source").alias("entity_id"), F.col("target").alias("__target"))
    return mentions.join(graph.episodes, F.col("__target") == F.col("id")).drop("__target")


def numbered_texts(mentioned: DataFrame) -> DataFrame:
    """(entity_id, episodes): texts of episodes_of() as numbered lines, oldest first."""
    from kairograph.functions.text import numbered_lines

    ordered = F.array_sort(F.collect_list(F.struct("reference_time", "seq", F.coalesce("text", F.lit("")).alias("text"))))
    return mentioned.groupBy("entity_id").agg(numbered_lines(F.transform(ordered, lambda x: x["text"])).alias("episodes"))


def pending(entities: DataFrame) -> DataFrame:
    """Entities whose flag is false or null."""
    return entities.where(~F.coalesce("consolidated", F.lit(False)))


def first_per(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def display(edges: DataFrame, graph: Graph) -> DataFrame:
    """Edges but mentions, with their ends' names, or ids where there is no entity."""
    names = graph.entities.select("id", "name")
    out = edges.where(F.col("relation") != MENTION)
    for end in ("source", "target"):
        out = out.join(names.select(F.col("id").alias(f"__{end}"), F.col("name").alias(f"__{end}_name")), F.col(end) == F.col(f"__{end}"), "left")
        out = out.withColumn(f"{end}_name", F.coalesce(f"__{end}_name", end)).drop(f"__{end}", f"__{end}_name")
    return out



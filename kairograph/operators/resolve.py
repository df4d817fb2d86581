"""Names to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions.text import contains_ignoring_case, normalize
from kairograph.operators.lookup import Graph, first_per


def canonical(entities: DataFrame) -> DataFrame:
    """(norm_name, entity_id): the first entity of each normalised name, by seq and id."""
    first = entities.groupBy(normalize(F.col("name")).alias("norm_name")).agg(F.min(F.struct("seq", "id")).alias("m"))
    return first.select("norm_name", F.col("m.id").alias("entity_id"))


def resolve(named: DataFrame, graph: Graph, name: str = "name") -> DataFrame:
    """named with entity_id, null where no entity has the name."""
    return named.withColumn("norm_name", normalize(F.col(name))).join(canonical(graph.entities), "norm_name", "left").drop("norm_name")


def list_entities(graph: Graph, query: str | None = None) -> DataFrame:
    """Entities with the query in their name or id, by lower-cased name."""
    rows = graph.entities.where(contains_ignoring_case(query, F.col("name"), F.col("id")))
    return rows.select("id", "name", "type", "summary", "seq").orderBy(F.lower("name"), "seq").drop("seq")


def similar(graph: Graph, anchor: str) -> DataFrame:
    """Entities whose normalised name, or raw id, contains the normalised anchor; an anchor without words matches all."""
    wanted = normalize(F.lit(anchor))
    rows = graph.entities.where(F.contains(normalize(F.col("name")), wanted) | F.contains(F.col("id"), wanted))
    return rows.select("id", "name", "type", "seq").orderBy("seq", "id").drop("seq")

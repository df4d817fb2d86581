"""What happens to found edges: filtered, scored, ranked, projected, joined to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions.temporal import iso, score, utc
from kairograph.operators.settle import settle
from kairograph.schema import MENTION


def scored(edges: DataFrame, now) -> DataFrame:
    return edges.withColumn("score", score(utc(now)))


def live(found: DataFrame) -> DataFrame:
    """Neither expired nor provenance; found has score."""
    return found.where(F.coalesce(F.col("score") != 0.0, F.lit(True)) & (F.col("relation") != MENTION))


def placed(found: DataFrame, name: str, *order) -> DataFrame:
    """With the place of each row, from 1, in the order: a range-partitioned sort, and one row a partition of how many
    rows come before it, so that no task gets all rows."""
    at = F.monotonically_increasing_id()
    rows = settle(found.orderBy(*order).withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND((1 << 33) - 1)))
    sizes = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row a partition
    before, ahead = [], 0
    for part, n in sizes:
        before.append((part, ahead))
        ahead += n
    offsets = found.sparkSession.createDataFrame(before, "__part long, __before long")
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def ranked(found: DataFrame) -> DataFrame:
    """With rank, from 1, by falling score, ties by seq."""
    return placed(found, "rank", F.desc("score"), "seq")


def api_rows(found: DataFrame) -> DataFrame:
    """The response's nine fields; a confidence that is null or 0 shows as 1."""
    confidence = F.when(F.col("confidence").isNull() | (F.col("confidence") == 0), 1.0).otherwise(F.col("confidence"))
    return found.select(
        "id", "source", "target", "relation", "fact", F.bround("score", 4).alias("score"),
        iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_until")).alias("valid_until"), confidence.alias("confidence"),
    )


def facts_text(rows: list) -> str:
    """One line a fact, in the order given."""
    return "\n".join(f"- {r['fact']} ({r['source']} {r['relation']} {r['target']})" for r in rows)

"""Connected components by contraction within chunks, then by alternating star contraction in joins and aggregates.

First each task joins the edges it has, up to CHUNK at a time, and keeps a star for each part; few edges are so done
without a round. Each round is two equi-joins with a minimum per node. Nothing is collected but one row of figures, which
tells whether all parts are stars, and the largest degree. While that is over HUB, hubs' edges are dealt over parts of at most HUB rows (more
only beyond HUB * HOT_KEYS edges), each of which gets the hub's minimum, so no task reads a hub whole; without hubs the
joins are plain. Each round's edges are a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import durable, forget, give_back, hot_keys, salted_join

HUB = 256
CHUNK = 1 << 18  # edges that a task joins at once


def local_components(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of the nodes 0, 1, ... over the edges (a, b)."""
    label = np.arange(nodes)
    while len(a):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for ends in (before[a], before[b], a, b):  # a node's label moves with it, so that long chains take few turns
            np.minimum.at(label, ends, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that join what edges does: of each chunk, each node with its least one. Repeats are possible."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        chunk = pa.Table.from_batches(held)
        names, at = np.unique(np.concatenate([chunk.column("u").to_numpy(), chunk.column("v").to_numpy()]), return_inverse=True)
        label = local_components(len(names), at[: chunk.num_rows], at[chunk.num_rows :])
        moved = label != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)
        held.clear()
        give_back()

    return edges.mapInArrow(run, "u long, v long")


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the least v of their u; total: of edges if some u may be a hub, else 0."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if not total:
        return edges.join(least.hint("merge"), "u")
    return salted_join(edges, least, ["u"], hot_keys(edges, ["u"], total, HUB), ["v"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _with_least(both, 2 * total).where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    joined = _with_least(down, total)
    # the edge to the least itself stays, the others move from u to it
    return joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _figures(edges: DataFrame) -> tuple[int, int, bool]:
    """Of edges (u, v), u > v: their number, the largest degree, and whether all are stars around their least nodes."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("u").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    row = ends.agg(F.sum("down"), F.max(F.col("down") + F.col("up")), F.max("down"), F.max(F.least("down", "up"))).first()
    return row[0] or 0, row[1] or 0, (row[2] or 0) <= 1 and not row[3]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Of edges (u, v), bigint nodes, either direction, repeats and loops allowed: one row (node, component).

    component is the smallest node reachable, and is itself listed. Null ends are ignored; no edges give no rows.
    Raises if `rounds` do not suffice, rather than return half-joined groups.
    """
    down = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = durable(_contracted(down.distinct()), "edges")
    number, largest, settled = _figures(now)
    for _ in range(rounds):
        if settled:
            break
        total = number if largest > HUB else 0  # an edge's ends have as many edges at most after a large star
        star = _large_star(now, total)
        if total:
            star = durable(star, "edges")
        following = durable(_small_star(star, total), "edges")
        forget(now)
        forget(star)
        now = following
        number, largest, settled = _figures(now)
    if not settled:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

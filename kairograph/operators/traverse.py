"""The five traversal patterns as joins.

Bounded expansions are unrolled; unbounded ones loop over frontiers, one join a level, each level settled in the shared
folder. Reached nodes stay distributed; the driver sees a level's emptiness only. Joins carry (near, far) pairs alone,
and edges are fetched at the end by a semi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.temporal import is_open
from kairograph.operators.lookup import Graph, edge_filter, edges_of, ends
from kairograph.operators.settle import settle
from kairograph.schema import MENTION


def direct_lookup(graph: Graph, id: str, relation: str, direction: str = "out") -> DataFrame:
    return edges_of(graph, id, direction, relation)


def history(graph: Graph, id: str, relation: str, direction: str = "out") -> DataFrame:
    """Open and closed edges of one relation, by valid_from."""
    return edges_of(graph, id, direction, relation, active_only=False).orderBy("valid_from", "seq")


def _single(graph: Graph, id: str) -> DataFrame:
    return graph.edges.sparkSession.range(1).select(F.lit(id).alias("n"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """(n, m) for each edge in either direction."""
    return edges.select(F.col("source").alias("n"), F.col("target").alias("m")).union(edges.select(F.col("target").alias("n"), F.col("source").alias("m")))


def _touching(edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Edges, each once, with one of the columns among nodes (n)."""
    marked = edges
    hit = F.lit(False)
    for c in columns:
        marked = marked.join(nodes.select(F.col("n").alias(f"__{c}")), F.col(c) == F.col(f"__{c}"), "left")
        hit = hit | F.col(f"__{c}").isNotNull()
    return marked.where(hit).select(*edges.columns)


def neighbourhood(graph: Graph, id: str, depth: int = 2) -> DataFrame:
    """Open edges with an end within depth - 1 steps, in either direction and over all relations; none at depth 0."""
    edges = graph.open_edges()
    if depth <= 0:
        return edges.limit(0)
    near = _single(graph, id)
    pairs = _both_ways(edges)
    for _ in range(depth - 1):
        near = near.union(pairs.join(near, "n").select(F.col("m").alias("n"))).distinct()
    return _touching(edges, near, ("source", "target"))


def reach(pairs: DataFrame, start: DataFrame, stop: str | None = None, limit: int = 100_000, settled: bool = False) -> DataFrame:
    """(n, dist) of all that pairs (n, m) reach from start (n), itself at 0; stops at the level that meets `stop`.

    `settled`: pairs are distinct and in the shared folder already.
    """
    if not settled:
        pairs = settle(pairs.distinct())
    seen = settle(start.select("n", F.lit(0).alias("dist")))
    level = seen
    for dist in range(1, limit + 1):
        if stop is not None and not level.where(F.col("n") == stop).isEmpty():
            return seen
        ahead = pairs.join(level.select("n"), "n").select(F.col("m").alias("n")).distinct()
        level = settle(ahead.join(seen.select("n"), "n", "left_anti").select("n", F.lit(dist).alias("dist")))
        if level.isEmpty():
            return seen
        seen = settle(seen.union(level)) if dist % 8 == 0 else seen.union(level)
    raise RuntimeError(f"more than {limit} levels")


def impact(graph: Graph, id: str, relation: str, direction: str = "in") -> DataFrame:
    """Open edges of one relation whose near end is reached from id along it; cycles end by themselves."""
    near, far = ends(direction)
    edges = graph.edges.where(edge_filter(near, None, relation))
    pairs = edges.select(F.col(near).alias("n"), F.col(far).alias("m"))
    return edges.join(reach(pairs, _single(graph, id)).select(F.col("n").alias(near)), near, "left_semi").select(*graph.edges.columns)


#: A level of so many nodes at most is named in the filter, which reaches the files; a larger one is joined.
NAMED = 1000


def _neighbours(graph: Graph, where: Column, level: DataFrame, size: int) -> DataFrame:
    """Distinct (n, m): the steps from a level's `size` nodes (n) along edges in either direction."""
    ids = [r["n"] for r in level.collect()] if size <= NAMED else None
    found = None
    for near, far in (ends("out"), ends("in")):
        steps = graph.edges_from(near).where(where).select(F.col(near).alias("n"), F.col(far).alias("m"))
        steps = steps.join(level, "n") if ids is None else steps.where(F.col("n").isin(ids))
        found = steps if found is None else found.union(steps)
    return found.where("n <> m").distinct()


@dataclass
class _Side:
    """A search from one end: the steps taken so far and the nodes of the last level, with their number."""

    level: DataFrame
    seen: DataFrame  # n, dist
    size: int
    steps: list[DataFrame]  # of each level: n, m with n nearer to this end

    @classmethod
    def at(cls, graph: Graph, id: str) -> _Side:
        start = _single(graph, id)
        return cls(start, start.select("n", F.lit(0).alias("dist")), 1, [])

    def grow(self, graph: Graph, where: Column) -> None:
        steps = settle(_neighbours(graph, where, self.level, self.size))
        self.steps.append(steps)
        self.level = settle(steps.select(F.col("m").alias("n")).distinct().join(self.seen.select("n"), "n", "left_anti"))
        self.size = self.level.count()
        self.seen = self.seen.union(self.level.select("n", F.lit(len(self.steps)).alias("dist")))


def path_nodes(graph: Graph, source: str, target: str, mode: str = "compat", touched: list[int] | None = None) -> list[str]:
    """The lexicographically least shortest path, as ids; [] if there is none or the ends are the same.

    compat: over all edges, closed ones and mentions too. semantic: over open edges but mentions. Both ends are searched,
    a level at a time from the one whose last level has fewer nodes, until the levels meet; only edges of searched nodes
    are read into the search. The least path is then walked from the source, at each step among the nodes that some
    shortest path leads through. `touched` gets the number of steps that the search looked at.
    """
    if source == target:
        return []
    where = F.lit(True) if mode == "compat" else is_open() & (F.col("relation") != MENTION)
    left, right = _Side.at(graph, source), _Side.at(graph, target)
    while True:
        side, other = (left, right) if left.size <= right.size else (right, left)
        side.grow(graph, where)
        if touched is not None:
            touched.append(side.steps[-1].count())
        if not side.size:
            return []
        if not side.level.join(other.seen, "n", "left_semi").limit(1).isEmpty():
            break
    length = len(left.steps) + len(right.steps)
    # nodes where the two searches meet, and backwards from them the nodes of the left side's shortest paths
    on_path = left.seen.where(F.col("dist") == len(left.steps)).join(right.seen.where(F.col("dist") == len(right.steps)), "n", "left_semi").select("n")
    allowed = [on_path]
    for steps in reversed(left.steps):
        on_path = settle(steps.join(on_path.withColumnRenamed("n", "m"), "m", "left_semi").select("n").distinct())
        allowed.append(on_path)
    allowed.reverse()  # by distance from the source, up to where the searches meet
    path = [source]
    for at in range(1, length + 1):  # as many steps as the path is long
        if at <= len(left.steps):
            following = left.steps[at - 1].where(F.col("n") == path[-1]).join(allowed[at].withColumnRenamed("n", "m"), "m", "left_semi")
        else:  # the right side's steps lead away from the target
            following = right.steps[length - at].where(F.col("m") == path[-1]).select(F.col("n").alias("m"))
        path.append(following.agg(F.min("m")).first()[0])
    return path


def shortest_path(graph: Graph, source: str, target: str, mode: str = "compat") -> DataFrame:
    """Open edges between consecutive nodes of the path, in either direction, each once."""
    nodes = path_nodes(graph, source, target, mode)
    edges = graph.open_edges()
    if mode != "compat":
        edges = edges.where(F.col("relation") != MENTION)
    steps = list(zip(nodes, nodes[1:], strict=False))
    if not steps:
        return edges.limit(0)
    wanted = graph.edges.sparkSession.createDataFrame([*steps, *[(b, a) for a, b in steps]], "source string, target string").distinct()
    return edges.join(F.broadcast(wanted), ["source", "target"], "left_semi").select(*graph.edges.columns)  # two rows a step

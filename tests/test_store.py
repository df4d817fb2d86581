"""Compaction, the copy by target, and reads as of a moment of writing."""

import datetime as dt
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kairograph.operators import store
from kairograph.operators.lookup import Graph
from kairograph.operators import lookup
from kairograph.operators.store import Store


def files(path):
    return [p for p in path.rglob("*.parquet") if p.is_file()]


def state(store, as_of=None):
    g = store.graph(as_of)
    return sorted((r.id, r.name, r.type) for r in g.entities.collect()), sorted((r.source, r.relation, r.target, str(r.valid_until), r.seq) for r in g.edges.collect())


def filled(spark, path):
    store = Store(spark, str(path))
    for id in ("alice", "infra", "platform", "db"):
        store.add_node(id, "concept", id)
    first = store.add_edge("alice", "infra", "MEMBER_OF", "f", "2025-01-01")
    store.add_edge("infra", "db", "USES", "g", "2025-01-01")
    store.close_edge(first, "2025-02-01")
    store.patch("entities", "db", name="Database")
    return store


def test_many_writes_compact_to_few_files_and_stay_the_same(spark, tmp_path):
    store = filled(spark, tmp_path / "kg")
    before = state(store)
    for name in ("entities", "edges", "episodes"):
        store.compact(name)
    assert state(store) == before and len(files(tmp_path / "kg/compact/entities")) == 1 and len(files(tmp_path / "kg/compact/edges")) == 4  # two copies, two relations
    store.add_edge("platform", "db", "USES", "h", "2025-03-01")  # numbered after what is compacted
    assert [r.source for r in lookup.edges_of(store.graph(), "db", "in").orderBy("seq").collect()] == ["infra", "platform"]
    with pytest.raises(ValueError):
        store.add_edge("platform", "db", "USES", "again", "2025-03-01")
    with_more, replaced = state(store), len(files(tmp_path / "kg/edges"))
    store.compact("edges")
    left = len(files(tmp_path / "kg/edges"))
    assert state(store) == with_more and left == 1 < replaced  # the newest write, which goes with the next compaction
    store.compact("edges")
    assert state(store) == with_more and not files(tmp_path / "kg/edges") and len(list((tmp_path / "kg/compact/edges").iterdir())) == 2


def test_a_crash_or_a_write_during_compaction_loses_nothing(spark, tmp_path):
    store = filled(spark, tmp_path / "kg")
    before, commit = state(store), store._commit

    def gone(*_):
        raise OSError("gone")

    store._commit = gone
    with pytest.raises(OSError):
        store.compact("edges")
    assert state(store) == before and not store._manifest("edges")[1]

    def late(*said):
        store.add_edge("platform", "db", "USES", "h", "2025-03-01")
        commit(*said)

    store._commit = late
    store.compact("edges")
    assert [x[:4] for x in state(store)[1] if x not in before[1]] == [("platform", "USES", "db", "None")]
    with pytest.raises(RuntimeError):  # two compactions of one state
        commit("edges", 1, {"folder": "x", "replaced": []})


def test_lookups_by_target_prune(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "32768")
    try:
        store = Store(spark, str(tmp_path / "kg"))
        rows = spark.range(40_000).select(F.concat(F.lit("s"), F.col("id") % 97).alias("source"), F.concat(F.lit("t"), F.col("id") % 2000).alias("target"), F.lit("USES").alias("relation"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
        store.append("edges", rows)
        for compacted in (False, True):
            if compacted:
                store.compact("edges")
            found = lookup.edges_of(store.graph(), "t77", "in", "USES")
            assert found.count() == 20
            ran = found.select("id")
            ran.collect()
            plan = ran._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(target,t77\)", plan)
            read = scanned(ran)
            assert (read < 4000) == compacted, read
    finally:
        conf.unset("parquet.block.size")


def scanned(df):
    """Rows that the file scans of an executed plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    at, total = [plan], 0
    while at:
        node = at.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            at.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            at.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        at += [children.apply(i) for i in range(children.size())]
    return total


def test_as_of_a_moment_of_writing(spark, tmp_path):
    """A correction made later is invisible to an earlier read, before and after compaction."""
    now = [dt.datetime(2025, 1, 1, tzinfo=dt.UTC)]
    store = Store(spark, str(tmp_path / "kg"), clock=lambda: now[0])
    for id in ("alice", "infra"):
        store.add_node(id, "concept", id)
    edge = store.add_edge("alice", "infra", "MEMBER_OF", "f", "2024-01-01")
    first = state(store)
    now[0] = dt.datetime(2025, 6, 1, tzinfo=dt.UTC)
    store.close_edge(edge, "2024-02-01")  # learnt in June: it had ended in February of the year before
    store.patch("entities", "infra", name="Infrastructure")
    for _ in range(2):
        early = store.graph(dt.datetime(2025, 3, 1, tzinfo=dt.UTC))
        assert state(store, dt.datetime(2025, 3, 1, tzinfo=dt.UTC)) == first != state(store)
        assert lookup.facts_at(early, "alice", "2024-03-01").count() == 1 and lookup.facts_at(store.graph(), "alice", "2024-03-01").isEmpty()
        assert state(store, dt.datetime(2024, 1, 1, tzinfo=dt.UTC)) == ([], []) and state(store, now[0]) == state(store)
        for name in ("entities", "edges"):
            store.compact(name)


def test_latest_gathers_only_what_is_read(spark):
    """Facts are in no shuffle where they aren't read; a later version's null counts."""
    rows = [("e", "a", "b", "R", "old", None, 1), ("e", "a", "b", "R", None, None, 5), ("f", "a", "c", "R", "kept", None, 3)]
    log = spark.createDataFrame(rows, "id string, source string, target string, relation string, fact string, valid_until timestamp, seq long")
    found = store.latest(log)
    assert found.columns == log.columns
    assert sorted((r.id, r.fact, r.seq) for r in found.collect()) == [("e", None, 1), ("f", "kept", 3)]
    plan = found.select("id", "valid_until")._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "max_by(fact" not in plan and "struct" not in plan


def test_edges_are_checked_against_their_own_relations(spark):
    edges = spark.createDataFrame([("1", "a", "b", "R", None, 1), ("2", "a", "b", "S", None, 2)], "id string, source string, target string, relation string, valid_until timestamp, seq long")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    new = spark.createDataFrame([("a", "b", "R", 3), ("b", "a", "R", 4), ("b", "a", "R", 5)], "source string, target string, relation string, seq long")
    for relations in (None, ("R",)):
        accepted, rejected = store.accept_edges(new, Graph(ids, edges, ids.limit(0)), relations)
        assert [r.seq for r in accepted.collect()] == [4] and sorted(r.seq for r in rejected.collect()) == [3, 5]


def test_closes_gather_their_edges_only_in_small_files(spark, tmp_path, monkeypatch):
    """The whole log is not gathered for a batch of closes, and files are written in zstd."""
    kg = filled(spark, tmp_path / "kg")
    monkeypatch.setattr(Store, "graph", None)  # the latest versions of all edges
    id = next(r.id for r in kg.log("edges").collect() if r.source == "infra")
    kg.close_edges(spark.createDataFrame([(id, dt.datetime(2025, 3, 1)), ("unknown", dt.datetime(2025, 3, 1))], "id string, valid_until timestamp"))
    monkeypatch.undo()
    assert [str(r.valid_until) for r in kg.graph().edges.where("source = 'infra'").collect()] == ["2025-03-01 00:00:00"]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files(tmp_path) if pq.ParquetFile(f).metadata.num_rows} == {"ZSTD"}

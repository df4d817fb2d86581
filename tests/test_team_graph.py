import datetime as dt

import pytest
from pyspark.sql import functions as F

from kairograph.operators import lookup, rank, resolve, traverse
from kairograph.operators.store import Store
from tests.team import LINKS, NODES, make, numbers, team


@pytest.fixture(scope="module")
def g(spark):
    return team(spark)


def test_patterns(g):
    assert numbers(traverse.direct_lookup(g, "auth_service", "OWNS", "in")) == {4}
    assert numbers(traverse.neighbourhood(g, "infra_team", 2)) == {1, 3, 4, 7, 9, 10, 11}
    assert numbers(traverse.neighbourhood(g, "infra_team", 0)) == set()
    assert numbers(traverse.impact(g, "postgres", "DEPENDS_ON", "in")) == {7, 8, 9}
    assert numbers(traverse.history(g, "alice", "MEMBER_OF"), ordered=True) == [1, 3]


def test_shortest_path_takes_the_least_of_ties(g):
    assert traverse.path_nodes(g, "alice", "postgres") == ["alice", "incident_001", "auth_service", "postgres"]
    assert numbers(traverse.shortest_path(g, "alice", "postgres")) == {10, 11, 7}
    assert numbers(traverse.shortest_path(g, "alice", "alice")) == set()
    assert numbers(traverse.shortest_path(g, "alice", "nobody")) == set()


def test_path_modes_differ_over_closed_edges(spark):
    g = make(spark, [("a", "R", "b", "2025-01-01", "2025-02-01"), ("a", "R", "c", "2025-01-01"), ("c", "R", "b", "2025-01-01")])
    assert numbers(traverse.shortest_path(g, "a", "b")) == set()  # over the closed edge, which is then not shown
    assert numbers(traverse.shortest_path(g, "a", "b", "semantic")) == {2, 3}


def test_facts(g):
    assert numbers(lookup.facts_at(g, "alice", "2025-03-01")) == {1, 3, 10}
    assert numbers(lookup.current_facts(g, "alice")) == {1, 3, 10}
    assert numbers(lookup.edges_of(g, "alice", relation="")) == {1, 3, 10}
    with pytest.raises(lookup.UnknownNode):
        lookup.current_facts(g, "nobody")


def test_valid_until_is_exclusive_and_scores_live_at_now(spark):
    g = make(spark, [("a", "R", "b", "2025-01-01", "2025-02-01")])
    assert numbers(lookup.facts_at(g, "a", "2025-01-31T23:59:59")) == {1}
    assert numbers(lookup.facts_at(g, "a", "2025-02-01")) == set()
    assert rank.scored(g.edges, "2025-02-01").first().score > 0
    assert rank.scored(g.edges, "2025-02-01T00:00:01").first().score == 0


def test_entity_search(g):
    assert [r.id for r in resolve.list_entities(g, "SERVICE").collect()] == ["auth_service", "payment_service"]
    assert len(resolve.list_entities(g, "").collect()) == len(NODES)
    assert [r.id for r in resolve.similar(g, "Alice!").collect()] == ["alice"]
    assert len(resolve.similar(g, "?!").collect()) == len(NODES)
    assert resolve.list_entities(g, "%").isEmpty()  # literal, no pattern


def test_api_rows_show_no_confidence_as_one(g):
    edges = g.edges.where("id in ('e1', 'e2')").withColumn("confidence", F.when(F.col("id") == "e1", 0.0).otherwise(0.5))
    rows = {r.id: r for r in rank.api_rows(rank.scored(edges, "2026-01-10")).collect()}
    assert rows["e1"].confidence == 1.0 and rows["e2"].confidence == 0.5
    assert rows["e1"].score == 0.5 and rows["e1"].valid_from == "2025-01-10T00:00:00" and rows["e1"].valid_until is None


def test_store_close_and_reopen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kg"))
    store.append("entities", spark.createDataFrame([(i, t, n, False) for i, t, n in NODES], "id string, type string, name string, consolidated boolean"))
    seed = [(f"e{i}", s, t, r, f"{s} {r} {t}", dt.datetime.fromisoformat(vf)) for i, (s, r, t, vf) in enumerate(LINKS, 1)]
    store.append("edges", spark.createDataFrame(seed, "id string, source string, target string, relation string, fact string, valid_from timestamp"))
    with pytest.raises(ValueError):
        store.add_edge("alice", "infra_team", "MEMBER_OF", "back", "2025-06-01")
    store.close_edge("e1", "2025-05-01")
    new = store.add_edge("alice", "infra_team", "MEMBER_OF", "back", "2025-06-01")
    g = store.graph()
    assert {r.id for r in lookup.current_facts(g, "alice").collect()} == {"e3", "e10", new}
    assert {r.id for r in lookup.facts_at(g, "alice", "2025-03-01").collect()} == {"e1", "e3", "e10"}
    assert [r.id for r in traverse.history(g, "alice", "MEMBER_OF").collect()] == ["e1", "e3", new]
    assert g.edges.count() == len(LINKS) + 1 and store.log("edges").count() == len(LINKS) + 2  # the log keeps both versions
    assert store.add_edge("alice", "nobody", "USES", "", "2025-06-01") is None
    with pytest.raises(ValueError):
        store.close_edge("nothing", "2025-05-01")
    with pytest.raises(ValueError):
        store.add_node("alice", "person", "Again")


def test_store_patches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kg"))
    store.add_node("alice", "person", "Alice")
    store.add_episode("ep1", "text", "2025-01-01", metadata={})
    store.patch("entities", "alice", summary="s", consolidated=True)
    store.patch("episodes", "ep1", source_id="x", metadata={"a": 1})
    store.patch("entities", "nobody", summary="s")
    with pytest.raises(ValueError):
        store.patch("entities", "alice", **{"id = 'x' --": 1})
    g = store.graph()
    assert [(r.summary, r.consolidated) for r in g.entities.collect()] == [("s", True)]
    assert g.episodes.first().metadata == '{"a": 1}' and lookup.episode_by_source(g, "x").first().id == "ep1"
    assert lookup.exists(g, "ep1") and lookup.exists(g, "alice") and not lookup.exists(g, "x")
    with pytest.raises(ValueError):
        store.add_node("ep1", "person", "shares the ids of episodes")

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from kairograph.clients import RulesClient
from kairograph.operators import ingest, lookup
from kairograph.operators.consolidate import consolidate_all
from kairograph.operators.store import Store
from kairograph.schema import EXTRACTION
from kairograph.streaming.ingest import ingest_batch, stream
from tests.team import make

NAMES = {"Alice": "person", "infra team": "team", "platform team": "team", "payments service": "service", "Postgres": "tool"}
EPISODES = [
    ("s1", "Alice joins the infra team.", "2025-01-01"),
    ("s2", "Alice had coffee with a friend.", "2025-01-02"),
    ("s3", "Alice joined the platform team and leads a migration.", "2025-02-01"),
    ("s4", "The platform team owns the payments service. The payments service depends on Postgres.", "2025-02-02"),
    ("s5", "Alice reported a fault in the payments service.", "2025-02-03"),
]


def incoming(spark, rows):
    df = spark.createDataFrame(rows, "source_id string, text string, reference_time string")
    return df.select("source_id", F.lit("note").alias("source_type"), "text", F.col("reference_time").cast("timestamp").alias("reference_time"), F.lit(None).cast("string").alias("metadata"))


def sequential(nodes, edges, known, open_edges, episode_ids):
    """One episode after another over plain lists: new nodes, new edges, mentions."""
    norm = lambda x: re.sub(r"[^\w\s]", "", x.lower()).strip()
    nodes_by, new_nodes, new_edges, mentions = list(known), [], [], set()
    taken, open_ = {n[0] for n in known} | set(episode_ids), set(open_edges)
    for seq in sorted({n[1] for n in nodes} | {e[1] for e in edges}):
        ids = {}
        for ep, s, _, name, kind in sorted((n for n in nodes if n[1] == seq), key=lambda n: n[2]):
            found = next((i for i, n in nodes_by if norm(n) == norm(name)), None)
            if found is None:
                found = norm(name).replace(" ", "_")
                if found not in taken:
                    taken.add(found)
                    nodes_by.append((found, name))
                    new_nodes.append((found, kind, name))
            ids[name] = found
            mentions.add((found, ep))
        for _, s, _, a, b, r in sorted((e for e in edges if e[1] == seq), key=lambda e: e[2]):
            if a in ids and b in ids and (ids[a], ids[b], r) not in open_:
                open_.add((ids[a], ids[b], r))
                new_edges.append((ids[a], ids[b], r))
    return set(new_nodes), set(new_edges), mentions


@pytest.mark.parametrize("seed", range(3))
def test_set_form_equals_one_after_another(spark, seed):
    rng = random.Random(seed)
    words = ["a b", "A B", "a_b", "a-b", "!", "ab", "c", "C.", "d e"]
    g = make(spark, [("a_b", "R", "x1", "2025-01-01")], [("a_b", "t", "zed"), ("x1", "t", "C"), ("ab", "t", "a b")])
    nodes = [(f"ep{s}", s, p, rng.choice(words), rng.choice("pq")) for s in range(6) for p in range(rng.randint(0, 4))]
    nodes = list({(n[0], n[3]): n for n in nodes}.values())
    edges = [(f"ep{s}", s, p, rng.choice(words), rng.choice(words), rng.choice("RS")) for s in range(6) for p in range(rng.randint(0, 4))]
    at = F.lit("2025-01-01").cast("timestamp").alias("reference_time")
    n = spark.createDataFrame(nodes, "episode_id string, seq long, pos long, name string, type string").select("*", at)
    e = spark.createDataFrame(edges, "episode_id string, seq long, pos long, source_name string, target_name string, relation string").select("*", F.lit("f").alias("fact"), at)
    got = ingest.plan(n, e, g)
    want = sequential(nodes, edges, [("a_b", "zed"), ("x1", "C"), ("ab", "a b")], {("a_b", "x1", "R")}, [])
    assert {(r.id, r.type, r.name) for r in got.nodes.collect()} == want[0]
    assert {(r.source, r.target, r.relation) for r in got.edges.collect()} == want[1]
    assert {(r.source, r.target) for r in got.mentions.collect()} == want[2]


def test_batches_and_consolidation(spark, tmp_path):
    store, client = Store(spark, str(tmp_path / "kg")), RulesClient(NAMES)
    assert ingest_batch(store, incoming(spark, EPISODES[:3] + EPISODES[:1]), client) == {"fetched": 4, "ingested": 3, "skipped": 1}
    assert ingest_batch(store, incoming(spark, EPISODES), client) == {"fetched": 5, "ingested": 2, "skipped": 3}
    g = store.graph()
    assert {r.id for r in g.entities.collect()} == {"alice", "infra_team", "platform_team", "payments_service", "postgres"}
    assert {r.type for r in g.entities.where("id = 'alice'").collect()} == {"person"}
    standing = {(r.source, r.relation, r.target) for r in g.open_edges().where("relation <> 'MENTIONED_IN'").collect()}
    assert standing == {("alice", "MEMBER_OF", "infra_team"), ("alice", "MEMBER_OF", "platform_team"), ("platform_team", "OWNS", "payments_service"), ("payments_service", "DEPENDS_ON", "postgres"), ("alice", "REPORTED", "payments_service")}
    assert lookup.episodes_of(g, "alice").count() == 4
    assert lookup.pending(g.entities).count() == 5
    done = consolidate_all(store, client, now=__import__("datetime").datetime(2025, 3, 1), run_id="r1", unresolved_path=str(tmp_path / "rest"))
    assert done["consolidated"] == 5 and done["edges_added"] == 0 and done["unresolved"] == 0
    g = store.graph()
    alice = g.entities.where("id = 'alice'").first()
    assert alice.consolidated and alice.consolidation_run_id == "r1" and "platform team" in alice.summary
    assert {r.id: r.episodic_only for r in done["episodic_only"].collect()}["alice"] == ["Alice had coffee with a friend."]
    # a new mention makes an entity pending again
    ingest_batch(store, incoming(spark, [("s6", "Alice uses Postgres.", "2025-04-01")]), client)
    assert {r.id for r in lookup.pending(store.graph().entities).collect()} == {"alice", "postgres"}


def test_unresolved_targets_are_logged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kg"))
    store.add_node("alice", "person", "Alice")
    store.add_episode("ep1", "tabs\tand\nlines", "2025-01-01")
    store.add_edge("alice", "ep1", "MENTIONED_IN", "", "2025-01-01")

    class Fixed:
        def ask(self, task, values, schema=None):
            return json.dumps({"summary": "s", "semantic_edges": [{"relation": "USES", "target": "No\tOne", "fact": "a\nb"}], "episodic_only": []})

    done = consolidate_all(store, Fixed(), unresolved_path=str(tmp_path / "rest"))
    assert (done["consolidated"], done["edges_added"], done["resolved_second"], done["unresolved"]) == (1, 0, 0, 1)
    assert [(r.source, r.target_name, r.fact) for r in spark.read.parquet(str(tmp_path / "rest")).collect()] == [("alice", "No\tOne", "a\nb")]


def test_stream_runs_once_a_row(spark, tmp_path):
    drops, store = tmp_path / "drops", Store(spark, str(tmp_path / "kg"))
    drops.mkdir()
    line = lambda s, t: json.dumps({"source_id": s, "text": t, "reference_time": "2025-01-01T00:00:00Z"}) + "\n"
    (drops / "1.json").write_text(line("a", "Alice joins the infra team.") + line("b", "Nothing."))
    (drops / "2.json").write_text(line("a", "Alice again."))

    def shape(rows):
        return rows.select("source_id", F.lit("note").alias("source_type"), "text", F.col("reference_time").cast("timestamp").alias("reference_time"), F.lit(None).cast("string").alias("metadata"))

    def run():
        query = stream(spark, str(drops), "source_id string, text string, reference_time string", shape, store, RulesClient(NAMES), str(tmp_path / "cp"))
        assert query.awaitTermination(120) and query.exception() is None
        return store.graph().episodes.count()

    assert run() == 2
    (drops / "3.json").write_text(line("b", "Nothing.") + line("c", "Something."))
    assert run() == 3


def test_extraction_schema_is_what_clients_give(spark):
    names = spark.createDataFrame([], EXTRACTION).columns
    assert names == ["nodes", "edges", "unmapped_entities", "unmapped_relations"]


@pytest.mark.parametrize("fails", ["entities", "edges", "patch", "episodes"])
def test_a_crash_between_writes_loses_nothing(spark, tmp_path, fails):
    whole, broken, client = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b")), RulesClient(NAMES)
    nameless = incoming(spark, [(None, "Alice uses Postgres.", "2025-05-01"), (None, "Alice uses Postgres.", "2025-05-01")])
    for store in (whole, broken):
        ingest_batch(store, incoming(spark, EPISODES[:2]), client)
        store.patch("entities", "alice", consolidated=True)
    batch = incoming(spark, EPISODES).union(nameless)
    ingest_batch(whole, batch, client, "b1")
    name = "patch_many" if fails == "patch" else "append"
    working = getattr(broken, name)

    def failing(log, rows):
        if fails in ("patch", log):
            raise OSError("gone")
        working(log, rows)

    setattr(broken, name, failing)
    with pytest.raises(OSError):
        ingest_batch(broken, batch, client, "b1")
    setattr(broken, name, working)
    for _ in range(2):  # again, and once more than needed
        ingest_batch(broken, batch, client, "b1")

    def state(store):
        g = store.graph()
        return (
            sorted((r.id, r.name, r.consolidated) for r in g.entities.collect()), sorted((r.id, r.text) for r in g.episodes.collect()),
            sorted((r.source, r.relation, r.target, r.fact, str(r.valid_from), str(r.valid_until)) for r in g.edges.collect()),
        )

    assert state(whole) == state(broken) and len(state(whole)[1]) == 7


def test_lookups_by_source_reach_the_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kg"))
    for id in ("alice", "team"):
        store.add_node(id, "person", id)
    edge = store.add_edge("alice", "team", "MEMBER_OF", "f", "2025-01-01")
    store.close_edge(edge, "2025-02-01")
    store.add_edge("alice", "team", "OWNS", "g", "2025-01-01")
    found = lookup.edges_of(store.graph(), "alice", relation="MEMBER_OF", active_only=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*relation[^\]]*MEMBER_OF", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(source,alice\)", plan)
    assert [(r.fact, r.valid_until is not None) for r in found.collect()] == [("f", True)]
    assert [r.fact for r in lookup.current_facts(store.graph(), "alice").collect()] == ["g"]

import json

import pytest
from pyspark.sql import types as T

from kairograph import clients
from kairograph.plans import router
from kairograph.schema import CONSOLIDATION, EXTRACTION, INTENT, PATTERNS, RELATIONS, STANDING_RELATIONS

pytestmark = pytest.mark.usefixtures("spark")  # schemas are parsed by the session
NAMES = {"Alice": "person", "infra team": "team", "platform team": "team", "auth service": "service", "Postgres": "tool"}


def parsed(schema):
    return T._parse_datatype_string(schema)


def test_rules_extract():
    got = json.loads(clients.RulesClient(NAMES).ask("extract", {"text": "Alice joined the infra team. The infra team owns the auth service. The auth service depends on Postgres."}))
    assert {n["name"] for n in got["nodes"]} == {"Alice", "infra team", "auth service", "Postgres"}
    assert [(e["source"], e["relation"], e["target"]) for e in got["edges"]] == [("Alice", "MEMBER_OF", "infra team"), ("infra team", "OWNS", "auth service"), ("auth service", "DEPENDS_ON", "Postgres")]
    clients.validated(json.dumps(got), parsed(EXTRACTION), {"relation": RELATIONS})


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Who owns the auth service?", ("direct_lookup", "auth_service", "OWNS", "in", None)),
        ("What teams has alice been on?", ("history", "alice", "MEMBER_OF", "out", None)),
        ("What breaks if postgres goes down?", ("impact", "postgres", "DEPENDS_ON", "in", None)),
        ("How is alice connected to postgres?", ("path", "alice", None, None, "postgres")),
        ("What does the infra team work with?", ("neighborhood", "infra_team", None, None, None)),
    ],
)
def test_rules_route(question, want):
    got = json.loads(clients.RulesClient(NAMES).ask("route", {"question": question}))
    assert tuple(got[k] for k in ("pattern", "anchor_entity", "relation", "direction", "target_entity")) == want
    clients.validated(json.dumps(got), parsed(INTENT), {"pattern": PATTERNS, "relation": RELATIONS}, ("relation", "direction", "target_entity"))


@pytest.mark.parametrize("raw", ["{", "[]", "{}", '{"summary": 1, "semantic_edges": [], "episodic_only": []}', '{"summary": "", "semantic_edges": [{"relation": "MENTIONED_IN", "target": "t", "fact": "f"}], "episodic_only": []}'])
def test_invalid_output_raises(raw):
    with pytest.raises(clients.InvalidOutput):
        clients.validated(raw, parsed(CONSOLIDATION), {"relation": STANDING_RELATIONS})


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise clients.TransientError(429)
        return "done"

    assert clients.with_retries(call, sleep=waits.append) == "done" and waits == [5, 10, 20]
    calls[:] = []
    with pytest.raises(clients.TransientError):
        clients.with_retries(lambda: (_ for _ in ()).throw(clients.TransientError(503)), sleep=waits.append)
    with pytest.raises(KeyError):
        clients.with_retries(lambda: {}["other errors aren't tried again"], sleep=waits.append)


def test_http_client(monkeypatch):
    monkeypatch.delenv("KAIROGRAPH_MODEL_KEY", raising=False)
    with pytest.raises(ValueError):
        clients.HttpClient("http://x", "m")
    sent = []
    client = clients.HttpClient("http://x", "m", key="k", post=lambda body: sent.append(body) or {"output": [{"content": [{"text": "out"}]}]})
    assert client.ask("route", {"question": "q?"}, clients.json_schema(parsed(INTENT))) == "out"
    assert sent[0]["text"]["format"]["schema"]["additionalProperties"] is False and "q?" in sent[0]["input"]


def test_schemas_are_closed_and_hold_the_vocabularies():
    got = clients.json_schema(parsed(CONSOLIDATION), {"relation": STANDING_RELATIONS})
    inner = got["properties"]["semantic_edges"]["items"]
    assert got["additionalProperties"] is False and inner["additionalProperties"] is False and inner["required"] == ["relation", "target", "fact"]
    assert inner["properties"]["relation"] == {"type": "string", "enum": list(STANDING_RELATIONS)}
    assert clients.json_schema(parsed(INTENT), {"relation": RELATIONS}, ("relation",))["properties"]["relation"] == {"type": ["string", "null"], "enum": [*RELATIONS, None]}


def test_every_structured_call_sends_its_schema(spark):
    class Seen:
        def ask(self, task, values, schema=None):
            assert schema["additionalProperties"] is False and schema["required"]
            return json.dumps({"nodes": [], "edges": [], "unmapped_entities": [], "unmapped_relations": []} if task == "extract" else {"pattern": "neighborhood", "anchor_entity": "a"})

    assert router.route("?", Seen()).anchor_entity == "a"
    assert clients.ask(spark.createDataFrame([("t",)], "text string"), Seen(), "extract", EXTRACTION).count() == 1


def test_batch_keeps_errors_where_asked(spark):
    class Half:
        def ask(self, task, values, schema=None):
            return "{" if "bad" in values["text"] else json.dumps({"nodes": [], "edges": [], "unmapped_entities": [], "unmapped_relations": []})

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "i int, text string")
    got = {r.i: r.wrong for r in clients.ask(rows, Half(), "extract", EXTRACTION, failed="wrong").collect()}
    assert got[1] is None and got[3] is None and "JSON" in got[2]

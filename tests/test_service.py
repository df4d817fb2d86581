import datetime as dt

import pytest

from kairograph.clients import RulesClient
from kairograph.plans import router, service
from tests.team import LINKS, NODES, make

NOW = dt.datetime(2025, 6, 1)
CLIENT = RulesClient({"alice": "person", "infra team": "team", "auth service": "service", "postgres": "tool", "ep 1": "concept"})


@pytest.fixture(scope="module")
def g(spark):
    return make(spark, [*LINKS, ("alice", "MENTIONED_IN", "ep_1", "2025-01-10")], NODES, [("ep_1", "text", "2025-01-10", "s1", 1)])


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Who owns the auth service?", {4}),
        ("What does the infra team work with?", {1, 3, 4, 7, 9, 10, 11}),
        ("How is alice connected to postgres?", {10, 11, 7}),
        ("What breaks if postgres fails?", {7, 8, 9}),
        ("What teams has alice been on?", {1, 3}),
    ],
)
def test_answers(g, question, want):
    got = service.answer(g, question, CLIENT, NOW)
    assert got["error"] is None and {int(e["id"][1:]) for e in got["edges"]} == want
    assert got["answer"].startswith(f"{len(want)} facts")
    if "teams" not in question:
        assert [e["score"] for e in got["edges"]] == sorted((e["score"] for e in got["edges"]), reverse=True)


def test_unknown_anchor_gets_suggestions(g):
    class Fixed:
        def ask(self, task, values, schema=None):
            return '{"pattern": "neighborhood", "anchor_entity": "Service"}'

    got = service.answer(g, "?", Fixed(), NOW)
    assert "auth_service, payment_service" in got["error"] and {x["id"] for x in got["suggestions"]} == {"auth_service", "payment_service"}


@pytest.mark.parametrize(
    ("intent", "error"),
    [
        (router.Intent("path", "alice"), "path query missing target_entity"),
        (router.Intent("path", "alice", target_entity="nobody"), "target entity not found"),
        (router.Intent("direct_lookup", "alice"), "direct_lookup query missing relation"),
        (router.Intent("impact", "alice"), "impact query missing relation"),
        (router.Intent("history", "alice"), "history query missing relation"),
        (router.Intent("neighborhood", "ep_1"), "not an entity"),
        (router.Intent("neighborhood", "nobody"), "entity not found"),
    ],
)
def test_checks(g, intent, error):
    assert router.check(g, intent)["error"] == error


def test_bad_output_is_returned_in_band(g):
    class Bad:
        def ask(self, task, values, schema=None):
            return '{"pattern": "dance", "anchor_entity": "alice"}'

    got = service.answer(g, "?", Bad(), NOW)
    assert "dance" in got["error"] and got["trace"]


def test_no_facts_no_answer(g):
    got = service.answer(g, "Who owns postgres?", CLIENT, NOW)
    assert got["edges"] == [] and got["answer"] is None and got["error"] is None
    assert service.health() == {"status": "ok"} and service.entities(g, "ali").count() == 1

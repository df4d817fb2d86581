"""The service's calls as functions: health, entity listing, answers."""

from __future__ import annotations

import datetime as dt
import traceback

from pyspark.sql import DataFrame

from kairograph.clients import Client
from kairograph.operators import rank, resolve
from kairograph.operators.lookup import Graph
from kairograph.plans import router


def health() -> dict:
    return {"status": "ok"}


def entities(graph: Graph, q: str | None = None) -> DataFrame:
    return resolve.list_entities(graph, q)


#: Entities and edges of one response at most; the rest is in the tables, by resolve.similar() and router.execute().
MOST_SUGGESTIONS, MOST_EDGES = 100, 1000


def suggestions(graph: Graph, anchor: str) -> tuple[str, list[dict]]:
    """A message with at most three ids, and the first MOST_SUGGESTIONS similar entities."""
    found = [r.asDict() for r in resolve.similar(graph, anchor).limit(MOST_SUGGESTIONS).collect()]
    hint = f" Did you mean: {', '.join(x['id'] for x in found[:3])}?" if found else ""
    return f"There is no entity '{anchor}'.{hint}", found


def answer(graph: Graph, question: str, client: Client, now: dt.datetime | None = None, mode: str = "compat") -> dict:
    """question, intent, edges (the first MOST_EDGES), answer, error, suggestions, trace; every failure is returned, none raised."""
    now = now or dt.datetime.now(dt.UTC)
    out: dict = {"question": question, "intent": None, "edges": [], "answer": None, "error": None, "suggestions": [], "trace": None}
    try:
        intent = router.route(question, client)
        out["intent"] = vars(intent)
        if wrong := router.check(graph, intent):
            out["error"] = wrong["error"]
            if wrong["error"] == "entity not found":
                out["error"], out["suggestions"] = suggestions(graph, intent.anchor_entity)
            return out
        found = router.execute(graph, intent, now, mode)
        rows = rank.api_rows(found.orderBy("rank").limit(MOST_EDGES)).collect()
        out["edges"] = [r.asDict() for r in rows]
        if rows:
            out["answer"] = client.ask("answer", {"question": question, "facts": rank.facts_text(rows)})
    except Exception as wrong:  # noqa: BLE001  the caller sees it in the response
        out["error"], out["trace"] = str(wrong), traceback.format_exc()
    return out

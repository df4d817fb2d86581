"""Language-model functions: a protocol, an offline client by rules, an HTTP client with retries, and batch calls.

A client is asked for a task (extract, route, consolidate, answer) with values for that task's template, and returns
JSON text, or plain text for answers. Its output is validated before it becomes rows.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairograph.operators.answers import Answers, key_column, key_of
from kairograph.schema import DIRECTIONS, NODE_TYPES, PATTERNS, RELATIONS, STANDING_RELATIONS

TEMPLATES = {
    "extract": (
        "Read the text and list what it says as JSON with the keys nodes, edges, unmapped_entities and unmapped_relations.\n"
        f"A node has a name and a type out of {', '.join(NODE_TYPES)}. An edge has source and target, both names of listed nodes, a relation out of"
        f" {', '.join(RELATIONS)}, and as fact the words that support it. What fits no type or relation goes to the unmapped lists with a reason.\nText: {{text}}"
    ),
    "route": (
        f"Turn the question into JSON with pattern ({', '.join(PATTERNS)}), anchor_entity (an id: lower case, underscores), relation"
        f" ({', '.join(RELATIONS)} or null), direction (in, out or null; out if the anchor does it) and target_entity (for path only).\nQuestion: {{question}}"
    ),
    "consolidate": (
        "These episodes, oldest first, all mention {name}. Give JSON with summary (what holds now, two or three sentences), semantic_edges (lasting facts:"
        f" relation out of {', '.join(STANDING_RELATIONS)}, target, fact) and episodic_only (passing facts as strings).\n{{episodes}}"
    ),
    "answer": "Answer in a few sentences from these facts alone, and say what they leave open.\nQuestion: {question}\nFacts:\n{facts}",
}


class Client(Protocol):
    def ask(self, task: str, values: dict[str, str], schema: dict | None = None) -> str:
        """schema: the JSON schema that the output has to follow; None for plain text."""
        ...


def prompt(task: str, values: dict[str, str]) -> str:
    """The task's template with each placeholder replaced wherever it stands."""
    text = TEMPLATES[task]
    for key, value in values.items():
        text = text.replace("{" + key + "}", value)
    return text


# ---------------------------------------------------------------- validation


class InvalidOutput(ValueError):
    pass


def validated(raw: str, schema: T.DataType, allowed: dict[str, tuple[str, ...]] | None = None, optional: tuple[str, ...] = ()) -> Any:
    """The JSON text as the schema's value; a missing or mistyped field, or a value outside `allowed`, raises."""
    try:
        value = json.loads(raw)
    except ValueError as wrong:
        raise InvalidOutput(f"not JSON: {raw[:80]}") from wrong
    return _checked(value, schema, allowed or {}, optional, "")


def _checked(value: Any, kind: T.DataType, allowed: dict, optional: tuple[str, ...], name: str) -> Any:
    if value is None and name in optional:
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise InvalidOutput(f"{name or 'the output'} is no object")
        if missing := [f for f in kind.names if f not in value and f not in optional]:
            raise InvalidOutput(f"missing: {', '.join(missing)}")
        return {f.name: _checked(value.get(f.name), f.dataType, allowed, optional, f.name) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise InvalidOutput(f"{name} is no list")
        return [_checked(x, kind.elementType, allowed, optional, name) for x in value]
    if not isinstance(value, str):
        raise InvalidOutput(f"{name} is no string")
    if name in allowed and value not in allowed[name]:
        raise InvalidOutput(f"{name} can't be {value}")
    return value


def json_schema(kind: T.DataType, allowed: dict[str, tuple[str, ...]] | None = None, optional: tuple[str, ...] = (), name: str = "") -> dict:
    """The JSON schema of what validated() accepts: objects are closed, fields all listed, vocabularies enumerated."""
    if isinstance(kind, T.StructType):
        fields = {f.name: json_schema(f.dataType, allowed, optional, f.name) for f in kind.fields}
        return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, allowed, optional, name)}
    null = name in optional
    words = (allowed or {}).get(name)
    return {"type": ["string", "null"] if null else "string"} | ({"enum": [*words, *([None] if null else [])]} if words else {})


# ---------------------------------------------------------------- batches


#: Of the answers that a task remembers, and of the rows that Spark hands to Python at once.
KEPT_BYTES, BATCH_BYTES = 16 << 20, 6 << 20


class _Kept(OrderedDict):
    """The latest answers by key, KEPT_BYTES of raw text at most."""

    size = 0

    def keep(self, key: str, raw: str, value: Any) -> None:
        self[key] = (len(raw), value)
        self.size += len(raw)
        while self.size > KEPT_BYTES and len(self) > 1:
            self.size -= self.popitem(last=False)[1][0]


def ask(
    rows: DataFrame, client: Client, task: str, schema: str, relations: tuple[str, ...] | None = None, types: tuple[str, ...] | None = None, failed: str | None = None,
    answers: Answers | None = None,
) -> DataFrame:
    """rows with the task's output columns. The client is sent to the tasks, one copy each; equal prompts of a task are asked once.

    The template's placeholders are taken from the columns of those names. Invalid output raises; with `failed`, a
    column of that name gets the error and the output is null. With `answers`, equal prompts meet in one of its `calls`
    tasks, valid answers are written down as they come, and what is written there already isn't asked.
    """
    kind = T._parse_datatype_string(schema)  # noqa: SLF001
    wanted = [c for c in rows.columns if "{" + c + "}" in TEMPLATES[task]]
    allowed = ({"relation": relations} if relations else {}) | ({"type": types} if types else {})
    wire, model = json_schema(kind, allowed), getattr(client, "model", type(client).__name__)
    names, fields = rows.columns, [*rows.schema.fields, *kind.fields, *([T.StructField(failed, T.StringType())] if failed else [])]
    bound = rows.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if answers is not None:
        rows = rows.withColumn("__key", key_column(task, model, [F.col(c) for c in wanted]))
        table = answers.table(rows.sparkSession)
        rows = rows.join(table.select(F.col("key").alias("__key"), F.col("raw").alias("__raw")), "__key", "left") if table is not None else rows.withColumn("__raw", F.lit(None).cast("string"))
        rows = rows.repartition(answers.calls, "__key").select(*names, "__raw")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        known = _Kept()
        for batch in batches:
            out = []
            told = batch["__raw"] if answers is not None else [None] * len(batch)
            for row, raw in zip(batch[wanted].astype(object).to_dict("records"), told, strict=True):
                values = {k: "" if v is None else str(v) for k, v in row.items()}
                key = key_of(task, model, list(values.values()))
                if key not in known:
                    stored = raw or (answers.get(key) if answers is not None else None)
                    text = stored if stored is not None else client.ask(task, values, wire)
                    try:
                        found = (validated(text, kind, allowed), None)
                        if answers is not None and stored is None:
                            answers.put(key, text)
                    except InvalidOutput as wrong:
                        if failed is None:
                            raise
                        found = (dict.fromkeys(kind.names), str(wrong))
                    known.keep(key, text, found)
                value, error = known[key][1]
                out.append(value | ({failed: error} if failed else {}))
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(out, columns=[f.name for f in fields[len(names) :]])], axis=1)

    return rows.mapInPandas(run, T.StructType(fields))


# ---------------------------------------------------------------- clients


class TransientError(ConnectionError):
    """A refusal that may pass: the service is busy or asks for patience."""


def with_retries(call: Callable[[], Any], attempts: int = 5, delay: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """call(), again after a transient error, with doubling delays; the last error is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except (TimeoutError, ConnectionError):
            if attempt + 1 == attempts:
                raise
            sleep(delay * 2**attempt)
    raise ValueError("no attempts")


class HttpClient:
    """Posts prompts to an endpoint that takes {input, text.format} and answers {output: [{content: [{text}]}]}.

    Fixed values: the fields of request and answer, the status codes that may pass, and the number and delays of attempts.
    """

    def __init__(self, url: str, model: str, key: str | None = None, key_variable: str = "KAIROGRAPH_MODEL_KEY", timeout: float = 120.0, post: Callable | None = None):
        self.url, self.model, self.timeout, self.post = url, model, timeout, post
        self.key = key or os.environ.get(key_variable)
        if not self.key:
            raise ValueError(f"a key, or {key_variable} in the environment, is needed")

    def ask(self, task: str, values: dict[str, str], schema: dict | None = None) -> str:
        body: dict[str, Any] = {"model": self.model, "input": prompt(task, values)}
        if schema is not None:
            body["text"] = {"format": {"type": "json_schema", "name": task, "strict": True, "schema": schema}}
        answer = with_retries(lambda: (self.post or self._post)(body))
        return answer["output"][0]["content"][0]["text"]

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as wrong:
            if wrong.code in (429, 503):
                raise TransientError(f"{wrong.code}: {wrong.read(200).decode(errors='replace')}") from wrong
            raise


class RulesClient:
    """Deterministic and offline: entities by dictionary, relations, intents and summaries by keywords."""

    VERBS = (
        ("joins", "MEMBER_OF"), ("joined", "MEMBER_OF"), ("is a member of", "MEMBER_OF"), ("owns", "OWNS"), ("depends on", "DEPENDS_ON"),
        ("uses", "USES"), ("takes over", "OWNS"), ("reports", "REPORTED"), ("reported", "REPORTED"), ("resolved by", "RESOLVED_BY"),
    )

    def __init__(self, entities: dict[str, str]):
        """entities: name as it stands in texts (any case) -> type."""
        self.entities = entities

    def ask(self, task: str, values: dict[str, str], schema: dict | None = None) -> str:
        return {"extract": self._extract, "route": self._route, "consolidate": self._consolidate, "answer": self._answer}[task](values)

    def _found(self, text: str) -> list[tuple[int, str]]:
        at = []
        for name in self.entities:
            if m := re.search(rf"(?<!\w){re.escape(name)}(?!\w)", text, re.IGNORECASE):
                at.append((m.start(), name))
        return sorted(at)

    def _clauses(self, text: str) -> Iterator[tuple[str, str, str, str]]:
        for sentence in re.split(r"[.;!\n]", text):
            names = self._found(sentence)
            for verb, relation in self.VERBS:
                at = sentence.lower().find(f" {verb} ")
                before, after = [n for p, n in names if p < at], [n for p, n in names if p > at]
                if at >= 0 and before and after:
                    yield before[-1], relation, after[0], sentence.strip()

    def _extract(self, values: dict[str, str]) -> str:
        nodes = [{"name": n, "type": self.entities[n]} for _, n in self._found(values["text"])]
        edges = [{"source": s, "target": t, "relation": r, "fact": f} for s, r, t, f in self._clauses(values["text"])]
        return json.dumps({"nodes": nodes, "edges": edges, "unmapped_entities": [], "unmapped_relations": []})

    def _route(self, values: dict[str, str]) -> str:
        question = values["question"].lower().replace("_", " ")
        ids = [re.sub(r"\s+", "_", n.lower()) for _, n in self._found(question)] or [re.sub(r"\W+", "_", question).strip("_")]
        out: dict[str, str | None] = {"pattern": "neighborhood", "anchor_entity": ids[0], "relation": None, "direction": None, "target_entity": None}
        if "connect" in question or "path" in question:
            out |= {"pattern": "path", "target_entity": ids[1] if len(ids) > 1 else None}
        elif "break" in question or "fails" in question or "affected" in question:
            out |= {"pattern": "impact", "relation": "DEPENDS_ON", "direction": "in"}
        elif "has" in question.split() or "over time" in question or "ever" in question.split():
            out |= {"pattern": "history", "relation": "MEMBER_OF", "direction": "out"}
        elif question.startswith("who owns"):
            out |= {"pattern": "direct_lookup", "relation": "OWNS", "direction": "in"}
        elif "own" in question:
            out |= {"pattern": "direct_lookup", "relation": "OWNS", "direction": "out"}
        elif "member" in question or "team" in question.split()[:2]:
            out |= {"pattern": "direct_lookup", "relation": "MEMBER_OF", "direction": "out"}
        return json.dumps(out)

    def _consolidate(self, values: dict[str, str]) -> str:
        edges, passing = [], []
        for line in values["episodes"].split("\n"):
            text = re.sub(r'^\d+\. "|"$', "", line)
            own = [(r, t, f) for s, r, t, f in self._clauses(text) if s.lower() == values["name"].lower()]
            edges += [{"relation": r, "target": t, "fact": f} for r, t, f in own]
            passing += [] if own else [text]
        summary = f"{values['name']}: " + ("; ".join(e["fact"] for e in edges) or "nothing lasting is known") + "."
        return json.dumps({"summary": summary, "semantic_edges": edges, "episodic_only": passing})

    def _answer(self, values: dict[str, str]) -> str:
        facts = [x[2:] for x in values["facts"].split("\n") if x.startswith("- ")]
        return f"{len(facts)} facts answer this; the first is: {facts[0]}" if facts else "No fact answers this."

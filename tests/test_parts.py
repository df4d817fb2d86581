"""Prompts in parts and answers that last."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kairograph.clients import ask
from kairograph.operators.answers import Answers, key_column, key_of
from kairograph.operators.consolidate import consolidate_all
from kairograph.operators.lookup import numbered_texts
from kairograph.operators.parts import texts_in_parts
from kairograph.operators.store import Store
from kairograph.schema import CONSOLIDATION, EXTRACTION

NOTHING = {"nodes": [], "edges": [], "unmapped_entities": [], "unmapped_relations": []}


def mentioned(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, reference_time string, seq long, text string")


@pytest.mark.parametrize("most", [10, 64, 1000, 10**6])
def test_parts_hold_every_episode_within_the_bound(spark, most):
    rows = [("hub", f"2025-01-{i % 28 + 1:02d}", i, f"episode {i} " * (i % 7)) for i in range(300)] + [("small", "2025-01-01", 1, "one\nline"), ("small", "2025-01-01", 2, None), ("long", "2025-01-01", 1, "x" * 5000)]
    df = mentioned(spark, rows)
    whole = {r.entity_id: r.episodes for r in numbered_texts(df).collect()}
    parts = {}
    for r in texts_in_parts(df, most).collect():
        assert len(r.episodes) <= most
        parts.setdefault(r.entity_id, {})[r.part] = r.episodes
    for entity, text in whole.items():
        told = [parts[entity][k] for k in sorted(parts[entity])]
        assert "".join(told).replace("\n", "") == text.replace("\n", "") and (len(told) == 1) == (len(text) < most // 2 or most == 10**6)
    assert texts_in_parts(df.limit(0), most).isEmpty()


class Counting:
    """Summaries that say which numbers of episodes they cover; every call is logged in a file."""

    model = "counting"

    def __init__(self, log, fails_at=None):
        self.log, self.fails_at = str(log), fails_at

    def ask(self, task, values, schema=None):
        if self.fails_at and self.fails_at in values.get("text", ""):
            raise OSError("gone")
        with open(self.log, "a") as file:
            file.write(json.dumps(values) + "\n")
        if task == "extract":
            return json.dumps(NOTHING)
        found = [w for w in values["episodes"].replace('"', " ").split() if w.startswith("#")]
        return json.dumps({"summary": " ".join(found) if len(found) < 40 else f"#{len(found)}more", "semantic_edges": [], "episodic_only": []})


def calls(log):
    return [json.loads(x) for x in log.read_text().split("\n")[:-1]] if log.exists() else []


def test_an_entity_in_parts_gets_one_summary(spark, tmp_path):
    """Every episode reaches the model, no prompt is over the bound, and the parts' summaries are summed up again."""
    store, log = Store(spark, str(tmp_path / "kg")), tmp_path / "log"
    for name in ("hub", "small"):
        store.add_node(name, "concept", name)
    said = spark.range(200).select(F.concat(F.lit("ep"), "id").alias("id"), F.concat(F.lit("word "), F.lit("#"), F.col("id"), F.lit(" end")).alias("text"), F.timestamp_seconds(F.col("id")).alias("reference_time"))
    store.append("episodes", said.withColumn("__order", F.col("reference_time")))
    edges = [("hub", f"ep{i}") for i in range(200)] + [("small", "ep7")]
    store.append("edges", spark.createDataFrame([(f"{s}:{t}", s, t, "MENTIONED_IN") for s, t in edges], "id string, source string, target string, relation string"))
    done = consolidate_all(store, Counting(log), most=600)
    asked = calls(log)
    assert done["consolidated"] == 2 and max(len(x["episodes"]) for x in asked) <= 600 and len(asked) > 10
    words = {w for x in asked if "word" in x["episodes"] for w in x["episodes"].replace('"', " ").split() if w.startswith("#")}
    assert words == {f"#{i}" for i in range(200)}
    g = {r.id: r.summary for r in store.graph().entities.collect()}
    assert g["small"] == "#7" and g["hub"].startswith("#") and store.graph().entities.where("not consolidated").isEmpty()


def test_a_failed_run_makes_no_second_call(spark, tmp_path):
    log, answers = tmp_path / "log", Answers(str(tmp_path / "answers"), calls=1)
    rows = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)], "i int, text string").coalesce(1)
    with pytest.raises(Exception, match="gone"):
        ask(rows, Counting(log, "text 9"), "extract", EXTRACTION, answers=answers).collect()
    before = len(calls(log))
    assert ask(rows, Counting(log), "extract", EXTRACTION, answers=answers).count() == 40
    n = Counter(x["text"] for x in calls(log))
    assert len(n) == 20 and set(n.values()) == {1} and before < 20
    assert answers.fold(spark) == 20 and answers.fold(spark) == 0 and answers.table(spark).count() == 20
    more = rows.union(spark.createDataFrame([(99, "new")], "i int, text string"))
    assert ask(more, Counting(log), "extract", EXTRACTION, answers=answers).count() == 41  # from the table
    assert Counter(x["text"] for x in calls(log)) == n + Counter(["new"])


def test_invalid_answers_are_not_kept(spark, tmp_path):
    class Wrong(Counting):
        def ask(self, task, values, schema=None):
            super().ask(task, values, schema)
            return "{"

    answers = Answers(str(tmp_path / "answers"))
    rows = spark.createDataFrame([("n", "e")], "name string, episodes string")
    assert ask(rows, Wrong(tmp_path / "log"), "consolidate", CONSOLIDATION, failed="why", answers=answers).first().why
    assert ask(rows, Counting(tmp_path / "log"), "consolidate", CONSOLIDATION, failed="why", answers=answers).first().why is None


def test_keys_are_the_same_in_both_worlds(spark):
    rows = spark.createDataFrame([("a", None), ("ü\n", "x")], "x string, y string")
    got = [r[0] for r in rows.select(key_column("extract", "m", [F.col("x"), F.col("y")])).collect()]
    assert got == [key_of("extract", "m", ["a", ""]), key_of("extract", "m", ["ü\n", "x"])]

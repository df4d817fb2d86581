"""Live feeds by a fake transport: block waves, streamed changes, crashes, the command line."""

import json

import pytest

from kairograph.__main__ import main
from kairograph.clients import RulesClient
from kairograph.operators.store import Store
from kairograph.sources import blocks, feed, pages
from kairograph.sources.blocks import fetch_blocks
from kairograph.sources.changes import ChangesReader
from kairograph.streaming import live

WORDS = " ".join(f"w{i}" for i in range(50))
MORE = {"transport": "tests.fake_service:serve", "token_variable": None}
CLIENT = RulesClient({"Alice": "person", "infra": "team"})


def block(id, text, inner=False, kind="paragraph"):
    return {"id": id, "type": kind, "has_children": inner, kind: {"rich_text": [{"plain_text": text}]}}


def page(id, edited):
    return {"id": id, "last_edited_time": edited, "created_time": edited, "url": id, "properties": {"n": {"type": "title", "title": [{"plain_text": id.upper()}]}}}


class Service:
    """The fake service's file; its calls are the lines that the transport logs."""

    def __init__(self, folder):
        self.path = folder / "service.json"
        self.data = {"pages": [], "children": {}, "events": []}

    def add(self, id, edited, text=f"Alice joins infra. {WORDS}"):
        self.data["pages"] = [p for p in self.data["pages"] if p["id"] != id] + [page(id, edited)]
        self.data["children"][id] = [block(f"{id}-b", text)]
        return self.save()

    def event(self, id, updated):
        self.data["events"].append({"id": id, "summary": "Alice joins infra.", "description": WORDS, "updated": updated, "start": {"date": updated[:10]}})
        return self.save()

    def save(self):
        self.path.write_text(json.dumps(self.data))
        return self

    def calls(self):
        log = self.path.with_suffix(".calls")
        lines = log.read_text().split("\n")[:-1] if log.exists() else []
        log.write_text("")
        return [line.rsplit(" ", 1)[0] for line in lines]

    def options(self):
        return live.page_options(str(self.path), **MORE)


def stored(store):
    return sorted((r.source_id, r.text.split("\n")[0]) for r in store.graph().episodes.collect())


def test_block_waves_equal_a_dump(spark, tmp_path):
    """Three levels, more answers than one a parent, an empty parent, a parent without text, two pages."""
    service = Service(tmp_path)
    tree = {
        "p1": [block("a", "one", True), block("b", "two"), block("c", "three", True), block("d", WORDS)],
        "a": [block("a1", "one.one", True), block("a2", "", True, "toggle"), block("a3", "one.three")],
        "a1": [block("a11", "deep"), block("a12", "deeper"), block("a13", "deepest")], "a2": [block("a21", "under a toggle")], "c": [],
        "p2": [block("e", "alone")], "p3": [],
    }
    service.data["children"] = tree
    service.save()
    asked = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p1",), (None,)], "id string")
    got = fetch_blocks(asked, service.options()[1])
    dump = spark.createDataFrame([(parent, pos, json.dumps(b)) for parent, of in tree.items() for pos, b in enumerate(of)], "parent string, pos int, raw string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dump.collect()))
    calls = service.calls()
    assert len(calls) == len(set(calls)) == sum(max(1, -(-len(of) // 2)) for of in tree.values())  # no parent is asked for twice, though the result was read twice
    texts = {r.page_id: r.text for r in pages.page_texts(got).collect()}
    assert texts == {"p1": f"one\none.one\ndeep\ndeeper\ndeepest\nunder a toggle\none.three\ntwo\nthree\n{WORDS}", "p2": "alone"}
    assert fetch_blocks(asked.limit(0), service.options()[1]).isEmpty()


def test_a_range_holds_both_its_moments(tmp_path):
    service = Service(tmp_path)
    for day in (1, 2, 3, 4, 5):
        service.add(f"p{day}", f"2025-01-0{day}")
    reader = ChangesReader({k: v for k, v in service.options()[0].items()})
    assert reader.initialOffset() == {"until": ""} and reader.latestOffset() == {"until": "2025-01-05"} and service.calls() == ["search 0"]
    read = lambda start, end: [json.loads(x[0])["id"] for p in reader.partitions({"until": start}, {"until": end}) for x in reader.read(p)]
    assert read("2025-01-02", "2025-01-04") == ["p4", "p3", "p2"] and read("", "2025-01-02") == ["p2", "p1"]
    service.calls()
    assert read("2025-01-05", "2025-01-05") == ["p5"] and service.calls() == ["search 0"]  # it stops at the first older item


@pytest.mark.parametrize("fails", ["before", "after"])
def test_a_crash_between_fetch_and_commit(spark, tmp_path, monkeypatch, fails):
    """The batch fails before or after it is stored; the next run reads the same range and nothing is lost or doubled."""
    service, store, at = Service(tmp_path).add("p1", "2025-01-01").add("p2", "2025-01-02"), Store(spark, str(tmp_path / "kg")), str(tmp_path / "checkpoint")
    live.stream_pages(spark, store, CLIENT, at, service.options()).awaitTermination()
    assert stored(store) == [(p, f"Alice joins infra. {WORDS}") for p in ("p1", "p2")]
    service.add("p3", "2025-01-02").add("p4", "2025-01-03")  # one at the moment that was read last
    working = live.ingest_batch

    def failing(*said):
        if fails == "after":
            working(*said)
        raise OSError("gone")

    monkeypatch.setattr(live, "ingest_batch", failing)
    with pytest.raises(Exception, match="gone"):
        live.stream_pages(spark, store, CLIENT, at, service.options()).awaitTermination()
    monkeypatch.setattr(live, "ingest_batch", working)
    service.add("p5", "2025-01-04")
    counts = []
    for _ in range(2):
        live.stream_pages(spark, store, CLIENT, at, service.options(), counts.append).awaitTermination()
    assert [x for x, _ in stored(store)] == ["p1", "p2", "p3", "p4", "p5"]
    assert store.graph().edges.where("relation = 'MEMBER_OF'").count() == 1


def test_command_line(spark, tmp_path, capsys):
    service, kg = Service(tmp_path).add("p1", "2025-01-01").event("e1", "2025-01-02"), str(tmp_path / "kg")
    args = ["ingest", "--store", kg, "--names", '{"Alice": "person", "infra": "team"}', "--checkpoint", str(tmp_path / "at"), "--transport", "tests.fake_service:serve"]
    args += ["--token-variable", "PATH"]  # one that the executors' environment has
    main([*args, "--live", "pages", "--api", str(service.path)])
    main([*args, "--live", "events", "--api", f"{service.path}/events"])
    service.event("e2", "2025-01-03")
    main([*args, "--live", "events", "--api", f"{service.path}/events"])
    told = [json.loads(line) for line in capsys.readouterr().out.split("\n") if line.startswith("{")]
    assert [x["ingested"] for x in told] == [1, 1, 1] and [x for x, _ in stored(Store(spark, kg))] == ["e1", "e2", "p1"]
    main(["compact", "--store", kg])
    assert len(stored(Store(spark, kg))) == 3


def test_cursor_of_dumps(spark, tmp_path, capsys):
    """A dump is read from the cursor on, which is committed after the batch is stored."""
    (tmp_path / "pages.json").write_text(json.dumps(page("p1", "2025-01-01")))
    (tmp_path / "blocks.json").write_text(json.dumps({"parent": "p1", "pos": 0, "raw": json.dumps(block("b", WORDS))}))
    args = ["ingest", "--store", str(tmp_path / "kg"), "--pages", str(tmp_path / "pages.json"), "--blocks", str(tmp_path / "blocks.json"), "--cursor", str(tmp_path / "cursor")]
    main(args)
    main(args)
    told = [json.loads(line) for line in capsys.readouterr().out.split("\n") if line.startswith("{")]
    assert [(x["fetched"], x["ingested"]) for x in told] == [(1, 1), (0, 0)]


def test_deep_blocks_take_few_waves(spark, tmp_path, monkeypatch):
    """A chain of 300 levels beside a flat page: few waves, one call a parent, whole text; too deep a chain is an error."""
    service = Service(tmp_path)
    service.data["children"] = {"p": [block("b0", "t0", True)], **{f"b{i}": [block(f"b{i + 1}", f"t{i + 1}", i < 299)] for i in range(300)}, "q": [block("x", "flat")]}
    service.save()
    waves, asked = [], blocks.children
    monkeypatch.setattr(blocks, "children", lambda *a: waves.append(1) or asked(*a))
    made = spark.createDataFrame([("p",), ("q",)], "id string")
    got = fetch_blocks(made, service.options()[1])
    assert len(waves) <= 3
    calls = service.calls()
    assert len(calls) == len(set(calls)) == 302
    assert {r.page_id: r.text for r in pages.page_texts(got).collect()} == {"p": "\n".join(f"t{i}" for i in range(301)), "q": "flat"}
    with pytest.raises(RuntimeError, match="levels"):
        fetch_blocks(made, service.options()[1], levels=250)
    with pytest.raises(RuntimeError, match="levels"):
        pages.page_texts(got, levels=250)


def test_blocks_in_a_circle_belong_to_no_page(spark):
    rows = [("p", 0, "a"), ("a", 0, "b"), ("c", 0, "d"), ("d", 0, "c"), ("d", 1, "e")]
    made = spark.createDataFrame([(parent, pos, json.dumps(block(id, id))) for parent, pos, id in rows], "parent string, pos int, raw string")
    assert {r.page_id: r.text for r in pages.page_texts(made).collect()} == {"p": "a\nb"}


def test_a_served_table_is_read_by_row_groups(spark, tmp_path):
    """One footer a file and process, and of 50 row groups only those of the parent asked for."""
    rows = [(f"p{i:04}", pos, json.dumps({"id": f"{i}-{pos}"})) for i in range(1000) for pos in range(5)]
    path = str(tmp_path / "served")
    spark.createDataFrame(rows, "parent string, pos int, raw string").coalesce(1).sort("parent", "pos").write.option("parquet.block.row.count.limit", 100).parquet(path)
    feed._answers.cache_clear()  # noqa: SLF001
    for i in (0, 500, 999):
        assert [x["id"] for x in feed.items({"transport": "kairograph.sources.feed:from_table"}, f"{path}?parent=p{i:04}")] == [f"{i}-{pos}" for pos in range(5)]
    assert list(feed.items({"transport": "kairograph.sources.feed:from_table"}, f"{path}?parent=none")) == []
    assert feed._row_groups.cache_info().misses and feed._answers.cache_info().misses <= 4  # noqa: SLF001

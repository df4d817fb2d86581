import datetime as dt
import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from kairograph.sources import calendar, cursor, feed, pages

WORDS = " ".join(f"w{i}" for i in range(50))


def block(id, kind, text, **more):
    return json.dumps({"id": id, "type": kind, kind: {"rich_text": [{"plain_text": text[: len(text) // 2]}, {"plain_text": text[len(text) // 2 :]}]}, **more})


def test_pages(spark, tmp_path):
    raw = [
        {"id": "p1", "created_time": "2025-01-01T00:00:00Z", "last_edited_time": "2025-02-01T00:00:00Z", "url": "u", "properties": {"t": {"type": "select"}, "n": {"type": "title", "title": [{"plain_text": "Ti"}, {"plain_text": "tle"}]}}},
        {"id": "p2", "last_edited_time": "2025-02-02T00:00:00Z", "properties": {}},
        {"id": "p3", "last_edited_time": "2025-01-15T00:00:00Z", "properties": {}},
        {"id": "p4", "properties": {}},
    ]
    file = tmp_path / "pages.json"
    file.write_text("\n".join(map(json.dumps, raw)))
    df = spark.read.schema(pages.PAGE).json(str(file))
    blocks = spark.createDataFrame(
        [
            ("p1", 0, block("b1", "paragraph", "first")), ("p1", 1, block("b2", "toggle", "no text of its own", has_children=True)), ("b2", 0, block("b3", "quote", "inner")),
            ("b3", 0, block("b4", "to_do", "deep")), ("p1", 2, block("b5", "code", WORDS)), ("p1", 3, json.dumps({"id": "b6", "type": "paragraph"})),
            ("p2", 0, block("c1", "paragraph", WORDS.rsplit(" ", 1)[0])), ("p3", 0, block("d1", "paragraph", WORDS)), ("p4", 0, block("f1", "paragraph", WORDS)),
        ],
        "parent string, pos int, raw string",
    )
    got = {r.page_id: r for r in pages.fetch(df, blocks).collect()}
    assert set(got) == {"p1", "p3", "p4"}  # p2 has 49 words
    assert got["p1"].plain_text_content == f"first\ninner\ndeep\n{WORDS}" and got["p1"].page_title == "Title" and got["p3"].page_title == ""
    assert {r.page_id for r in pages.fetch(df, blocks, "2025-01-15T00:00:00Z").collect()} == {"p1"}  # equal and missing times are old
    assert json.loads(pages.as_episodes(pages.fetch(df, blocks)).where("source_id = 'p1'").first().metadata)["page_title"] == "Title"


def test_calendar(spark, tmp_path):
    long = " ".join(["word"] * 19)
    events = [
        {"id": "1", "summary": "Meet", "description": f" {long} ", "location": " Hall ", "start": {"dateTime": "2025-01-10T10:00:00+02:00"}, "end": {"dateTime": "2025-01-10T11:00:00+02:00"}, "organizer": {"email": "o@x"},
         "attendees": [{"displayName": "Ann"}, {"email": "b@x"}, {"displayName": "Me", "self": True}], "htmlLink": "l"},
        {"id": "2", "status": "cancelled", "summary": "x", "description": long},
        {"id": "3", "description": long, "start": {"date": "2025-01-10"}},
        {"id": "4", "summary": "short"},
        {"id": "5", "summary": "one", "description": long},
        {"id": "6", "summary": "", "description": long},
    ]
    file = tmp_path / "events.json"
    file.write_text("\n".join(map(json.dumps, events)))
    now = dt.datetime(2025, 3, 1, tzinfo=dt.UTC)
    rows = calendar.fetch(spark.read.schema(calendar.EVENT).json(str(file)), now)
    got = {r.event_id: r for r in rows.collect()}
    assert set(got) == {"1", "3", "5"}  # 6 has 19 words
    assert got["1"].plain_text_content == f"Meet\nTime: 2025-01-10T10:00:00+02:00 to 2025-01-10T11:00:00+02:00\nOrganizer: o@x\nAttendees: Ann, b@x\n{long}\nLocation: Hall"
    assert got["1"].attendees == ["Ann", "b@x", "Me"] and got["3"].title == "Untitled event" and got["3"].attendees == []
    assert got["3"].plain_text_content.split("\n")[1] == "Time: 2025-01-10 to " and got["5"].event_time == now.isoformat()
    times = {r.source_id: r.t for r in calendar.as_episodes(rows).select("source_id", F.date_format("reference_time", "yyyy-MM-dd HH:mm").alias("t")).collect()}
    assert times["1"] == "2025-01-10 08:00" and times["3"] == "2025-01-10 00:00"
    assert calendar.since(None, now) == "2024-09-02T00:00:00+00:00" and calendar.since("c", now) == "c"


def test_cursor(spark, tmp_path):
    path = str(tmp_path / "cursor")
    assert cursor.load(spark, path) is None
    cursor.commit(spark, path, "2025-01-01T00:00:00+00:00")
    cursor.commit(spark, path, "2025-01-02T00:00:00+00:00")
    assert cursor.load(spark, path) == "2025-01-02T00:00:00+00:00"


def fake(method, url, body, headers=None):
    """Transport of the tests: three pages of two, times falling; a GET has its cursor in the url."""
    asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query)) if method == "GET" else body
    assert (body is None) == (method == "GET")
    at = int(asked.get("start_cursor", 0))
    who = (headers or {}).get("Authorization")
    return 200, {}, {"results": [{"id": i, "edited": f"2025-01-{20 - i}", "who": who} for i in (at, at + 1)], "next_cursor": str(at + 2) if at < 4 else None}


def test_feed(spark, monkeypatch):
    for method in ("POST", "GET"):
        assert [x["id"] for x in feed.pages(fake, method, "u", {}, "results", "start_cursor", "next_cursor")] == [0, 1, 2, 3, 4, 5]
    asked = []
    got = feed.pages(lambda *a: asked.append(a) or fake(*a), "GET", "u?x=1", {"page_size": 2}, "results", "start_cursor", "next_cursor", lambda x: x["edited"] <= "2025-01-18")
    assert [x["id"] for x in got] == [0, 1] and [a[1] for a in asked] == ["u?x=1&page_size=2", "u?x=1&page_size=2&start_cursor=2"]  # the third page isn't asked for
    spark.dataSource.register(feed.FeedSource)
    rows = spark.read.format("json_feed").options(url="http://a http://b", transport="tests.test_sources:fake").load()
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 12
    monkeypatch.setenv("FEED_TOKEN", "t")
    reader = feed.FeedReader({"url": "u", "transport": "tests.test_sources:fake", "token_variable": "FEED_TOKEN", "headers": '{"Version": "1"}', "stop_field": "edited", "stop_at": "2025-01-17"})
    got = [json.loads(x[0]) for p in reader.partitions() for x in reader.read(p)]
    assert [x["id"] for x in got] == [0, 1, 2] and got[0]["who"] == "Bearer t"


def test_feed_waits_only_for_429():
    waits, answers = [], [(429, {}, None), (429, {"Retry-After": "7"}, None), (200, {}, {"ok": 1})]
    assert feed.request(lambda *_: answers.pop(0), "GET", "u", sleep=waits.append) == {"ok": 1} and waits == [1.0, 7.0]
    waits.clear()
    with pytest.raises(RuntimeError):
        feed.request(lambda *_: (429, {}, None), "GET", "u", sleep=waits.append)
    assert waits == [1, 2, 4, 8, 16, 32]
    with pytest.raises(RuntimeError):
        feed.request(lambda *_: (500, {}, None), "GET", "u", sleep=waits.append)

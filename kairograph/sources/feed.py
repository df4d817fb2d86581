"""Paged JSON APIs as a Spark data source: one partition a feed, pages followed by their cursor, requests retried.

The transport is any function (method, url, body), with headers if any are set, -> (status, headers, JSON), so that tests and other networks bring
their own; it is named by `transport`, "module:function", and imported where the tasks run.
"""

from __future__ import annotations

import bisect
import functools
import importlib
import itertools
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, str, dict | None], tuple[int, dict, Any]]


def http(method: str, url: str, body: dict | None, headers: dict | None = None, timeout: float = 30.0) -> tuple[int, dict, Any]:
    request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json", **(headers or {})}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), json.load(answer)
    except urllib.error.HTTPError as wrong:
        return wrong.code, dict(wrong.headers), None


@functools.lru_cache(maxsize=4)
def _row_groups(path: str) -> tuple[list[str], list[tuple[str, Any]]]:
    """The row groups of a Parquet table by their least parent: these, and (the greatest parent up to here, row group)."""
    import pyarrow.dataset as ds

    found = []
    for file in ds.dataset(path, format="parquet").get_fragments():
        for group in file.split_by_row_group():
            ends = group.row_groups[0].statistics.get("parent") if group.row_groups[0].statistics else None
            found.append((ends["min"], ends["max"], group) if ends else ("", chr(0x10FFFF), group))
    found.sort(key=lambda x: x[:2])
    tops = itertools.accumulate((x[1] for x in found), max)
    return [x[0] for x in found], [(top, x[2]) for top, x in zip(tops, found, strict=True)]


@functools.lru_cache(maxsize=4)
def _answers(path: str, number: int) -> dict[str, list[tuple[int, str]]]:
    """(pos, raw) by parent of one row group."""
    rows: dict[str, list[tuple[int, str]]] = {}
    made = _row_groups(path)[1][number][1].to_table(columns=["parent", "pos", "raw"])
    for parent, pos, raw in zip(*(made[c].to_pylist() for c in made.column_names), strict=True):
        rows.setdefault(parent, []).append((pos, raw))
    return rows


def from_table(method: str, url: str, body: dict | None, headers: dict | None = None) -> tuple[int, dict, Any]:
    """A transport that answers from a Parquet table of (parent, pos, raw): ?parent=... has its rows by pos, two an answer.

    Footers are read once a process, and of the table the row groups that may hold the parent, so it should be sorted by
    parent in small row groups. The files under a path are taken not to change.
    """
    split = urllib.parse.urlsplit(url)
    asked = dict(urllib.parse.parse_qsl(split.query))
    least, groups = _row_groups(split.path)
    rows: list[tuple[int, str]] = []
    for number in range(bisect.bisect_right(least, asked["parent"]) - 1, -1, -1):
        if groups[number][0] < asked["parent"]:
            break
        rows += _answers(split.path, number).get(asked["parent"], [])
    rows.sort()
    at = int(asked.get("start_cursor", 0))
    return 200, {}, {"results": [json.loads(raw) for _, raw in rows[at : at + 2]], "next_cursor": str(at + 2) if at + 2 < len(rows) else None}


def request(send: Transport, method: str, url: str, body: dict | None = None, attempts: int = 6, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The answer's JSON; a 429 waits for Retry-After, or 1, 2, 4 ... seconds, and tries again; other failures raise."""
    delay = 1.0
    for _ in range(attempts):
        status, headers, answer = send(method, url, body)
        if status == 429:
            sleep(float(headers.get("Retry-After", delay)))
            delay = min(2 * delay, most)
            continue
        if status >= 400:
            raise RuntimeError(f"{status} from {url}")
        return answer
    raise RuntimeError(f"no answer after {attempts} attempts: {url}")


def pages(
    send: Transport, method: str, url: str, body: dict, items: str, cursor_in: str, cursor_out: str, stop: Callable[[dict], bool] | None = None, **retry: Any
) -> Iterator[dict]:
    """Items of all pages; the cursor of an answer is sent with the next request until there is none.

    A GET has its parameters, the cursor too, in the url's query, other methods in the body. `stop` ends a feed sorted by
    time at the first item for which it holds, which isn't given, and asks for no further page.
    """
    body = dict(body)
    while True:
        if method == "GET":
            query = urllib.parse.urlencode(body)
            answer = request(send, method, f"{url}{'&' if '?' in url else '?'}{query}" if query else url, None, **retry)
        else:
            answer = request(send, method, url, body, **retry)
        for item in answer.get(items, []):
            if stop is not None and stop(item):
                return
            yield item
        if not answer.get(cursor_out):
            return
        body[cursor_in] = answer[cursor_out]


class FeedSource(DataSource):
    """spark.read.format("json_feed").options(url, items, cursor_in, cursor_out, body, method, transport, ...): column raw.

    headers: a JSON object of request headers. token_variable: the environment variable, where the tasks run, that holds
    a bearer token. stop_field, stop_at: a feed sorted by that field, falling, is read while it is greater.
    """

    @classmethod
    def name(cls) -> str:
        return "json_feed"

    def schema(self) -> str:
        return "raw string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(dict(self.options))


def sender(options: dict) -> Transport:
    """The transport that the options name, with their headers and the token in the environment of this process."""
    module, _, name = options.get("transport", "kairograph.sources.feed:http").partition(":")
    send = getattr(importlib.import_module(module), name)
    headers = json.loads(options.get("headers", "{}"))
    if "token_variable" in options:
        if not os.environ.get(options["token_variable"]):
            raise ValueError(f"{options['token_variable']} must hold a token in the environment of driver and executors")
        headers["Authorization"] = f"Bearer {os.environ[options['token_variable']]}"
    return functools.partial(send, headers=headers) if headers else send


def items(options: dict, url: str, stop: Callable[[dict], bool] | None = None, **body: Any) -> Iterator[dict]:
    """All items of one feed by its options; `body` adds to the request's parameters."""
    names = (options.get("items", "results"), options.get("cursor_in", "start_cursor"), options.get("cursor_out", "next_cursor"))
    return pages(sender(options), options.get("method", "GET"), url, {**json.loads(options.get("body", "{}")), **body}, *names, stop)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(url) for url in self.options["url"].split(" ")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, stop = self.options, None
        if "stop_at" in o:
            field, least = o["stop_field"], o["stop_at"]

            def stop(item: dict) -> bool:
                return (item.get(field) or "") <= least

        for item in items(o, partition.value, stop):
            yield (json.dumps(item),)

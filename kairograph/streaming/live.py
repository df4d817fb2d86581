"""Live feeds to a store: what changed since the stream's checkpoint, a batch at a time, through the connectors' rows.

Nothing is asked for twice but what a failed batch had not stored. Episodes are stored once by their source id, so the
items that a range of moments shares with the next add nothing.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kairograph.clients import Client
from kairograph.operators.store import Store
from kairograph.sources import calendar, pages
from kairograph.sources.blocks import fetch_blocks
from kairograph.sources.changes import ChangesSource
from kairograph.streaming.ingest import ingest_batch

#: Addresses, version header, page sizes and parameters of the two services.
PAGES_API, PAGES_VERSION, PAGES_SIZE = "https://api.notion.com/v1", "2022-06-28", 100
EVENTS_API, EVENTS_SIZE = "https://www.googleapis.com/calendar/v3/calendars/primary/events", 250


def page_options(api: str = PAGES_API, token_variable: str | None = "NOTION_API_KEY", **more: str) -> tuple[dict, dict]:
    """Options of the search for changed pages, and of the children of a block."""
    shared = {"headers": json.dumps({"Notion-Version": PAGES_VERSION}), **({"token_variable": token_variable} if token_variable else {}), **more}
    search = {"filter": {"value": "page", "property": "object"}, "page_size": PAGES_SIZE, "sort": {"direction": "descending", "timestamp": "last_edited_time"}}
    return (
        {**shared, "url": f"{api}/search", "method": "POST", "body": json.dumps(search), "field": "last_edited_time", "sorted": "true"},
        {**shared, "url": api + "/blocks/{id}/children", "method": "GET", "body": json.dumps({"page_size": PAGES_SIZE})},
    )


def event_options(since: str, api: str = EVENTS_API, token_variable: str | None = "CALENDAR_TOKEN", **more: str) -> dict:
    """Options of the events that changed since a moment. `updatedMin` bounds the answer by change, `timeMin` by time of the event."""
    body = {"timeMin": since, "maxResults": EVENTS_SIZE, "singleEvents": "true", "orderBy": "updated"}
    return {
        **({"token_variable": token_variable} if token_variable else {}), **more, "url": api, "method": "GET", "body": json.dumps(body),
        "items": "items", "cursor_in": "pageToken", "cursor_out": "nextPageToken", "field": "updated", "since_parameter": "updatedMin",
    }


def _started(spark: SparkSession, options: dict, store: Store, client: Client, checkpoint: str, rows: Callable[[DataFrame], DataFrame], done: Callable[[dict], None] | None) -> StreamingQuery:
    spark.dataSource.register(ChangesSource)

    def batch(raw: DataFrame, number: int) -> None:
        counts = ingest_batch(store, rows(raw), client, f"{checkpoint}/{number}")
        if done is not None:
            done(counts)

    return spark.readStream.format("feed_changes").options(**options).load().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_pages(spark: SparkSession, store: Store, client: Client, checkpoint: str, options: tuple[dict, dict], done: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Pages that changed since the checkpoint, with all their blocks; stops once it has caught up."""
    search, inner = options

    def rows(raw: DataFrame) -> DataFrame:
        found = raw.select(F.from_json("raw", pages.PAGE).alias("p")).select("p.*")
        return pages.as_episodes(pages.fetch(found, fetch_blocks(found, inner)))

    return _started(spark, search, store, client, checkpoint, rows, done)


def stream_events(spark: SparkSession, store: Store, client: Client, checkpoint: str, options: dict, done: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Events that changed since the checkpoint; stops once it has caught up."""

    def rows(raw: DataFrame) -> DataFrame:
        found = raw.select(F.from_json("raw", calendar.EVENT).alias("e")).select("e.*")
        return calendar.as_episodes(calendar.fetch(found, dt.datetime.now(dt.UTC)))

    return _started(spark, options, store, client, checkpoint, rows, done)

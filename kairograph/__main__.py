"""python -m kairograph ingest|consolidate|ask|entities|compact --store PATH ...

Ingestion reads dumps (--pages, --blocks, --events), or with --live the services, from where --checkpoint says that the
last run ended. Tokens and the model's key are read from the environment. Without --model the offline rules client answers.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kairograph.clients import HttpClient, RulesClient
from kairograph.operators.consolidate import consolidate_all
from kairograph.operators.lookup import pending
from kairograph.operators.store import Store
from kairograph.plans import service
from kairograph.schema import TABLES
from kairograph.sources import calendar, cursor, pages
from kairograph.streaming import live
from kairograph.streaming.ingest import ingest_batch


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kairograph")
    parser.add_argument("command", choices=("ingest", "consolidate", "ask", "entities", "compact"))
    parser.add_argument("--store", required=True)
    parser.add_argument("--names", help="JSON object: entity name to type, for the rules client")
    parser.add_argument("--events", help="calendar events, JSON lines")
    parser.add_argument("--pages", help="pages, JSON lines")
    parser.add_argument("--blocks", help="blocks (parent, pos, raw), JSON lines")
    parser.add_argument("--live", choices=("pages", "events"), action="append", default=[], help="read what changed in a service")
    parser.add_argument("--checkpoint", help="folder of the live feeds' positions")
    parser.add_argument("--api", help="the service's address, if it is another")
    parser.add_argument("--transport", help="module:function that sends requests")
    parser.add_argument("--token-variable", help="environment variable of driver and executors that holds the service's token")
    parser.add_argument("--cursor", help="of --pages: a file with the moment of the last read; older pages are left out")
    parser.add_argument("--model", help="name of a model behind --model-url")
    parser.add_argument("--model-url")
    parser.add_argument("--unresolved", help="where unresolved targets are appended")
    parser.add_argument("--question", default="")
    given = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, given.store)
    client = HttpClient(given.model_url, given.model) if given.model else RulesClient(json.loads(given.names or "{}"))
    if given.command == "ingest":
        now = dt.datetime.now(dt.UTC)
        more = ({"transport": given.transport} if given.transport else {}) | ({"api": given.api} if given.api else {}) | ({"token_variable": given.token_variable} if given.token_variable else {})
        told = lambda counts: print(json.dumps(counts))
        for feed in given.live:
            if feed == "pages":
                run = live.stream_pages(spark, store, client, f"{given.checkpoint}/pages", live.page_options(**more), told)
            else:
                run = live.stream_events(spark, store, client, f"{given.checkpoint}/events", live.event_options(calendar.since(None, now), **more), told)
            run.awaitTermination()
        if given.pages:
            last = cursor.load(spark, given.cursor) if given.cursor else None
            rows = pages.fetch(spark.read.schema(pages.PAGE).json(given.pages), spark.read.schema("parent string, pos int, raw string").json(given.blocks), last)
            told(ingest_batch(store, pages.as_episodes(rows), client))
            if given.cursor:
                cursor.commit(spark, given.cursor, now.isoformat())
        if given.events:
            rows = calendar.fetch(spark.read.schema(calendar.EVENT).json(given.events), dt.datetime.now(dt.UTC))
            told(ingest_batch(store, calendar.as_episodes(rows), client))
    elif given.command == "compact":
        for name in TABLES:
            store.compact(name)
        store.answers().fold(spark)
    elif given.command == "consolidate":
        graph = store.graph()
        print(json.dumps({"nodes": graph.entities.count(), "edges": graph.edges.count(), "pending": pending(graph.entities).count()}))
        done = consolidate_all(store, client, unresolved_path=given.unresolved)
        print(json.dumps({k: v for k, v in done.items() if k != "episodic_only"}))
    elif given.command == "ask":
        print(json.dumps(service.answer(store.graph(), given.question, client)))
    else:
        for row in service.entities(store.graph(), given.question).select(F.to_json(F.struct("*"))).toLocalIterator():
            print(row[0])


if __name__ == "__main__":
    main()

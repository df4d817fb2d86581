"""JSON drops to a store by Structured Streaming: each micro-batch is one set-based ingestion.

The checkpoint holds the feed's position and is committed after a batch is written; a batch that runs twice finds its
source ids in the store and adds nothing. Rows without a source id are known by their batch and what they say.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kairograph.clients import Client, ask
from kairograph.operators.ingest import new_episodes, write
from kairograph.operators.settle import settle
from kairograph.operators.store import Store
from kairograph.schema import EXTRACTION


def ingest_batch(store: Store, incoming: DataFrame, client: Client, batch: str | None = None) -> dict[str, int]:
    """incoming: source_id, source_type, text, reference_time, metadata. Counts what was fetched, ingested and skipped.

    batch names what may run twice, such as a stream's batch; without it, rows without a source id are always new.
    """
    said = [F.lit(batch or uuid.uuid4().hex), F.coalesce("text", F.lit("")), F.col("reference_time").cast("string"), "source_type"]
    again = F.row_number().over(Window.partitionBy("text", "reference_time", "source_type", "source_id").orderBy("metadata"))
    own = F.when(F.col("source_id").isNull(), F.sha2(F.concat_ws("\x1f", *said, again.cast("string")), 256))
    incoming = settle(incoming.withColumn("__own", own).withColumn("__k", F.xxhash64("source_id", "text")))
    numbered = settle(incoming.orderBy("reference_time", "source_id", "__k").withColumn("seq", F.monotonically_increasing_id() + store.top_seq("episodes") + 1).drop("__k"))
    fetched = numbered.count()
    graph = store.graph()
    named = new_episodes(numbered, graph).withColumn("id", F.concat(F.lit("ep_"), F.sha2(F.concat_ws("\x1f", F.coalesce("source_id", "__own"), "source_type"), 256))).drop("__own")
    fresh = settle(named.join(graph.episodes.select("id"), "id", "left_anti"))
    ingested = fresh.count()
    if ingested:
        asked = ask(fresh.select(F.col("id").alias("episode_id"), "seq", "reference_time", "text"), client, "extract", EXTRACTION, answers=store.answers())
        write(store, fresh.withColumn("ingested_at", F.current_timestamp()), asked)
    return {"fetched": fetched, "ingested": ingested, "skipped": fetched - ingested}


def stream(spark: SparkSession, drops: str, schema: str, as_episodes: Callable[[DataFrame], DataFrame], store: Store, client: Client, checkpoint: str) -> StreamingQuery:
    """Read all JSON files that are in `drops` and not yet in the checkpoint, then stop."""

    def batch(rows: DataFrame, number: int) -> None:
        ingest_batch(store, as_episodes(rows), client, f"{checkpoint}/{number}")

    source = spark.readStream.schema(schema).json(drops)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

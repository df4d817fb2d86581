"""The nested blocks of pages, asked for by waves.

A wave is a table of parents, dealt over partitions by a hash; each partition asks for its parents' children, page by
page, and goes on itself with up to FOLLOWED of the children that have children, so that a deep chain takes few waves.
Those left over are the next wave's parents. A wave is settled in the shared folder before the next, so that neither a
lost executor nor a later read asks again for what has been answered, and each parent is asked for once.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.operators.settle import settle
from kairograph.sources.feed import items

BLOCKS = "parent string, pos int, raw string, id string, inner boolean, level int"
#: Requests of a partition beyond its own parents in one wave, at most.
FOLLOWED = 200
#: Blocks that are handed to Spark at once, and those of one more parent at most.
ROWS = 500


def children(parents: DataFrame, options: dict) -> DataFrame:
    """BLOCKS of the children of parents (id, level), and of some below: inner are those with children yet to be asked for,
    pos counts over all pages of an answer. options["url"] has {id} in it."""

    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, rows = FOLLOWED, []
        for batch in batches:
            asked = deque(zip(batch["id"], batch["level"], strict=True))
            while asked:
                parent, level = asked.popleft()
                below = []
                for pos, item in enumerate(items(options, options["url"].format(id=parent))):
                    id, inner = item.get("id"), bool(item.get("has_children"))
                    if inner and id is not None and left:
                        left, inner = left - 1, False
                        below.append((id, level + 1))
                    rows.append((parent, pos, json.dumps(item), id, inner, level + 1))
                asked.extendleft(reversed(below))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return parents.select("id", "level").mapInPandas(run, BLOCKS)


def fetch_blocks(pages: DataFrame, options: dict, calls: int = 8, levels: int = 1000) -> DataFrame:
    """(parent, pos, raw) of all blocks below pages (id), as pages.page_texts takes them; `calls` requests at a time at most."""
    wave = settle(pages.where(F.col("id").isNotNull()).select("id", F.lit(0).alias("level")).distinct())
    found = None
    while True:
        got = settle(children(wave.repartition(calls, "id").sortWithinPartitions("id"), options))
        found = got if found is None else found.union(got)
        wave = got.where("inner and id is not null").groupBy("id").agg(F.max("level").alias("level"))
        if not got.where(F.col("level") + F.expr("int(inner and id is not null)") > levels).isEmpty():
            raise RuntimeError(f"blocks nest over {levels} levels")
        if wave.isEmpty():
            return found.dropDuplicates(["parent", "pos"]).select("parent", "pos", "raw")  # two partitions may follow one child

"""Prompts in parts: an entity's episodes as numbered lines, cut into rows of a bounded size, and answers put together.

Running sums of line lengths say where parts begin. They come from one sort of all lines by entity and time, a sum within
each partition and one offset a partition, so no task gets an entity whole, however often it is mentioned. A part holds the
lines that begin within half the bound, and no line is longer than the other half: a longer one is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.operators.settle import settle

#: Characters of a part's text at most.
MOST = 100_000


def running(rows: DataFrame, key: str, order: list[str], sizes: dict[str, str]) -> DataFrame:
    """rows with, for each new name in sizes, the sum of that column over the key's rows before this one by order."""
    at = F.monotonically_increasing_id()
    placed = settle(rows.orderBy(key, *order).withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at))
    whole = placed.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sizes.items()]).orderBy("__part").collect()  # a row a partition
    ahead, before = dict.fromkeys(sizes, 0), []
    for r in whole:
        before.append((r["__part"], *ahead.values()))
        ahead = {n: v + r[n] for n, v in ahead.items()}
    offsets = rows.sparkSession.createDataFrame(before, "__part long, " + ", ".join(f"__{n} long" for n in sizes))
    earlier = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sizes.items()}).join(F.broadcast(offsets), "__part")
    summed = summed.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sizes}).drop(*[f"__{n}" for n in sizes])
    firsts = summed.groupBy(key).agg(*[F.min(n).alias(f"__{n}") for n in sizes])
    return summed.join(firsts, key).withColumns({n: F.col(n) - F.col(f"__{n}") for n in sizes}).drop("__part", "__at", *[f"__{n}" for n in sizes])


def texts_in_parts(mentioned: DataFrame, most: int = MOST) -> DataFrame:
    """(entity_id, part, episodes): texts of lookup.episodes_of() as numbered lines, oldest first, `most` characters a row at most."""
    half = max(most // 2, 2)
    texts = settle(mentioned.select("entity_id", "reference_time", "seq", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("one")))  # the sort reads it twice
    if texts.isEmpty():
        return texts.select("entity_id", F.lit(0).cast("long").alias("part"), F.col("text").alias("episodes"))
    numbered = running(texts, "entity_id", ["reference_time", "seq"], {"i": "one"})
    lines = numbered.select("entity_id", "i", F.concat(F.lit("\n"), (F.col("i") + 1).cast("string"), F.lit('. "'), "text", F.lit('"')).alias("line"))
    cut = lines.select("entity_id", "i", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"cast((length(line) - 1) div {half} as int)")), lambda k: F.substring(F.col("line"), k * half + 1, F.lit(half)))).alias("k", "piece"))
    cut = running(cut.withColumn("size", F.length("piece")), "entity_id", ["i", "k"], {"start": "size"}).withColumn("part", F.expr(f"start div {half}"))
    gathered = F.array_sort(F.collect_list(F.struct("i", "k", "piece")))  # the pieces of a part, which is bounded
    return cut.groupBy("entity_id", "part").agg(F.regexp_replace(F.array_join(F.transform(gathered, lambda x: x["piece"]), ""), "^\n", "").alias("episodes"))

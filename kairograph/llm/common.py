"""Shared helpers of the training-data operators: table access, durable cuts, per-row Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a table of hot keys at most, so that it may be broadcast whatever the data.
HOT_KEYS = 1 << 18


#: Of the rows that Spark hands to Python at once: with long texts its own bounds would be hundreds of megabytes.
BATCH_BYTES = 6 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches in bytes to BATCH_BYTES, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be any URI that Spark's readers open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if Spark is a single
    process, and an error on a cluster, whose machines would each write to a folder of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kairograph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cut the lineage of df by a table written to the shared folder (with the writer's options) and read back.

    A lost executor cannot lose it, and each later reader starts from the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._kairograph_path = path  # noqa: SLF001  read by forget()
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the files of a durable() table that no later plan reads."""
    path = getattr(df, "_kairograph_path", None)
    if path:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def hot_keys(df: DataFrame, keys: list[str], total: int, most: int, rows: Column | None = None) -> DataFrame:
    """(keys, parts): the keys of over `most` rows among the `total` rows of df, and how many parts keep one below that.

    `most` is raised to total / HOT_KEYS, so there are at most HOT_KEYS such keys. `rows`: how many rows a row stands for.
    """
    least = max(most, -(-total // HOT_KEYS))
    counted = df.groupBy(*keys).agg((F.count("*") if rows is None else F.sum(rows)).alias("__n")).where(F.col("__n") > least)
    return counted.select(*keys, F.ceil(F.col("__n") / least).cast("int").alias("parts"))


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, spread: list[str], how: str = "inner", extra: list[str] | None = None) -> DataFrame:
    """many joined with one (few rows a key) by the keys and the extra columns, so that no task gets a hot key whole.

    hot is of hot_keys(). A hot key's rows in many are dealt by a hash of `spread`; its rows in one go to every part.
    """
    hot = F.broadcast(hot)
    dealt = many.join(hot, keys, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    repeated = one.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(repeated.hint("merge"), [*keys, *(extra or []), "__part"], how).drop("__part")


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo mod; null ids give null."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % mod


def held_out(col: Column, mod: int) -> Column:
    """Whether the remainder is 0; a null id is never held out, nor ever learnt from."""
    return F.coalesce(crc_mod(col, mod) == 0, F.lit(False))


def hashed_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The first `rows` rows of df by a hash of the keys.

    A top-k alone would send that many rows of every task to the driver; so a filter first keeps the hashes below a
    cut that leaves about half as many rows again as are wanted, whatever the number of tasks.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    total = df.count()
    if total > rows:
        df = df.where(place < min(1 << 40, int((1 << 40) * (1.5 * rows + 100) / total)))
    return df.orderBy(place, *keys).limit(rows)


def give_back() -> None:
    """Return what the allocators hold free; Python workers live on after a task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Map each Arrow batch by fn; Spark bounds a batch in rows and bytes, so a task's memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)

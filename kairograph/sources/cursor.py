"""How far a feed has been read: one JSON file, written after the rows are."""

from __future__ import annotations

from pyspark.sql import SparkSession


def load(spark: SparkSession, path: str) -> str | None:
    """The moment of the last committed read as ISO text; None at first."""
    if not _path(spark, path)[1].exists(_path(spark, path)[0]):
        return None
    row = spark.read.schema("last_fetched string").json(path).first()
    return row[0] if row else None


def commit(spark: SparkSession, path: str, moment: str) -> None:
    """To be called once the batch is stored: a crash before leads to a repeated read, which ingestion skips."""
    spark.createDataFrame([(moment,)], "last_fetched string").coalesce(1).write.mode("overwrite").json(path)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

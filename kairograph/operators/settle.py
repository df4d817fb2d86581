"""Cutting the lineage of iterative plans by files in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """df, computed once into the checkpoint folder; a lost executor loses nothing of it."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """df, computed once into Parquet files of the shared folder; unlike a settled table it may be joined with itself."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/filed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, if Spark is a single process, and else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kairograph-")
    return found.rstrip("/")

"""A model's answers, kept: a prompt that has been answered is not asked again, by whichever task or run.

A task writes each answer, as it comes, to a file named by the prompt's key in a folder that all executors share; a task
that runs again, after a lost executor or a failure, reads it there. fold() moves these files into one Parquet table,
which later calls join by key. Files are written aside and renamed, so that a half-written answer is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUT = "\x1f"


def key_of(task: str, model: str, values: list[str]) -> str:
    return hashlib.sha256(CUT.join([task, model, *values]).encode()).hexdigest()


def key_column(task: str, model: str, values: list[Column]) -> Column:
    """key_of() as a Column."""
    return F.sha2(F.concat_ws(CUT, F.lit(task), F.lit(model), *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), 256)


@dataclass(frozen=True)
class Answers:
    """path: a folder that executors share and pyarrow's file systems open. calls: how many may be under way at a time."""

    path: str
    calls: int = 8

    def _open(self):
        import pyarrow.fs as fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system, f"{root.rstrip('/')}/journal"

    def get(self, key: str) -> str | None:
        import pyarrow.fs as fs

        system, root = self._open()
        where = f"{root}/{key[:2]}/{key}.json"
        if system.get_file_info(where).type != fs.FileType.File:
            return None
        with system.open_input_stream(where) as file:
            return json.loads(file.read())["raw"]

    def put(self, key: str, raw: str) -> None:
        system, root = self._open()
        draft = f"{root}/{key[:2]}/_{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{key[:2]}", recursive=True)
        with system.open_output_stream(draft) as file:
            file.write(json.dumps({"key": key, "raw": raw}).encode())
        system.move(draft, f"{root}/{key[:2]}/{key}.json")

    def _has(self, spark: SparkSession, where: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(where)  # noqa: SLF001
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
        return fs, path, fs.exists(path)

    def table(self, spark: SparkSession) -> DataFrame | None:
        """(key, raw) of the folded answers, a key once."""
        where = f"{self.path}/table"
        return spark.read.schema("key string, raw string").parquet(where).dropDuplicates(["key"]) if self._has(spark, where)[2] else None

    def fold(self, spark: SparkSession) -> int:
        """Move the journal into the table. A crash in between leaves answers in both, which is no harm. No call may be under way."""
        fs, path, there = self._has(spark, f"{self.path}/journal")
        if not there:
            return 0
        rows = spark.read.schema("key string, raw string").option("recursiveFileLookup", "true").json(f"{self.path}/journal")
        n = rows.count()
        if n:
            rows.coalesce(max(1, n // 100_000)).write.mode("append").parquet(f"{self.path}/table")
        fs.delete(path, True)
        return n

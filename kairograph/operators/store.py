"""A graph in append-only Parquet logs.

Every write appends rows with a higher seq; the latest row of an id is its state, so the logs are also the history of
what was known when. An edge's id, ends and relation never change and are what its versions are grouped by, so a filter on
them reaches the files: these are in partitions by relation and sorted by source, so that a lookup by source reads few row
groups of few files. Whether an edge is open changes from version to version, so it can be no part of the layout. Checks and appends of a batch are one plan: invalid rows are returned, not raised, but for
the single-row calls, which raise as a caller of one row expects.

compact() rewrites a log, with all its versions, into a few sorted files; edges twice, by source and by target, so that
lookups from either end prune. A manifest names the new files and those of the log that they replace, and its rename is
the commit: a crash before leaves files that nothing names, and what is written meanwhile is in files that no manifest
names as replaced. Replaced files go with the next compact(), so that readers may finish. One writer at a time numbers
rows; one compact() at a time commits, a second one fails.

Every version has the time of its writing, in the files only: graph(as_of) reads what was known at a moment, whatever
was written since, beside the valid time that facts have themselves.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.functions.temporal import utc
from kairograph.operators.answers import Answers
from kairograph.operators.lookup import Graph, exists
from kairograph.operators.settle import settle
from kairograph.schema import TABLES

PATCHABLE = {
    "entities": {"type", "name", "summary", "consolidated", "consolidation_run_id"},
    "episodes": {"text", "source_type", "source_id", "reference_time", "metadata"},
}


#: Columns that no later version of a row changes.
FIXED = ("id", "source", "target", "relation")
#: When a version was written. Files without it were written before all others.
RECORDED = "recorded_at"
#: What the compacted copies of a log are sorted by; the first is read unless another is asked for.
COPIES = {"entities": ("id",), "edges": ("source", "target"), "episodes": ("id",)}


def latest(log: DataFrame) -> DataFrame:
    """The row of the highest seq for each id, with the first version's seq as its place in order.

    Each column is an aggregate of its own, so that those a reader leaves out are neither shuffled nor sorted.
    """
    fixed = [c for c in FIXED if c in log.columns]
    rest = [F.max_by(c, "seq").alias(c) for c in log.columns if c != "seq" and c not in fixed]
    return log.groupBy(*fixed).agg(*rest, F.min("seq").alias("__seq")).select(*[F.col("__seq").alias("seq") if c == "seq" else c for c in log.columns])


def edge_id(*more: Column) -> Column:
    """A deterministic id from an edge's key and what else tells versions apart."""
    return F.sha2(F.concat_ws("\x1f", "source", "relation", "target", *more), 256)


def accept_edges(new: DataFrame, graph: Graph, relations: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): edges between known nodes whose (source, target, relation) isn't open yet, the first of each.

    new has source, target, relation and seq; rejected adds a reason. relations, if given, must name all that new has:
    versions of edges of others are then not gone through.
    """
    key = ["source", "target", "relation"]
    ids = graph.ids().distinct()
    held = graph.open_edges() if relations is None else graph.open_edges().where(F.col("relation").isin(*relations))
    marked = (
        new.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("__s")), "source", "left")
        .join(ids.select(F.col("id").alias("target"), F.lit(True).alias("__t")), "target", "left")
        .join(held.select(*key).distinct().withColumn("__o", F.lit(True)), key, "left")
    )
    reason = F.when(F.col("__s").isNull() | F.col("__t").isNull(), "missing node").when(F.col("__o"), "already open")
    marked = marked.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy(*key, F.col("reason").isNull()).orderBy("seq"))
    marked = marked.withColumn("reason", F.coalesce("reason", F.when(place > 1, "already open"))).drop("__s", "__t", "__o")
    return marked.where("reason is null").select(*new.columns), marked.where("reason is not null").select(*new.columns, "reason")


class Store:
    """The three logs under one path, which any Spark file system may hold."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], dt.datetime] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC))

    def log(self, name: str, by: str | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """All versions, or those written up to as_of; the compacted ones from the copy sorted by `by`."""
        schema, where = f"{TABLES[name]}, {RECORDED} timestamp", f"{self.path}/{name}"
        _, manifest = self._manifest(name)
        parts = []
        if manifest:
            parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/compact/{name}/{manifest['folder']}/{by or COPIES[name][0]}"))
            if files := sorted(set(self._files(where)) - set(manifest["replaced"])):
                parts.append(self.spark.read.schema(schema).option("basePath", where).parquet(*[f"{where}/{f}" for f in files]))
        elif self._has(where):
            parts.append(self.spark.read.schema(schema).parquet(where))
        fields = [f.split()[0] for f in TABLES[name].split(", ")]
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        rows = parts[0].select(*fields, RECORDED)
        for more in parts[1:]:
            rows = rows.unionByName(more.select(*fields, RECORDED))
        return (rows if as_of is None else rows.where(F.col(RECORDED).isNull() | (F.col(RECORDED) <= utc(as_of)))).drop(RECORDED)

    def graph(self, as_of: dt.datetime | None = None) -> Graph:
        """The latest versions, or those that were the latest at the moment as_of."""
        by_target = latest(self.log("edges", "target", as_of)) if self._manifest("edges")[1] else None
        return Graph(*(latest(self.log(n, as_of=as_of)) for n in ("entities", "edges", "episodes")), by_target)

    def compact(self, name: str) -> None:
        """Rewrite all versions of a log in few files for each of its copies, and delete what the compaction before replaced."""
        number, before = self._manifest(name)
        where, files = f"{self.path}/{name}", self._files(f"{self.path}/{name}")
        if not files and not before:
            return
        schema, folder = f"{TABLES[name]}, {RECORDED} timestamp", uuid.uuid4().hex
        old = set(before["replaced"]) if before else set()
        parts = [self.spark.read.schema(schema).option("basePath", where).parquet(*[f"{where}/{f}" for f in files if f not in old])] if set(files) - old else []
        if before:
            parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/compact/{name}/{before['folder']}/{COPIES[name][0]}"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        for copy in COPIES[name]:
            keys = [*(["relation"] if name == "edges" else []), copy]
            out = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "seq").write.option("compression", "zstd")
            (out.partitionBy("relation") if name == "edges" else out).parquet(f"{self.path}/compact/{name}/{folder}/{copy}")
        self._commit(name, number + 1, {"folder": folder, "replaced": sorted(set(files))})
        for gone in [f"{where}/{f}" for f in old] + ([f"{self.path}/compact/{name}/{before['gone']}"] if before and before.get("gone") else []):
            self._delete(gone)

    def _manifest(self, name: str) -> tuple[int, dict | None]:
        """The number of the newest manifest and what it says: folder, replaced files, gone (the folder before)."""
        numbers = [int(f.removesuffix(".json")) for f in self._files(f"{self.path}/manifests/{name}", deep=False) if f.endswith(".json")]
        if not numbers:
            return 0, None
        text = self.spark.read.text(f"{self.path}/manifests/{name}/{max(numbers)}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _commit(self, name: str, number: int, said: dict) -> None:
        _, before = self._manifest(name)
        said["gone"] = before["folder"] if before else None
        fs, path = self._fs(f"{self.path}/manifests/{name}/{number}.json")
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{name}/{uuid.uuid4().hex}.draft")  # noqa: SLF001
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(said).encode()))
        stream.close()
        if fs.exists(path) or not fs.rename(draft, path):
            raise RuntimeError(f"another compaction of {name} has been committed")

    def _files(self, where: str, deep: bool = True) -> list[str]:
        """Data files under a folder, as paths from there on; none if it doesn't exist."""
        fs, path = self._fs(where)
        if not fs.exists(path):
            return []
        root, found, at = f"{fs.makeQualified(path).toUri().getPath().rstrip('/')}/", [], fs.listFiles(path, deep)
        while at.hasNext():
            inner = at.next().getPath().toUri().getPath().removeprefix(root)
            if not any(x[0] in "_." for x in inner.split("/")):
                found.append(inner)
        return found

    def _delete(self, where: str) -> None:
        fs, path = self._fs(where)
        fs.delete(path, True)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)  # noqa: SLF001
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path  # noqa: SLF001

    def answers(self) -> Answers:
        """What models have answered for this store."""
        return Answers(f"{self.path}/answers")

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows without seq are numbered after the highest in the log, in the order of their __order, if they have it."""
        fields = [f.split()[0] for f in TABLES[name].replace(" not null", "").split(", ")]
        if "seq" not in rows.columns:
            rows = self._numbered(name, rows)
        for field, kind in (f.split()[:2] for f in TABLES[name].replace(" not null", "").split(", ")):
            if field not in rows.columns:
                rows = rows.withColumn(field, F.lit(None).cast(kind))
        out = rows.select(*fields, utc(self.clock()).alias(RECORDED))
        if name == "edges":
            out.sortWithinPartitions("relation", "source").write.option("compression", "zstd").mode("append").partitionBy("relation").parquet(f"{self.path}/{name}")
        else:
            out.sortWithinPartitions("id").write.option("compression", "zstd").mode("append").parquet(f"{self.path}/{name}")

    def top_seq(self, name: str) -> int:
        return self.log(name).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def _numbered(self, name: str, rows: DataFrame) -> DataFrame:
        rows = settle(rows)  # so that numbers given twice are the same
        if "__order" in rows.columns:
            rows = rows.repartitionByRange("__order").sortWithinPartitions("__order")
        return rows.withColumn("seq", F.monotonically_increasing_id() + self.top_seq(name) + 1).drop("__order")

    def _has(self, where: str) -> bool:
        fs, path = self._fs(where)
        return fs.exists(path)

    def _row(self, log: str, /, **values) -> None:
        typed = dict(f.split()[:2] for f in TABLES[log].replace(" not null", "").split(", "))
        row = self.spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).cast(typed[k]).alias(k) for k, v in values.items()])
        self.append(log, row)

    # single writes

    def add_node(self, id: str, type: str, name: str) -> None:
        if exists(self.graph(), id):
            raise ValueError(f"a node with the id {id} exists")
        self._row("entities", id=id, type=type, name=name, consolidated=False, created_at=_now())

    def add_edge(self, source: str, target: str, relation: str, fact: str, valid_from) -> str | None:
        """The new edge's id; None, and nothing stored, if an end is missing."""
        graph = self.graph()
        same = (F.col("source") == source) & (F.col("target") == target) & (F.col("relation") == relation)
        if not graph.open_edges().where(same).isEmpty():
            raise ValueError(f"the edge {source} {relation} {target} is open already")
        if not (exists(graph, source) and exists(graph, target)):
            return None
        seq = self.top_seq("edges") + 1
        id = self.spark.range(1).select(F.lit(source).alias("source"), F.lit(relation).alias("relation"), F.lit(target).alias("target")).select(edge_id(F.lit(str(seq)))).first()[0]
        self._row("edges", id=id, source=source, target=target, relation=relation, fact=fact, valid_from=utc(valid_from), confidence=1.0, ingested_at=_now())
        return id

    def add_episode(self, id: str, text: str, reference_time, source_type: str | None = None, source_id: str | None = None, metadata: dict | None = None) -> str:
        self._row(
            "episodes", id=id, text=text, source_type=source_type, source_id=source_id, reference_time=utc(reference_time),
            ingested_at=_now(), metadata=json.dumps(metadata) if metadata else None,
        )
        return id

    def close_edge(self, id: str, moment) -> None:
        edge = self.graph().edges.where(F.col("id") == id)
        if edge.isEmpty():
            raise ValueError(f"no edge has the id {id}")
        self.append("edges", edge.drop("seq").withColumn("valid_until", utc(moment)))

    def close_edges(self, closes: DataFrame) -> None:
        """closes (id, valid_until): a batch of closes; unknown ids are ignored."""
        log = self.log("edges")
        closed = latest(log.join(closes.select("id"), "id", "left_semi").select(*log.columns))  # only these edges' versions are gathered
        self.append("edges", closed.drop("seq", "valid_until").join(closes, "id"))

    def patch(self, name: str, id: str, /, **values) -> None:
        """Set properties of an entity or episode; nothing happens if it is missing. Dicts become JSON."""
        if unknown := set(values) - PATCHABLE[name]:
            raise ValueError(f"can't be set: {', '.join(sorted(unknown))}")
        rows = getattr(self.graph(), name).where(F.col("id") == id).drop("seq")
        for key, value in values.items():
            if isinstance(value, dt.datetime):
                value = utc(value)
            elif isinstance(value, dict):
                value = json.dumps(value)
            rows = rows.withColumn(key, (value if isinstance(value, Column) else F.lit(value)).cast(rows.schema[key].dataType))
        self.append(name, rows)

    def patch_many(self, name: str, changes: DataFrame) -> None:
        """changes (id, some columns): a batch of patches; columns are replaced."""
        cols = [c for c in changes.columns if c != "id"]
        if unknown := set(cols) - PATCHABLE[name]:
            raise ValueError(f"can't be set: {', '.join(sorted(unknown))}")
        self.append(name, getattr(self.graph(), name).drop("seq", *cols).join(changes, "id"))


def _now() -> Column:
    return utc(dt.datetime.now(dt.UTC))

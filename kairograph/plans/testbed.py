"""A graph from the driver's star schema, the same in Spark and in SQL.

Regions are concepts, nations teams, customers and users persons, suppliers services, parts tools; documents and
conversation turns are episodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.operators.lookup import Graph, first_per
from kairograph.schema import EDGES, ENTITIES, EPISODES

NOW = "2024-02-01T00:00:00"
BLOCK = 10**17  # seq of one kind of row starts after the other's
PARTS = 10**7  # more than there are parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    fields = [f.split()[:2] for f in schema.replace(" not null", "").split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(no: int, rows: DataFrame, prefix: str, key: str, name: str, type: str) -> DataFrame:
        return rows.select(
            F.concat(F.lit(f"{prefix}_"), F.col(key)).alias("id"), F.lit(type).alias("type"), F.col(name).cast("string").alias("name"),
            (F.lit(no * BLOCK) + F.col(key)).cast("long").alias("seq"),
        )

    def read(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    users = read("events").select("user_id").distinct().withColumn("name", F.concat(F.lit("User "), F.col("user_id")))
    types = read("events").where("event_type is not null").groupBy("event_type").agg(F.min("event_id").alias("e")).select(
        F.concat(F.lit("event_"), F.col("event_type")).alias("id"), F.lit("concept").alias("type"), F.col("event_type").alias("name"), (F.lit(6 * BLOCK) + F.col("e")).alias("seq")
    )
    rows = kind(0, read("region"), "region", "r_regionkey", "r_name", "concept")
    for part in (
        kind(1, read("nation"), "nation", "n_nationkey", "n_name", "team"),
        kind(2, read("customer"), "customer", "c_custkey", "c_name", "person"),
        kind(3, read("supplier"), "supplier", "s_suppkey", "s_name", "service"),
        kind(4, read("part"), "part", "p_partkey", "p_name", "tool"),
        kind(5, users, "user", "user_id", "name", "person"),
        types,
    ):
        rows = rows.union(part)
    return _shaped(rows.withColumn("consolidated", F.col("seq") % 3 == 0), ENTITIES)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.unix_micros(F.lit("2020-01-01 00:00:00").cast("timestamp"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), "text", F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("source_id"),
        F.timestamp_micros(base + F.col("doc_id") * 60_000_000).alias("reference_time"), F.col("doc_id").alias("seq"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", F.lit("conv"), "conv_id", "turn").alias("id"), "text", F.lit("conversation").alias("source_type"), F.concat_ws("/", "conv_id", "turn").alias("source_id"),
        F.timestamp_micros(base + (F.col("conv_id") * 100 + F.col("turn")) * 60_000_000).alias("reference_time"), (F.lit(BLOCK) + F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )
    return _shaped(docs.union(turns), EPISODES)


def _edge(no: int, rows: DataFrame, relation: str, source, target, seq, valid_from, valid_until=None) -> DataFrame:
    out = rows.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), valid_from.cast("timestamp").alias("valid_from"), (F.lit(None) if valid_until is None else valid_until).cast("timestamp").alias("valid_until"), (F.lit(no * BLOCK) + seq).cast("long").alias("seq"))
    return out.withColumn("id", F.concat_ws(":", "relation", "source", "target", F.col("seq").cast("string"))).withColumn("fact", F.concat_ws(" ", "source", F.lower("relation"), "target"))


def _named(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}_"), F.col(key))


def raw_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, part, seq, start, close of each line of an order; returned ones close after as many days as pieces."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    close = F.when(F.col("l_returnflag") == "R", F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("l_quantity") * 86_400_000_000).cast("long")))
    lines = joined.select("o_custkey", "l_partkey", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * PARTS + F.col("l_partkey")).alias("k"), F.col("o_orderdate").cast("timestamp").alias("start"), close.alias("close"))
    return lines.groupBy("o_custkey", "l_partkey", "k").agg(F.min("start").alias("start"), F.min("close").alias("close"))  # line numbers repeat


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    founded = F.lit("1992-01-01 00:00:00").cast("timestamp")
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    owns = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("first"))
    uses = raw_uses(spark, sf_dir)
    uses = uses.where("close is not null").unionByName(first_per(uses.where("close is null"), ["o_custkey", "l_partkey"], "k"))
    parts = table(spark, sf_dir, "part").where("p_partkey >= 1").select("p_partkey", F.expr("p_partkey div 2").alias("below"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    found = [
        _edge(0, nation, "MEMBER_OF", _named("nation", "n_nationkey"), _named("region", "n_regionkey"), F.col("n_nationkey"), founded),
        _edge(1, customer, "MEMBER_OF", _named("customer", "c_custkey"), _named("nation", "c_nationkey"), F.col("c_custkey"), founded),
        _edge(2, supplier, "MEMBER_OF", _named("supplier", "s_suppkey"), _named("nation", "s_nationkey"), F.col("s_suppkey"), founded),
        _edge(3, owns, "OWNS", _named("supplier", "l_suppkey"), _named("part", "l_partkey"), F.col("l_suppkey") * 10_000_000 + F.col("l_partkey"), F.col("first")),
        _edge(4, uses, "USES", _named("customer", "o_custkey"), _named("part", "l_partkey"), F.col("k"), F.col("start"), F.col("close")),
        _edge(5, parts, "DEPENDS_ON", _named("part", "p_partkey"), _named("part", "below"), F.col("p_partkey"), founded),
        _edge(6, errors, "REPORTED", _named("user", "user_id"), _named("event", "event_type"), F.col("user_id"), F.col("first")),
        _edge(7, docs, "MENTIONED_IN", F.concat(F.lit("nation_"), F.col("doc_id") % 25), _named("doc", "doc_id"), F.col("doc_id"), F.lit("2020-01-01 00:00:00")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return _shaped(out.withColumn("confidence", F.lit(1.0)), EDGES)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(entities(spark, sf_dir), edges(spark, sf_dir), episodes(spark, sf_dir))


#: The same graph for DuckDB, as the start of a WITH clause.
SQL = """
entities as (
  select 'region_' || r_regionkey as id, 'concept' as type, r_name as name, r_regionkey::bigint as seq from region
  union all select 'nation_' || n_nationkey, 'team', n_name, 100000000000000000 + n_nationkey from nation
  union all select 'customer_' || c_custkey, 'person', c_name, 200000000000000000 + c_custkey from customer
  union all select 'supplier_' || s_suppkey, 'service', s_name, 300000000000000000 + s_suppkey from supplier
  union all select 'part_' || p_partkey, 'tool', p_name, 400000000000000000 + p_partkey from part
  union all select distinct 'user_' || user_id, 'person', 'User ' || user_id, 500000000000000000 + user_id from events
  union all select 'event_' || event_type, 'concept', event_type, 600000000000000000 + min(event_id) from events where event_type is not null group by event_type
), episodes as (
  select 'doc_' || doc_id as id, text, 'document' as source_type, doc_id::varchar as source_id,
    timestamp '2020-01-01 00:00:00' + to_minutes(doc_id) as reference_time, doc_id::bigint as seq from documents
  union all select 'conv_' || conv_id || '_' || turn, text, 'conversation', conv_id || '/' || turn,
    timestamp '2020-01-01 00:00:00' + to_minutes(conv_id * 100 + turn), 100000000000000000 + conv_id * 1000 + turn from conversations
), raw_uses as (
  select o_custkey, l_partkey, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey as k, min(o_orderdate::timestamp) as start,
    min(case when l_returnflag = 'R' then o_orderdate::timestamp + to_days(l_quantity::integer) end) as close
  from lineitem join orders on l_orderkey = o_orderkey group by all
), kept_uses as (
  select * from raw_uses where close is not null
  union all select * from raw_uses where close is null qualify row_number() over (partition by o_custkey, l_partkey order by k) = 1
), edges_ as (
  select 'nation_' || n_nationkey as source, 'region_' || n_regionkey as target, 'MEMBER_OF' as relation, timestamp '1992-01-01' as valid_from, null::timestamp as valid_until, n_nationkey::bigint as seq from nation
  union all select 'customer_' || c_custkey, 'nation_' || c_nationkey, 'MEMBER_OF', timestamp '1992-01-01', null, 100000000000000000 + c_custkey from customer
  union all select 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'MEMBER_OF', timestamp '1992-01-01', null, 200000000000000000 + s_suppkey from supplier
  union all select 'supplier_' || l_suppkey, 'part_' || l_partkey, 'OWNS', min(l_shipdate)::timestamp, null, 300000000000000000 + l_suppkey * 10000000 + l_partkey from lineitem group by l_suppkey, l_partkey
  union all select 'customer_' || o_custkey, 'part_' || l_partkey, 'USES', start, close, 400000000000000000 + k from kept_uses
  union all select 'part_' || p_partkey, 'part_' || (p_partkey // 2), 'DEPENDS_ON', timestamp '1992-01-01', null, 500000000000000000 + p_partkey from part where p_partkey >= 1
  union all select 'user_' || user_id, 'event_' || event_type, 'REPORTED', min(ts)::timestamp, null, 600000000000000000 + user_id from events where event_type = 'error' group by user_id, event_type
  union all select 'nation_' || (doc_id % 25), 'doc_' || doc_id, 'MENTIONED_IN', timestamp '2020-01-01', null, 700000000000000000 + doc_id from documents
), edges as (
  select relation || ':' || source || ':' || target || ':' || seq as id, source, target, relation, source || ' ' || lower(relation) || ' ' || target as fact, valid_from, valid_until, seq from edges_
)
"""

"""Registered queries over the test-bed graph, each beside its SQL for DuckDB."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.clients import RulesClient
from kairograph.functions import temporal, text
from kairograph.operators import consolidate, ingest, lookup, parts, rank, resolve, store, traverse
from kairograph.operators.lookup import Graph
from kairograph.operators.settle import shared_dir
from kairograph.plans import router, service
from kairograph.plans.testbed import NOW, SQL, graph, table
from kairograph.schema import MENTION, MENTION_FACT
from kairograph.sources import blocks, calendar, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STAMP = "yyyy-MM-dd HH:mm:ss"


def query(sql: str | None = None, name: str | None = None, graph_sql: bool = True):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = (f"with recursive {SQL} {sql}" if graph_sql else sql).strip()
        return fn

    return register


def on_graph(sql: str | None = None, name: str | None = None):
    """A query of the graph alone."""

    def register(fn):
        query(sql, name or fn.__name__)(lambda spark, sf_dir: fn(graph(spark, sf_dir)))
        return fn

    return register


def shown(edges: DataFrame, *more) -> DataFrame:
    return edges.select("id", "source", "target", "relation", F.date_format("valid_from", STAMP).alias("valid_from"), F.date_format("valid_until", STAMP).alias("valid_until"), *more)


SHOWN = "id, source, target, relation, strftime(valid_from, '%Y-%m-%d %H:%M:%S') as valid_from, strftime(valid_until, '%Y-%m-%d %H:%M:%S') as valid_until"
OPEN = "valid_until is null"


# ---------------------------------------------------------------- lookups and valid time


@on_graph("select id, type, name, seq from entities")
def entity_scan(g: Graph) -> DataFrame:
    return g.entities.select("id", "type", "name", "seq")


@on_graph(f"select {SHOWN} from edges")
def edge_scan(g: Graph) -> DataFrame:
    return shown(g.edges)


@on_graph("select id, type, name from entities where id = 'supplier_7'")
def entity_lookup(g: Graph) -> DataFrame:
    return lookup.entity(g, "supplier_7").select("id", "type", "name")


@on_graph("select id, source_type, strftime(reference_time, '%Y-%m-%d %H:%M:%S') as reference_time from episodes where id = 'doc_17'")
def episode_lookup(g: Graph) -> DataFrame:
    return lookup.episode(g, "doc_17").select("id", "source_type", F.date_format("reference_time", STAMP).alias("reference_time"))


@on_graph("select id, source_id from episodes where source_id = '42' order by seq, id limit 1")
def episode_by_source(g: Graph) -> DataFrame:
    return lookup.episode_by_source(g, "42").select("id", "source_id")


@on_graph("select v.id, v.id in (select id from entities union all select id from episodes) as known from (values ('part_3'), ('doc_3'), ('nobody')) v(id)")
def node_exists(g: Graph) -> DataFrame:
    asked = g.entities.sparkSession.createDataFrame([("part_3",), ("doc_3",), ("nobody",)], "id string")
    known = g.ids().distinct().withColumn("known", F.lit(True))
    return asked.join(known, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@on_graph(f"select {SHOWN} from edges where source = 'supplier_7' and relation = 'OWNS' and {OPEN}")
def direct_lookup_out(g: Graph) -> DataFrame:
    return shown(traverse.direct_lookup(g, "supplier_7", "OWNS"))


@on_graph(f"select {SHOWN} from edges where target = 'part_1' and relation = 'OWNS' and {OPEN}")
def direct_lookup_in(g: Graph) -> DataFrame:
    return shown(traverse.direct_lookup(g, "part_1", "OWNS", "in"))


@on_graph(f"select {SHOWN} from edges where source = 'customer_5' and {OPEN}")
def current_facts(g: Graph) -> DataFrame:
    return shown(lookup.current_facts(g, "customer_5"))


AT = "1997-06-15 00:00:00"


@on_graph(f"select {SHOWN} from edges where source = 'customer_5' and valid_from <= timestamp '{AT}' and (valid_until is null or valid_until > timestamp '{AT}')")
def facts_at(g: Graph) -> DataFrame:
    return shown(lookup.facts_at(g, "customer_5", AT))


@on_graph(
    """, asked as (select 'customer_' || c_custkey as source, m::timestamp as moment from customer, (values ('1996-01-01'), ('1998-07-01'), ('2001-01-01')) t(m))
    select strftime(moment, '%Y-%m-%d') as moment, edges.source, count(*) as facts from asked join edges on edges.source = asked.source
    and valid_from <= moment and (valid_until is null or valid_until > moment) group by all"""
)
def facts_at_bulk(g: Graph) -> DataFrame:
    people = g.entities.where("startswith(id, 'customer_')").select(F.col("id").alias("source"))
    asked = people.select("source", F.explode(F.array(*[F.lit(x).cast("timestamp") for x in ("1996-01-01", "1998-07-01", "2001-01-01")])).alias("moment"))
    return lookup.facts_at_many(g, asked).groupBy(F.date_format("moment", "yyyy-MM-dd").alias("moment"), "source").agg(F.count("*").alias("facts"))


for _direction, _near, _id in (("out", "source", "customer_5"), ("in", "target", "part_1")):
    on_graph(
        f"select {SHOWN}, row_number() over (order by edges.valid_from, seq) as rank from edges where {_near} = '{_id}' and relation = 'USES'", f"history_{_direction}"
    )(lambda g, d=_direction, i=_id: shown(rank.placed(traverse.history(g, i, "USES", d), "rank", "valid_from", "seq"), "rank"))


@on_graph(f"select relation, {OPEN} as is_open, count(*) as n from edges group by all")
def open_edges(g: Graph) -> DataFrame:
    return g.edges.groupBy("relation", temporal.is_open().alias("is_open")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- traversals

PAIRS = f"pairs as materialized (select source as n, target as m from edges where {OPEN} union all select target, source from edges where {OPEN})"
_levels = "near1(n) as (select 'region_1')"
for _depth in (1, 2, 3):
    if _depth > 1:  # one table a level: each is used more than once by the next
        _levels += f", near{_depth}(n) as materialized (select n from near{_depth - 1} union select m from pairs join near{_depth - 1} on pairs.n = near{_depth - 1}.n)"
    on_graph(
        f", {PAIRS}, {_levels} select {SHOWN} from edges where {OPEN} and (source in (select n from near{_depth}) or target in (select n from near{_depth}))", f"neighborhood_d{_depth}"
    )(lambda g, d=_depth: shown(traverse.neighbourhood(g, "region_1", d)))

for _name, _id, _near, _far in (("impact_in", "part_1", "target", "source"), ("impact_out", "part_999", "source", "target")):
    on_graph(
        f""", reached(n) as (select '{_id}' union select {_far} from edges join reached on {_near} = n where relation = 'DEPENDS_ON' and {OPEN})
        select {SHOWN} from edges where relation = 'DEPENDS_ON' and {OPEN} and {_near} in (select n from reached)""",
        _name,
    )(lambda g, i=_id, d=_name[7:]: shown(traverse.impact(g, i, "DEPENDS_ON", d)))


def _with_cycle(g: Graph) -> Graph:
    more = g.edges.where("id like 'DEPENDS_ON:part_1:part_0:%'").withColumns({"source": F.lit("part_0"), "target": F.lit("part_1"), "id": F.lit("DEPENDS_ON:part_0:part_1:back")})
    return Graph(g.entities, g.edges.unionByName(more), g.episodes)


@on_graph(
    f""", cyclic as (select id, source, target, relation, valid_until from edges union all select 'DEPENDS_ON:part_0:part_1:back', 'part_0', 'part_1', 'DEPENDS_ON', null where exists (select 1 from part where p_partkey = 1)),
    reached(n) as (select 'part_1' union select source from cyclic join reached on target = n where relation = 'DEPENDS_ON' and {OPEN})
    select id, source, target from cyclic where relation = 'DEPENDS_ON' and {OPEN} and target in (select n from reached)"""
)
def impact_cycle(g: Graph) -> DataFrame:
    return traverse.impact(_with_cycle(g), "part_1", "DEPENDS_ON", "in").select("id", "source", "target")


def _path_sql(source: str, target: str, where: str, keep: str) -> str:
    return f""", two(n, m) as (select distinct source, target from edges where {where} and source <> target union select target, source from edges where {where} and source <> target),
    away(n, d) as (select '{target}', 0 union select two.m, d + 1 from away join two on two.n = away.n where d < 8),
    dist as (select n, min(d) as d from away group by n),
    walk(n, d, path) as (select n, d, [n] from dist where n = '{source}'
      union all select dist.n, dist.d, list_append(path, dist.n) from walk join two on two.n = walk.n join dist on dist.n = two.m and dist.d = walk.d - 1),
    best as (select min(path) as path from walk where d = 0 and n = '{target}'),
    steps as (select unnest(path[:-2]) as a, unnest(path[2:]) as b from best)
    select distinct {SHOWN} from edges join steps on (source = a and target = b) or (source = b and target = a) where {OPEN} and {keep}"""


SEMANTIC = f"{OPEN} and relation <> 'MENTIONED_IN'"


@on_graph(_path_sql("customer_3", "region_0", "true", "true"))
def path_compat(g: Graph) -> DataFrame:
    return shown(traverse.shortest_path(g, "customer_3", "region_0"))


@on_graph(_path_sql("customer_3", "region_0", SEMANTIC, "relation <> 'MENTIONED_IN'"))
def path_semantic(g: Graph) -> DataFrame:
    return shown(traverse.shortest_path(g, "customer_3", "region_0", "semantic"))


@on_graph(f"select {SHOWN} from edges where false")
def path_none(g: Graph) -> DataFrame:
    return shown(traverse.shortest_path(g, "region_0", "event_error"))


# ---------------------------------------------------------------- scores

AGE = f"floor((epoch_us(timestamp '{NOW}') - epoch_us(valid_from)) / 86400000000.0)"
SCORE = f"case when valid_until < timestamp '{NOW}' then 0.0::double else 1.0::double / (1 + {AGE} / 365.0::double) end"


@on_graph(f"select id, {SCORE} as score from edges")
def score_edges(g: Graph) -> DataFrame:
    return rank.scored(g.edges, NOW).select("id", "score")


@on_graph(f", s as (select *, {SCORE} as score from edges where target = 'part_1' and relation = 'OWNS' and {OPEN}) select id, source, fact, score, row_number() over (order by score desc, seq) as rank from s where score <> 0 and relation <> 'MENTIONED_IN'")
def ranked_edges(g: Graph) -> DataFrame:
    """Who owns part 1, by recency."""
    found = rank.ranked(rank.live(rank.scored(traverse.direct_lookup(g, "part_1", "OWNS", "in"), NOW)))
    return found.select("id", "source", "fact", "score", "rank")


@on_graph(f", s as (select *, {SCORE} as score from edges) select relation, count(*) as n from s where score <> 0 and relation <> 'MENTIONED_IN' group by relation")
def expired_filter(g: Graph) -> DataFrame:
    return rank.live(rank.scored(g.edges, NOW)).groupBy("relation").agg(F.count("*").alias("n"))


@on_graph(f"select id, source, target, relation, fact, strftime(valid_from, '%Y-%m-%dT%H:%M:%S') as valid_from, strftime(valid_until, '%Y-%m-%dT%H:%M:%S') as valid_until, 1.0::double as confidence, round_even({SCORE}, 4) as score from edges where source = 'customer_5'")
def api_rows(g: Graph) -> DataFrame:
    return rank.api_rows(rank.scored(lookup.edges_of(g, "customer_5", active_only=False), NOW))


@on_graph("select edges.id, coalesce(a.name, source) as source_name, coalesce(b.name, target) as target_name from edges left join entities a on a.id = source left join entities b on b.id = target where relation <> 'MENTIONED_IN'")
def display_names(g: Graph) -> DataFrame:
    return lookup.display(g.edges, g).select("id", "source_name", "target_name")


# ---------------------------------------------------------------- text and resolution

_CLASS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def norm_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_{_CLASS}]', '', 'g'), '^[{_CLASS}]+|[{_CLASS}]+$', '', 'g')"


@query(f"select doc_id, {norm_sql('text')} as norm from documents", graph_sql=False)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@on_graph(f"select id, replace({norm_sql('name')}, ' ', '_') as slug from entities")
def slug_id(g: Graph) -> DataFrame:
    return g.entities.select("id", text.slug(F.col("name")).alias("slug"))


_WORDS = rf"len(list_filter(regexp_split_to_array(text, '[{_CLASS}]+'), lambda w: w <> ''))"


@query(f"select doc_id, {_WORDS} as words, {_WORDS} >= 50 as enough from documents", graph_sql=False)
def word_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.word_count(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), (words >= pages.MIN_WORDS).alias("enough"))


_CANON = f"canon as (select {norm_sql('name')} as norm_name, arg_min(id, seq) as entity_id from entities group by 1)"
_ASKED = f"asked as (select p_partkey, upper(p_name) || '!' as name from part union all select s_suppkey, 'unknown ' || s_name from supplier)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit("!")).alias("name"))
    return parts.union(table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("unknown "), F.col("s_name"))))


@query(f", {_CANON}, {_ASKED} select p_partkey, name, entity_id from asked left join canon on norm_name = {norm_sql('name')}")
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(_asked(spark, sf_dir), graph(spark, sf_dir)).select("p_partkey", "name", "entity_id")


@query(f", {_CANON}, {_ASKED} select p_partkey, name from asked where {norm_sql('name')} not in (select norm_name from canon)")
def resolve_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(_asked(spark, sf_dir), graph(spark, sf_dir)).where("entity_id is null").select("p_partkey", "name")


@on_graph("select id, name, type, row_number() over (order by lower(name), seq) as place from entities")
def list_entities(g: Graph) -> DataFrame:
    return rank.placed(g.entities.select("id", "name", "type", "seq"), "place", F.lower("name"), "seq").drop("seq")


@on_graph("select id, name, type, null::varchar as summary from entities where contains(lower(name), 'an') or contains(lower(id), 'an')")
def list_entities_q(g: Graph) -> DataFrame:
    return resolve.list_entities(g, "AN")


@on_graph(f"select id, name, type from entities where contains({norm_sql('name')}, 'user 1') or contains(id, 'user 1')")
def similar_entities(g: Graph) -> DataFrame:
    return resolve.similar(g, "User-- 1 ".replace("-", ""))


# ---------------------------------------------------------------- ingestion


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a feed whose external ids repeat: some are documents that are stored already."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select((F.col("conv_id") * 3 + F.col("turn")).cast("string").alias("source_id"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))


_INCOMING = "incoming as (select (conv_id * 3 + turn)::varchar as source_id, text, conv_id * 1000 + turn as seq from conversations)"


@query(f", {_INCOMING} select source_id, seq from incoming where source_id not in (select source_id from episodes where seq % 2 = 0) qualify row_number() over (partition by source_id order by seq) = 1")
def episode_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    known = Graph(g.entities, g.edges, g.episodes.where("seq % 2 = 0"))
    return ingest.new_episodes(_incoming(spark, sf_dir), known).select("source_id", "seq")


@query(f", {_INCOMING} select source_id, seq from incoming where source_id not in (select source_id from episodes where seq % 2 = 0)")
def source_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = graph(spark, sf_dir).episodes.where("seq % 2 = 0").select("source_id").distinct()
    return _incoming(spark, sf_dir).join(known, "source_id", "left_anti").select("source_id", "seq")


def _extraction(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as episodes: the customer and each line's part are named, oddly written; lines from 6 on name a part that isn't listed."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    base = lines.select(
        F.concat(F.lit("ord_"), F.col("o_orderkey")).alias("episode_id"), F.col("o_orderkey").cast("long").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("reference_time"),
        F.concat(F.lit("New Customer-"), F.col("o_custkey") % 400).alias("who"), F.concat(F.lit(" Item "), F.col("l_partkey") % 700, F.lit("?")).alias("what"), F.col("l_linenumber").cast("long").alias("pos"),
    )
    people = base.select("episode_id", "seq", "reference_time", F.lit(0).cast("long").alias("pos"), F.col("who").alias("name"), F.lit("person").alias("type")).distinct()
    items = base.where("pos < 6").select("episode_id", "seq", "reference_time", "pos", F.col("what").alias("name"), F.lit("tool").alias("type"))
    edges = base.select("episode_id", "seq", "reference_time", "pos", F.col("who").alias("source_name"), F.col("what").alias("target_name"), F.lit("USES").alias("relation"), F.concat(F.lit("line "), F.col("pos")).alias("fact"))
    return people.union(items), edges


_EXTRACTION = f"""base as (select 'ord_' || o_orderkey as episode_id, o_orderkey::bigint as seq, o_orderdate::timestamp as reference_time, 'New Customer-' || (o_custkey % 400) as who,
    ' Item ' || (l_partkey % 700) || '?' as what, l_linenumber::bigint as pos from lineitem join orders on l_orderkey = o_orderkey),
  x_nodes as (select distinct episode_id, seq, reference_time, 0::bigint as pos, who as name, 'person' as type from base union all select episode_id, seq, reference_time, pos, what, 'tool' from base where pos < 6),
  x_edges as (select episode_id, seq, reference_time, pos, who as source_name, what as target_name, 'USES' as relation, 'line ' || pos as fact from base),
  {_CANON},
  named as (select x_nodes.*, coalesce(entity_id, replace({norm_sql('name')}, ' ', '_')) as id from x_nodes left join canon on norm_name = {norm_sql('name')}),
  ids as (select distinct episode_id, name, id from named),
  linked as (select e.*, a.id as source, b.id as target from x_edges e left join ids a on a.episode_id = e.episode_id and a.name = source_name left join ids b on b.episode_id = e.episode_id and b.name = target_name)"""


def _planned(spark: SparkSession, sf_dir: str) -> ingest.Ingested:
    return ingest.plan(*_extraction(spark, sf_dir), graph(spark, sf_dir))


@query(f", {_EXTRACTION} select id, type, name, episode_id, seq, pos from named where id not in (select id from entities union all select id from episodes) qualify row_number() over (partition by id order by seq, pos) = 1")
def ingest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).nodes


@query(
    f""", {_EXTRACTION} select source, target, relation, fact, strftime(reference_time, '%Y-%m-%d %H:%M:%S') as valid_from, episode_id, seq, pos from linked where source is not null and target is not null
    and not exists (select 1 from edges o where o.source = linked.source and o.target = linked.target and o.relation = linked.relation and {OPEN})
    qualify row_number() over (partition by source, target, relation order by seq, pos) = 1"""
)
def ingest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).edges.withColumn("valid_from", F.date_format("valid_from", STAMP))


@query(f", {_EXTRACTION} select episode_id, source_name as source, target_name as target, relation, fact from linked where source is null or target is null")
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).rejects


@query(f", {_EXTRACTION} select distinct id as source, episode_id as target, 'MENTIONED_IN' as relation, strftime(reference_time, '%Y-%m-%d %H:%M:%S') as valid_from from named")
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).mentions.select("source", "target", "relation", F.date_format("valid_from", STAMP).alias("valid_from"))


@query(f", {_EXTRACTION} select distinct id from named")
def touched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).touched


# ---------------------------------------------------------------- writes

_GUARD = f"""offered as (select 'customer_' || o_custkey as source, 'part_' || (l_partkey + 50) as target, 'USES' as relation, l_orderkey * 10 + l_linenumber as seq from lineitem join orders on l_orderkey = o_orderkey group by all),
  judged as (select *, case when target not in (select id from entities) or source not in (select id from entities) then 'missing node'
    when exists (select 1 from edges o where o.source = offered.source and o.target = offered.target and o.relation = offered.relation and {OPEN}) then 'already open'
    when row_number() over (partition by source, target, relation order by seq) > 1 then 'already open' end as reason from offered)"""


def _guarded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    offered = lines.select(F.concat(F.lit("customer_"), F.col("o_custkey")).alias("source"), F.concat(F.lit("part_"), F.col("l_partkey") + 50).alias("target"), F.lit("USES").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")).distinct()
    return store.accept_edges(offered, graph(spark, sf_dir))


@query(f", {_GUARD} select source, target, relation, seq from judged where reason is null")
def add_edge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir)[0]


@query(f", {_GUARD} select source, target, seq, reason from judged where reason is not null")
def add_edge_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir)[1].select("source", "target", "seq", "reason")


_CLOSED = "closed as (select id, source, target, relation, valid_from, case when seq % 7 = 0 and relation = 'OWNS' then timestamp '2010-01-01' else valid_until end as valid_until from edges)"


def _closed(g: Graph) -> Graph:
    """Some edges closed by a later version in the log."""
    later = g.edges.where("seq % 7 = 0 and relation = 'OWNS'").withColumns({"valid_until": temporal.utc("2010-01-01"), "seq": F.col("seq") + 10**18})
    return Graph(g.entities, store.latest(g.edges.unionByName(later)), g.episodes)


@on_graph(f", {_CLOSED} select relation, count(*) as n, count(valid_until) as closed from closed group by relation")
def close_edges(g: Graph) -> DataFrame:
    return _closed(g).edges.groupBy("relation").agg(F.count("*").alias("n"), F.count("valid_until").alias("closed"))


@on_graph(f", {_CLOSED} select {SHOWN} from closed where relation = 'OWNS'")
def latest_version(g: Graph) -> DataFrame:
    return shown(_closed(g).edges.where("relation = 'OWNS'"))


@on_graph(f", {_CLOSED} select source, target, relation from closed where relation = 'OWNS' and valid_until is not null")
def reopen_edge(g: Graph) -> DataFrame:
    """Every owned pair offered again: those whose edge was closed are accepted."""
    return store.accept_edges(g.edges.where("relation = 'OWNS'").select("source", "target", "relation", "seq"), _closed(g), ("OWNS",))[0].drop("seq")


def _store(spark: SparkSession) -> store.Store:
    return store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query(
    """select 'nation_' || n_nationkey as id, 'team' as type, n_name as name, case when n_nationkey % 2 = 0 then 'summary of ' || n_name end as summary, n_nationkey % 2 = 0 and n_nationkey <> 4 as consolidated from nation
    union all select 'late', 'person', 'Late One', null, false""",
    graph_sql=False,
)
def store_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created in a batch and singly, patched in a batch, marked dirty again singly, read back."""
    kg, nation = _store(spark), table(spark, sf_dir, "nation")
    kg.append("entities", nation.select(F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.lit("team").alias("type"), F.col("n_name").alias("name"), F.lit(False).alias("consolidated"), F.col("n_nationkey").alias("__order")))
    kg.add_node("late", "person", "Late One")
    even = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.concat(F.lit("summary of "), "n_name").alias("summary"), F.lit(True).alias("consolidated"))
    kg.patch_many("entities", even)
    kg.patch("entities", "nation_4", consolidated=False)
    return kg.graph().entities.select("id", "type", "name", "summary", "consolidated")


@query(
    """select 'conv_' || conv_id || '_' || turn as id, text, 'conversation' as source_type, null::varchar as metadata from conversations
    union all select 'late', 'patched', 'note', '{"k": 1}'""",
    graph_sql=False,
)
def store_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created in a batch and singly, patched, read back."""
    kg = _store(spark)
    kg.append("episodes", table(spark, sf_dir, "conversations").select(F.concat_ws("_", F.lit("conv"), "conv_id", "turn").alias("id"), "text", F.lit("conversation").alias("source_type")))
    kg.add_episode("late", "first", "2024-01-01", "note", "s1", {"k": 0})
    kg.patch("episodes", "late", text="patched", metadata={"k": 1})
    return kg.graph().episodes.select("id", "text", "source_type", "metadata")


class _Standing:
    """A client whose consolidation of any entity is a summary, a known target and an unknown one."""

    def ask(self, task: str, values: dict[str, str], schema: dict | None = None) -> str:
        edges = [{"relation": "MEMBER_OF", "target": "europe!", "fact": "in Europe"}, {"relation": "USES", "target": "No Such", "fact": "nothing"}]
        return json.dumps({"summary": f"{values['name']}: {values['episodes']}", "semantic_edges": edges, "episodic_only": []})


@query(
    """select 'nation_' || n_nationkey as source, 'MEMBER_OF' as relation, 'region_' || (select min(r_regionkey) from region where r_name = 'EUROPE') as target, n_name || ': 1. "text ' || n_nationkey || '"' as note from nation where n_nationkey % 3 <> 0
    union all select 'nation_' || n_nationkey, 'USES', null, 'No Such' from nation where n_nationkey % 3 <> 0""",
    graph_sql=False,
)
def store_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and standing edges as stored, and the log of unresolved targets; nations without an episode stay pending."""
    kg, nation, region = _store(spark), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.select(F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.lit("team").alias("type"), F.col("n_name").alias("name"))
    regions = region.select(F.concat(F.lit("region_"), "r_regionkey"), F.lit("concept"), F.col("r_name"))
    kg.append("entities", named.union(regions).withColumn("consolidated", F.col("type") == "concept"))
    told = nation.where("n_nationkey % 3 <> 0").select("n_nationkey", F.concat(F.lit("ep_"), "n_nationkey").alias("id"), F.concat(F.lit("text "), "n_nationkey").alias("text"), temporal.utc("2024-01-01").alias("reference_time"))
    kg.append("episodes", told.drop("n_nationkey"))
    mentions = told.select(F.concat(F.lit("nation_"), "n_nationkey").alias("source"), F.lit(MENTION).alias("relation"), F.col("id").alias("target"), F.lit(MENTION_FACT).alias("fact"), F.col("reference_time").alias("valid_from"))
    kg.append("edges", mentions.withColumn("id", store.edge_id()))
    consolidate.consolidate_all(kg, _Standing(), now=dt.datetime.fromisoformat(NOW), run_id="r", unresolved_path=f"{kg.path}/unresolved")
    g = kg.graph()
    found = g.open_edges().where(F.col("relation") != MENTION).join(g.entities.where("consolidation_run_id = 'r'").select(F.col("id").alias("source"), F.col("summary").alias("note")), "source")
    left = spark.read.parquet(f"{kg.path}/unresolved").select("source", "relation", F.lit(None).cast("string").alias("target"), F.col("target_name").alias("note"))
    return found.select("source", "relation", "target", "note").union(left)


def _owned_store(spark: SparkSession, sf_dir: str) -> store.Store:
    """A store of all nodes and owned parts, written on 2024-01-01 and compacted; on 2024-01-02 each seventh edge is closed."""
    g, now = graph(spark, sf_dir), [dt.datetime(2024, 1, 1, tzinfo=dt.UTC)]
    kg = store.Store(spark, _store(spark).path, clock=lambda: now[0])
    kg.append("entities", g.entities)
    kg.append("edges", g.edges.where("relation = 'OWNS'"))
    kg.compact("edges")
    now[0] = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    kg.close_edges(kg.graph().edges.where("seq % 7 = 0").select("id", temporal.utc("2010-01-01").alias("valid_until")))
    return kg


@query(f", {_CLOSED} select {SHOWN} from closed where relation = 'OWNS' and target in ('part_7', 'part_8') and {OPEN}")
def store_in_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of two parts, read from the copy by target and what was written after it."""
    g = _owned_store(spark, sf_dir).graph()
    return shown(lookup.edges_of(g, "part_7", "in", "OWNS").union(lookup.edges_of(g, "part_8", "in", "OWNS")))


@query(f""", {_CLOSED} select 'early' as known, source, count(*) as n, count(*) as open from closed where relation = 'OWNS' group by source
    union all select 'late', source, count(*), count(*) filter ({OPEN}) from closed where relation = 'OWNS' group by source""")
def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned parts by owner as they were known before and after the closes were written."""
    kg = _owned_store(spark, sf_dir)
    seen = [kg.graph(dt.datetime(2024, 1, day, 12, tzinfo=dt.UTC)).edges.withColumn("known", F.lit(known)) for day, known in ((1, "early"), (2, "late"))]
    return seen[0].unionByName(seen[1]).groupBy("known", "source").agg(F.count("*").alias("n"), F.count_if(F.col("valid_until").isNull()).alias("open"))


# ---------------------------------------------------------------- episodes and consolidation


@on_graph("select ep.id, strftime(reference_time, '%Y-%m-%d %H:%M:%S') as reference_time, row_number() over (order by reference_time, ep.seq) as place from edges join episodes ep on target = ep.id where source = 'nation_3' and relation = 'MENTIONED_IN'")
def episodes_for_entity(g: Graph) -> DataFrame:
    found = lookup.episodes_of(g, "nation_3")
    return rank.placed(found, "place", "reference_time", "seq").select("id", F.date_format("reference_time", STAMP).alias("reference_time"), "place")


@on_graph(
    """, m as (select source as entity_id, coalesce(text, '') as text, row_number() over (partition by source order by reference_time, ep.seq) as i from edges join episodes ep on target = ep.id where relation = 'MENTIONED_IN')
    select entity_id, string_agg(i || '. "' || text || '"', chr(10) order by i) as episodes from m group by entity_id"""
)
def numbered_episode_text(g: Graph) -> DataFrame:
    return lookup.numbered_texts(lookup.episodes_of(g))


@on_graph(
    """, m as (select source as entity_id, coalesce(text, '') as text, row_number() over (partition by source order by reference_time, ep.seq) as i from edges join episodes ep on target = ep.id where relation = 'MENTIONED_IN'),
    l as (select entity_id, i, chr(10) || i || '. "' || text || '"' as line from m),
    p as (select entity_id, i, k, substring(line, k * 1000 + 1, 1000) as piece from l, unnest(range(0, (length(line) - 1) // 1000 + 1)) t(k)),
    s as (select *, (sum(length(piece)) over (partition by entity_id order by i, k) - length(piece)) // 1000 as part from p)
    select entity_id, part::bigint as part, case when string_agg(piece, '' order by i, k)[1] = chr(10) then string_agg(piece, '' order by i, k)[2:] else string_agg(piece, '' order by i, k) end as episodes from s group by entity_id, part"""
)
def episode_text_parts(g: Graph) -> DataFrame:
    """Each entity's numbered episodes in rows of at most 2000 characters."""
    return parts.texts_in_parts(lookup.episodes_of(g), 2000)


@on_graph("select id, name from entities where seq % 3 <> 0")
def pending_entities(g: Graph) -> DataFrame:
    return lookup.pending(g.entities).select("id", "name")


@on_graph("select count(*) as pending, count_if(id in (select source from edges where relation = 'MENTIONED_IN'))::bigint as with_episodes from entities where seq % 3 <> 0")
def consolidation_counts(g: Graph) -> DataFrame:
    marked = lookup.pending(g.entities).select("id").join(consolidate.material(g).select("id", F.lit(1).alias("has")).distinct(), "id", "left")
    return marked.agg(F.count("*").alias("pending"), F.count("has").alias("with_episodes"))


_STANDING = f"""standing as (select 'nation_' || n_nationkey as source, 'USES' as relation, case when n_nationkey % 4 = 0 then 'no such thing' else upper(p_name) end as target_name, 'uses it' as fact, p_partkey as seq, n_nationkey as pos
    from nation join part on p_partkey % 25 = n_nationkey), {_CANON}, r as (select standing.*, entity_id as target from standing left join canon on norm_name = {norm_sql('target_name')})"""


def _standing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, part = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    found = nation.join(part, F.col("p_partkey") % 25 == F.col("n_nationkey")).select(
        F.concat(F.lit("nation_"), F.col("n_nationkey")).alias("source"), F.lit("USES").alias("relation"), F.when(F.col("n_nationkey") % 4 == 0, "no such thing").otherwise(F.upper("p_name")).alias("target_name"),
        F.lit("uses it").alias("fact"), F.col("p_partkey").alias("seq"), F.col("n_nationkey").alias("pos"),
    )
    return consolidate.split_edges(found, graph(spark, sf_dir))


@query(f", {_STANDING} select source, relation, target, seq from r where target is not null qualify row_number() over (partition by source, target, relation order by seq, pos) = 1")
def consolidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standing(spark, sf_dir)[0].select("source", "relation", "target", "seq")


@query(f", {_STANDING} select source, relation, target_name, fact from r where target is null")
def consolidate_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standing(spark, sf_dir)[1]


# ---------------------------------------------------------------- feeds

_EVENT_TEXT = "event_type || chr(10) || 'Time: ' || strftime(ts, '%Y-%m-%d') || ' to ' || chr(10) || 'Organizer: user' || user_id || '@example.com' || case when event_id % 2 = 0 then chr(10) || 'Attendees: Ann, user' || user_id else '' end || chr(10) || 'value ' || event_id"


@query(
    f"select event_id, {_EVENT_TEXT} as text, strftime(ts, '%Y-%m-%d') as event_time, 'user' || user_id || '@example.com' as organizer, case when event_id % 2 = 0 then 3 else 0 end::bigint as people from events where event_id % 10 <> 9",
    graph_sql=False,
)
def event_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    person = "struct<displayName:string,email:string,self:boolean>"
    shaped = rows.select(
        "event_id", F.when(F.col("event_id") % 10 == 9, "cancelled").alias("status"), F.col("event_type").alias("summary"), F.concat(F.lit(" value "), F.col("event_id"), F.lit("\n")).alias("description"), F.lit("").alias("location"),
        F.struct(F.lit("").alias("dateTime"), F.date_format("ts", "yyyy-MM-dd").alias("date")).alias("start"), F.struct(F.lit(None).cast("string").alias("dateTime"), F.lit(None).cast("string").alias("date")).alias("end"),
        F.struct(F.lit("").alias("displayName"), F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("email")).alias("organizer"),
        F.when(F.col("event_id") % 2 == 0, F.array(
            F.struct(F.lit("Ann").alias("displayName"), F.lit("a@example.com").alias("email"), F.lit(False).alias("self")).cast(person),
            F.struct(F.lit("Me").alias("displayName"), F.lit("m@example.com").alias("email"), F.lit(True).alias("self")).cast(person),
            F.struct(F.lit("").alias("displayName"), F.concat(F.lit("user"), F.col("user_id")).alias("email"), F.lit(None).alias("self")).cast(person),
        )).alias("attendees"),
    )
    found = calendar.fetch(shaped.withColumns({"id": F.col("event_id").cast("string"), "updated": F.lit("u"), "htmlLink": F.lit("l")}), dt.datetime.fromisoformat(NOW), min_words=1)
    return found.select(F.col("event_id").cast("long").alias("event_id"), F.col("plain_text_content").alias("text"), "event_time", "organizer", F.size("attendees").cast("long").alias("people"))


@query("select conv_id::varchar as page_id, string_agg(text, chr(10) order by turn) as text from conversations where turn % 5 <> 4 group by conv_id", graph_sql=False)
def notion_blocks_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a chain of nested blocks; each fifth is of a type without text, whose children still count."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 5 == 4, "image").otherwise("paragraph")
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    content = F.struct(F.array(F.struct(F.col("text").alias("plain_text"))).alias("rich_text"))
    raw = F.to_json(F.struct(F.concat_ws("/", "conv_id", "turn").alias("id"), kind.alias("type"), content.alias("paragraph"), content.alias("image")))
    parent = F.when(F.col("turn") == first, F.col("conv_id").cast("string")).otherwise(F.concat_ws("/", "conv_id", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))))
    return pages.page_texts(turns.select(parent.alias("parent"), F.col("turn").cast("int").alias("pos"), raw.alias("raw")))


@query("select conv_id::varchar as page_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id", graph_sql=False)
def fetched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages of a service that is asked for their blocks by waves: two turns a level, each level below the second of the one above."""
    turns = table(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    placed = turns.withColumn("k", place).withColumn("level", F.expr("k div 2"))
    content = F.struct(F.array(F.struct(F.col("text").alias("plain_text"))).alias("rich_text"))
    last = F.max("k").over(Window.partitionBy("conv_id"))
    shaped = placed.withColumn("last", last).withColumn("inner", F.expr("k % 2 = 1 and k < last"))
    parent = F.when(F.col("level") == 0, F.col("conv_id").cast("string")).otherwise(F.concat_ws("-", "conv_id", F.col("level") * 2 - 1))
    raw = F.to_json(F.struct(F.concat_ws("-", "conv_id", "k").alias("id"), F.lit("paragraph").alias("type"), F.col("inner").alias("has_children"), content.alias("paragraph")))
    served = f"{shared_dir(spark)}/service-{uuid.uuid4().hex}"
    shaped.select(parent.alias("parent"), F.col("k").cast("int").alias("pos"), raw.alias("raw")).sort("parent", "pos").write.option("parquet.block.row.count.limit", 1000).parquet(served)
    options = {"transport": "kairograph.sources.feed:from_table", "url": served + "?parent={id}", "items": "results"}
    return pages.page_texts(blocks.fetch_blocks(turns.select(F.col("conv_id").cast("string").alias("id")).distinct(), options))


@query("select page_id, 'Title ' || page_id as title from pages", graph_sql=False)
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json(
        F.concat(F.lit('{"tags":{"type":"multi_select"},"Name":{"type":"title","title":[{"plain_text":"Title "},{"plain_text":"'), F.col("page_id"), F.lit('"}]}}')),
        "map<string,struct<type:string,title:array<struct<plain_text:string>>>>",
    )
    return table(spark, sf_dir, "pages").select("page_id", pages.page_title(props).alias("title"))


@query("select event_id, (json_extract(props, '$.k'))::bigint as k from events", graph_sql=False)
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# ---------------------------------------------------------------- service


@on_graph("select (select count(*) from entities) as nodes, (select count(*) from edges) as edges, (select count(*) from episodes) as episodes")
def stats_counts(g: Graph) -> DataFrame:
    counts = [t.agg(F.count("*").alias(n)) for n, t in (("nodes", g.entities), ("edges", g.edges), ("episodes", g.episodes))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


def _answer(g: Graph, question: str) -> DataFrame:
    """Place, id and score of the response's edges, with its answer and error; a row without edges if there is none."""
    client = RulesClient({"part 1": "tool", "customer 5": "person", "part 2": "tool"})
    got = service.answer(g, question, client, dt.datetime.fromisoformat(NOW))
    edges = [(i, e["id"], e["score"], e["valid_from"]) for i, e in enumerate(got["edges"], 1)] or [(0, None, None, None)]
    return g.entities.sparkSession.createDataFrame([(*e, got["answer"], got["error"]) for e in edges], "place long, id string, score double, valid_from string, answer string, error string")


def _answer_sql(where: str, order: str) -> str:
    return f""", s as (select *, {SCORE} as score from edges where {where}), r as (select *, row_number() over (order by {order}) as place, count(*) over () as n from s)
    select place, id, round_even(score, 4) as score, strftime(valid_from, '%Y-%m-%dT%H:%M:%S') as valid_from, (select n || ' facts answer this; the first is: ' || fact || ' (' || source || ' ' || relation || ' ' || target || ')' from r where place = 1) as answer,
    null::varchar as error from r"""


on_graph(_answer_sql(f"target = 'part_1' and relation = 'OWNS' and {OPEN}", "score desc, seq"), "answer_direct")(lambda g: _answer(g, "Who owns part 1?"))
on_graph(_answer_sql("source = 'customer_5' and relation = 'MEMBER_OF'", "edges.valid_from, seq").replace("order by edges.", "order by s."), "answer_history")(lambda g: _answer(g, "What has customer 5 been in over time?"))
query("select 0::bigint as place, null::varchar as id, null::double as score, null::varchar as valid_from, null::varchar as answer, 'There is no entity ''who_owns_the_moon''.' as error", "answer_error", graph_sql=False)(
    lambda spark, sf_dir: _answer(graph(spark, sf_dir), "Who owns the moon?")
)


@on_graph(f", s as (select *, {SCORE} as score from edges where source = 'customer_5' and relation = 'USES') select id, score, row_number() over (order by valid_from, seq) as rank from s")
def routed_history(g: Graph) -> DataFrame:
    return router.execute(g, router.Intent("history", "customer_5", "USES"), NOW).select("id", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

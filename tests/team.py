"""The team graph: 9 nodes, 11 edges e1 to e11."""

from pyspark.sql import functions as F

from kairograph.operators.lookup import Graph
from kairograph.schema import EDGES, ENTITIES, EPISODES

NODES = [
    ("alice", "person", "Alice"), ("bob", "person", "Bob"), ("infra_team", "team", "Infrastructure Team"), ("platform_team", "team", "Platform Team"),
    ("auth_service", "service", "Authentication Service"), ("payment_service", "service", "Payment Service"), ("api_gateway", "service", "API Gateway"),
    ("postgres", "tool", "Postgres Database"), ("incident_001", "concept", "Incident 001"),
]
LINKS = [
    ("alice", "MEMBER_OF", "infra_team", "2025-01-10"), ("bob", "MEMBER_OF", "platform_team", "2025-01-10"), ("alice", "MEMBER_OF", "platform_team", "2025-03-01"),
    ("infra_team", "OWNS", "auth_service", "2025-01-10"), ("platform_team", "OWNS", "payment_service", "2025-01-10"), ("platform_team", "OWNS", "api_gateway", "2025-01-10"),
    ("auth_service", "DEPENDS_ON", "postgres", "2025-01-10"), ("payment_service", "DEPENDS_ON", "postgres", "2025-01-10"), ("api_gateway", "DEPENDS_ON", "auth_service", "2025-01-10"),
    ("alice", "RESPONDED_TO", "incident_001", "2025-02-20"), ("auth_service", "INVOLVED_IN", "incident_001", "2025-02-20"),
]


def shaped(df, schema):
    fields = [f.split()[:2] for f in schema.replace(" not null", "").split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def make(spark, links, nodes=None, episodes=()):
    """links: (source, relation, target, valid_from[, valid_until]); ids are e1, e2, ..."""
    rows = [(f"e{i}", s, t, r, f"{s} {r} {t}", vf, (more or [None])[0], i) for i, (s, r, t, vf, *more) in enumerate(links, 1)]
    edges = shaped(spark.createDataFrame(rows, "id string, source string, target string, relation string, fact string, valid_from string, valid_until string, seq long"), EDGES)
    if nodes is None:
        nodes = sorted({(x, "concept", x) for row in links for x in (row[0], row[2])})
    entities = shaped(spark.createDataFrame([(*n, i, False) for i, n in enumerate(nodes)], "id string, type string, name string, seq long, consolidated boolean"), ENTITIES)
    eps = shaped(spark.createDataFrame(list(episodes), "id string, text string, reference_time string, source_id string, seq long"), EPISODES)
    return Graph(entities, edges, eps)


def team(spark):
    return make(spark, LINKS, NODES)


def numbers(edges, ordered=False):
    found = [int(r.id[1:]) for r in edges.collect()]
    return found if ordered else set(found)

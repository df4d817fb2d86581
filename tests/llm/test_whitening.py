import math

import numpy as np
import pytest

from kairograph.llm import whitening

DIR = "/root/testdata/sf0.01"


def plain(vectors):
    """Exact deviations by Python's integers; the rest by numpy."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    off = np.array([[n * c - t for c, t in zip(v, s, strict=True)] for v in x], float) / n
    cov = off.T @ off / n
    values, vectors = np.linalg.eigh(cov)
    return n, deviation, off, values[::-1], vectors[:, ::-1], np.trace(cov)


def check(rows, vectors, components=8):
    n, deviation, off, values, axes, trace = plain(vectors.values())
    at = {i: k for k, i in enumerate(vectors)}
    w = np.zeros((n, components))
    for r in rows:
        k = at[r.vec_id]
        assert r.n == n and r.deviation == deviation[k] and abs(r.explained - values[r.component - 1] / trace) <= 1e-9 and r.identity_error < 1e-9
        w[k, r.component - 1] = r.whitened
    assert len(rows) == n * components
    for c in range(components):
        want = off @ axes[:, c] / np.sqrt(values[c])
        assert min(abs(w[:, c] - want).max(), abs(w[:, c] + want).max()) < 1e-6
    assert abs(w.T @ w / n - np.eye(components)).max() < 1e-9


def test_query(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    check(whitening.op12(spark, DIR).collect(), {r.vec_id: r.embedding for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)})


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_edge_rows(spark, scale):
    """Null, non-finite and too large entries go; other lengths have their own n; sums beyond a long are exact (scale 1e9)."""
    noise = np.random.default_rng(1)
    good = {i: (noise.normal(size=10) * scale).tolist() for i in range(40)}
    bad = [(100, None), (101, [None] + [1.0] * 9), (102, [float("nan")] * 10), (103, [float("inf")] + [1.0] * 9), (104, [1e30] * 10), (105, [])]
    other = [(200, [1.0, 2.0]), (201, [1.0, 2.0])]
    df = spark.createDataFrame([*good.items(), *bad, *other], "vec_id long, embedding array<double>").selectExpr("*", "'x' as component", "1 as n", "'y' as x")
    rows = whitening.whiten(df).collect()
    n, deviation, *_ = plain(good.values())
    if scale == 1.0:
        check([r for r in rows if r.vec_id < 100], good)
    else:
        assert {(r.vec_id, r.n, r.deviation) for r in rows if r.vec_id < 100} == {(i, n, d if d < 1 << 63 else None) for i, d in zip(good, deviation, strict=True)}
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows if r.vec_id >= 100) == [
        (i, c, 2, 0, None, None, 0.0) for i in (200, 201) for c in (1, 2)
    ]


def test_repeated_rows_null_ids_and_lost_variance(spark):
    """Three equal directions in four: the components without variance are null, the others are white."""
    base = [[float(a), float(a), float(b), 0.0] for a, b in ((1, 5), (2, -1), (4, 2), (4, 2), (-3, 0))]
    df = spark.createDataFrame([(None if i == 0 else 7, v) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    rows = whitening.whiten(df).collect()
    assert len(rows) == 20 and sum(r.vec_id is None for r in rows) == 4 and all(r.n == 5 and r.identity_error < 1e-9 for r in rows)
    assert all((r.whitened is None) == (r.component > 2) for r in rows)
    assert abs(sum({r.component: r.explained for r in rows}.values()) - 1) < 1e-9


def test_no_rows(spark):
    out = whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.isEmpty() and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

import numpy as np
import pyarrow as pa
import pytest

from kairograph.llm import embeddings
from tests.llm.util import union_find


def brute(rows, cosine=0.95):
    use = [i for i, (v, x) in enumerate(rows) if v is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    m = np.array([np.float32(rows[i][1]).astype(float) for i in use])
    m /= np.sqrt((m**2).sum(1))[:, None]
    near = m @ m.T >= cosine
    pairs = [(use[a], use[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    links = np.zeros(len(rows), int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    root, least = union_find(len(rows), pairs), {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    return sorted((v, int(links[i]), least.get(root[i]), v is not None and v == least.get(root[i])) for i, (v, _) in enumerate(rows) if v is not None)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, **more).collect()]


def draw(seed, n=700, size=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    for _ in range(n // 3):  # chains and clusters about the threshold
        a, b = rng.integers(0, n, 2)
        x[a] = x[b] + rng.normal(size=size) * rng.choice([0.02, 0.2, 0.35])
    x[:40] = x[0] + rng.normal(size=(40, size)) * 0.01
    x[40:60] = x[40]
    return [(i, [float(c) for c in x[i].astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links(spark, monkeypatch, seed):
    monkeypatch.setattr(embeddings, "BLOCK", 48)
    monkeypatch.setattr(embeddings, "LIST_SIZE", 32)
    rows = draw(seed)
    assert sorted(run(spark, rows, margin=embeddings.fit(np.eye(16), 1).radius / 2)) == brute(rows)  # this margin loses none


def test_fitted_margin_and_two_levels_of_lists(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 48)
    monkeypatch.setattr(embeddings, "LIST_SIZE", 16)
    monkeypatch.setattr(embeddings, "COARSE", 8)
    rows = draw(3, 1500)
    sample = embeddings.units(pa.array([r[1] for r in rows]), 16)
    index = embeddings.fit(sample, len(rows))
    assert len(index.centres) == 8 and len(index.fine) > 4
    home = index.home(sample)
    at, lists = index.probes(sample, home)
    assert set(zip(range(len(home)), home.tolist(), strict=True)) <= set(zip(at.tolist(), lists.tolist(), strict=True))
    got, want = {r[0]: r[1] for r in run(spark, rows)}, {r[0]: r[1] for r in brute(rows)}
    assert all(got[i] <= want[i] for i in want)  # no link below the cosine, none counted twice
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_doubles_stay_doubles(spark):
    near = float(np.nextafter(1.0, 2.0))
    rows = [(1, [1e300, 0.0]), (2, [1e300, 0.0]), (3, [1e300, 1e299]), (4, [5e-324, 0.0]), (5, [-0.0, 1.0]), (6, [0.0, 1.0]), (7, [0.0, near]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (1, 8), 9: (1, 8)}


def test_unlike_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (1, [0.0, -1.0])]
    assert sorted(run(spark, rows)) == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_edge_rows(spark):
    good = [1.0, 2.0, 3.0]
    rows = [
        (5, good), (3, [2.0, 4.0, 6.0]), (3, [2.0, 4.0, 6.0]), (9, good), (None, good), (10, None), (11, []), (12, [0.0, 0.0, 0.0]), (13, [1.0, None, 3.0]),
        (14, [1.0, float("nan"), 3.0]), (15, [float("inf"), 1.0, 1.0]), (16, [1.0, 2.0]), (17, [-1.0, -2.0, -3.0]),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert sorted(x for x in got if x[0] is not None) == sorted(
        [(3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False), (9, 3, 3, False)] + [(i, 0, i, True) for i in range(10, 18)]
    )
    assert [x for x in got if x[0] is None] == [(None, 0, None, False)]
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_recall_over_a_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.op3(spark, "/root/testdata/sf0.01").collect())
    assert got == brute(rows)

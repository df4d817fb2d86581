import random

import numpy as np
import pytest

from kairograph.llm import components as of
from tests.llm.util import union_find


@pytest.mark.parametrize("seed", range(2))
def test_hubs_are_split_and_joined_whole(spark, monkeypatch, seed):
    monkeypatch.setattr(of, "HUB", 8)
    rng = random.Random(seed)
    pairs = [(0, i) for i in range(100, 200)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(60, 95)] + [(7, 7), (199, 95)]
    got = {r.node: r.component for r in of.components(spark.createDataFrame([*pairs, *pairs[:5], (None, 3)], "u long, v long")).collect()}
    root, least = union_find(200, pairs), {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    assert got == {i: least[root[i]] for i in {x for a, b in pairs if a != b for x in (a, b)}}
    assert of.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_local_components():
    assert of.local_components(6, np.array([5, 4, 1]), np.array([4, 2, 1])).tolist() == [0, 1, 2, 3, 2, 2]


def test_few_edges_take_no_round(spark, monkeypatch):
    """A chain's edges lie in one task, which joins them: no plan of a round is made on the driver."""

    def no_round(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(of, "_large_star", no_round)
    order = np.random.default_rng(0).permutation(300).tolist()
    got = of.components(spark.createDataFrame(list(zip(order, order[1:])), "u long, v long").coalesce(1))
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(300)}


@pytest.mark.parametrize("chunk", [1, 7])
def test_chunks_are_joined_by_rounds(spark, monkeypatch, chunk):
    monkeypatch.setattr(of, "CHUNK", chunk)
    monkeypatch.setattr(of, "HUB", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(chunk)
        pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(3, i) for i in range(150, 180)]
        got = {r.node: r.component for r in of.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
        with pytest.raises(RuntimeError, match="in 0 rounds"):  # rather than give the chunks' own parts
            of.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long"), 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    root, least = union_find(180, pairs), {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    assert got == {i: least[root[i]] for i in {x for a, b in pairs if a != b for x in (a, b)}}


def test_a_long_chain_in_any_order_is_one_component():
    order = np.random.default_rng(1).permutation(50_000)
    assert not of.local_components(len(order), order[:-1], order[1:]).any()

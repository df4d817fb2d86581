import random
import re

import numpy as np
import pytest
import xxhash

from kairograph.llm import components, neardups, simhash
from tests.llm.util import EDGE_TEXTS, edge_docs, empty_docs, union_find

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(0)
    for text in [None, "", " \t", "one", "É a b", "a\x1cb c\xa0d e f", *(" ".join(rng.choices(["a", "B", "cc", "dÉ"], k=rng.randint(1, 30))) for _ in range(40))]:
        assert simhash.fingerprint(text) == plain(text)


def test_golay_code_is_perfect():
    high, flips, sizes = simhash.golay_tables()
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    codes, n = simhash.golay_near(words)
    assert (np.bitwise_count(codes[:, 0] ^ words) <= 3).all() and set(n) <= {1, 6}
    synd = high[codes >> 11] ^ (codes & 2047)
    assert (synd == 0).all() and (np.bitwise_count(codes ^ words[:, None]) <= 4).all()


def drawn(seed, n=400):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)] + [0, (1 << 64) - 1]
    for _ in range(n):
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(3))
def test_all_links_within_four_bits(spark, seed):
    fps = drawn(seed)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and (fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == want and len(want) > 100


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs + [(None, 3)], "u long, v long")).collect()}
    root, least = union_find(3000, pairs), {}
    for i in sorted({x for p in pairs for x in p}):
        least.setdefault(root[i], i)
    assert got == {x: least[root[x]] for a, b in pairs if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def expected(rows, width=4):
    fps = [plain(t, width) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    root, least = union_find(len(rows), near), {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    return sorted(((rows[i][0] is None, rows[i][0] or 0), f"{fps[i]:016x}", least.get(root[i])) for i in range(len(rows)))


def found(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect())


def test_edge_rows(spark):
    assert found(simhash.near_duplicates(edge_docs(spark, extra=True))) == expected(EDGE_TEXTS)
    assert simhash.near_duplicates(empty_docs(spark)).isEmpty()


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = simhash.op6(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((False, r.doc_id), r.fingerprint, r.component_id) for r in got) == expected(rows)


# ---------------------------------------------------------------- the pipeline's stage


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets, by = [shingles(t) for _, t in rows], {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for of in by.values() for a in of for b in of if a < b}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, least = union_find(len(rows), near), {}
    for i, r in enumerate(root):
        least.setdefault(r, rows[i][0])
    want, got = set(least.values()), {r.doc_id for r in neardups.one_of_each(docs).collect()}
    assert want <= got  # nothing else is dropped
    gone = len(rows) - len(want)
    assert gone > 50 and got <= want  # and none is missed


def test_a_dense_group_becomes_one(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        copy = list(words)
        for at in rng.sample(range(400), 3):
            copy[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(i, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(200))) for i in range(10)]
    got = neardups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [*range(10), 100]


def test_stage_edge_rows(spark):
    docs = edge_docs(spark, extra=True)
    got = neardups.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, i) for i in (1, 3, 6, 7, 8, 9)] + [(True, 0)]
    assert neardups.one_of_each(empty_docs(spark)).isEmpty()
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert neardups.one_of_each(twice).count() == 1


def test_hot_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    monkeypatch.setattr(simhash, "CELLS", 64)
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = [base ^ (rng.getrandbits(21)) for _ in range(150)]  # one value of two segments
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps[:60]]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 4]
    root, least = union_find(len(fps), near), {}
    for i, r in enumerate(root):
        least.setdefault(r, fps[i])
    got = {r.fp: r["class"] for r in simhash.link_classes(nodes).collect()}
    assert got == {fps[i]: least[root[i]] for pair in near for i in pair}

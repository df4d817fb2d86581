import random

import numpy as np
import pytest

from kairograph.llm import components, neardups
from tests.llm.util import union_find

LENGTH = 300


def jaccard(a, b):
    x, y = (set(neardups.shingles(w).tolist()) for w in (a, b))
    return len(x & y) / len(x | y)


def edited(kind, old, new):
    """A copy of the words old with a contiguous edit; new gives words that old does not hold."""
    n = len(old)
    return {"appended": old + new[: n // 5], "truncated": old[: n - n // 6], "tail replaced": old[: n - n // 11] + new[: n // 11], "passage replaced": old[: n // 3] + new[: n // 12] + old[n // 3 + n // 12 :]}[kind]


def pairs(kind, number):
    rng = random.Random(kind)
    for _ in range(number):
        old, new = ([b"w%d" % rng.randrange(10**6) for _ in range(LENGTH)] for _ in range(2))
        yield old, edited(kind, old, new)


KINDS = ["appended", "truncated", "tail replaced", "passage replaced"]


def test_contiguous_edits_are_near_copies(spark):
    rows, want = [], set()
    for k, kind in enumerate(KINDS):
        for i, (a, b) in enumerate(pairs(kind, 15)):
            assert 0.8 <= jaccard(a, b) < 0.88
            first = 1000 * k + 2 * i
            rows += [(first, b" ".join(a).decode()), (first + 1, b" ".join(b).decode())]
            want.add(first)
    got = neardups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_bands_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.8):
        found = []
        for _ in range(400):
            both = round(400 * similarity / (1 + similarity))
            x = rng.integers(0, 2**63, 400 - both, dtype=np.uint64)
            found.append((neardups.band_keys(x[:200]) == neardups.band_keys(x[200 - both :])).mean())
        assert np.mean(found) == pytest.approx(similarity**neardups.ROWS, abs=0.02)
    many = rng.integers(0, 2**63, 3 * neardups.MINIMA, dtype=np.uint64)
    assert (neardups.band_keys(many) == neardups.band_keys(many[::-1])).all()  # blocks of hashes do not matter


def test_a_long_chain_of_appended_copies_is_one_group(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = words + [f"x{rng.randrange(10**6)}" for _ in range(len(words) // 8)]
    assert [r.doc_id for r in neardups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_unlike_texts_of_one_id_all_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (2, c), (3, c), (4, a), (5, "alone"), (5, "alone")]
    got = neardups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (1, b), (2, c), (5, "alone")])


@pytest.mark.parametrize("most", [8, 512])
def test_components_within_four_bits_although_most_share_a_segment(spark, monkeypatch, most):
    monkeypatch.setattr(neardups, "BUCKET", most)
    rng = random.Random(most)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(42), rng.randint(0, 7))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(100)})
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), 4)) for p in prints[:60]]
    rows = [(i, i, *(int(np.uint64(x).astype(np.int64)) for x in (p, rng.getrandbits(64), rng.getrandbits(64)))) for i, p in enumerate(dict.fromkeys(prints))]
    near = [(a, b) for a, x in enumerate(rows) for b, y in enumerate(rows[:a]) if any((x[k] ^ y[k]).bit_count() <= 4 if x[k] >= 0 <= y[k] else ((x[k] ^ y[k]) & (1 << 64) - 1).bit_count() <= 4 for k in (2, 3, 4))]
    root = union_find(len(rows), near)
    nodes = spark.createDataFrame(rows, "node long, comp long, f0 long, f1 long, f2 long")
    got = {r.node: r.component for r in components.components(neardups.cross_pairs(nodes)).collect()}
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(i)
    assert {tuple(sorted(i for i in got if got[i] == c)) for c in set(got.values())} == {tuple(g) for g in want.values() if len(g) > 1}
    assert len(near) > 1000


@pytest.mark.parametrize("block", [4, 20, 256])
def test_groups_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(neardups, "BLOCK", block)
    monkeypatch.setattr(neardups, "BUCKET", 16)
    rng = random.Random(7)
    rows, lead = [], [f"lead{i}" for i in range(40)]
    for group in range(6):  # some groups start alike, so that candidates join what shingles do not
        own = lead + [f"g{group}w{rng.randrange(10**6)}" for _ in range(30)]
        for _ in range(15):
            changed = list(own)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows) + i, f"alone{i} " * 9 + f"and{i}") for i in range(20)]
    sets = [set(neardups.shingles(neardups.words(t)).tolist()) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, want = union_find(len(rows), near), {}
    for i, r in enumerate(root):
        want[r] = min(want.get(r, i), i)
    got = neardups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(want.values())


def test_pairs_of_blocks_are_those_of_unlike_classes(spark, monkeypatch):
    monkeypatch.setattr(neardups, "BLOCK", 8)
    of = [("big", 40)] + [("other", 9)] + [(f"small{i}", 1) for i in range(11)]
    names = {name: i + 1 for i, (name, _) in enumerate(of)}
    rows = [(100 * names[name] + i, 7, names[name], b"s") for name, n in of for i in range(n)] + [(10_000 + i, 8, 50, b"s") for i in range(30)]
    met = neardups.class_blocks(spark.createDataFrame(rows, "node long, comp long, class long, s binary"), len(rows)).collect()
    assert {r.big for r in met} == {7}  # component 8 is of one class
    groups = {}
    for r in met:
        groups.setdefault((r.x, r.y), []).append((r.node, r["class"]))
    together = {frozenset((a[0], b[0])) for g in groups.values() for a in g for b in g if a[1] != b[1]}
    assert together == {frozenset((a[0], b[0])) for a in rows for b in rows if a[1] == b[1] == 7 and a[2] != b[2]}
    assert not any({c for _, c in g} == {names["big"]} for g in groups.values())
    assert all(len(set(g)) == len(g) for g in groups.values())

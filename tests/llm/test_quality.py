import math
import zlib
from collections import Counter

import numpy as np

from kairograph.llm import quality
from tests.llm.util import EDGE_TEXTS, edge_docs, empty_docs


def test_blocks_do_not_matter(monkeypatch):
    texts = ["The cat sat. The CAT!!", None, "", "a " * 300, "x%%% y%%%"] * 20
    weights = np.random.default_rng(0).normal(size=(1 << quality.BITS) + 1)
    whole = quality.score_texts(texts, weights)
    monkeypatch.setattr(quality.chars, "MOST_CHARS", 50)
    assert np.allclose(quality.score_texts(texts, weights), whole)
    one = np.array([quality.score_texts([t], weights)[0] for t in texts])
    assert np.allclose(one, whole)


def test_dot_product_is_the_vectors(monkeypatch):
    texts = ["The cat sat. The CAT!!", "x%%% y%%%", ""]
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    logits = [float(weights[i] @ x) + weights[-1] for i, x in quality.vectors(texts)]
    assert np.allclose(quality.score_texts(texts, weights), 1 / (1 + np.exp(-np.clip(logits, -35, 35))), rtol=1e-4)


def test_query_separates_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = quality.op10(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    out = [(labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s in out if y == 1], [s for y, s in out if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.99
    assert np.mean([s >= 0.3 for s in good]) > 0.99 and np.mean([s < 0.3 for s in bad]) > 0.95


def test_edge_rows(spark):
    docs = edge_docs(spark, extra=True)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (7, None), (9, 5)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    got = quality.score(docs, weights, "s").collect()
    assert len(got) == len(EDGE_TEXTS) and all(0 <= r.s <= 1 for r in got)
    bare = {r.s for r in got if not (r.text or "").strip()}
    assert len(bare) == 1
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not none.any() and {r.s for r in quality.score(docs, none, "s").collect()} == {0.5}
    assert quality.score(empty_docs(spark), weights).isEmpty()


def plain_features(text):
    """Feature numbers of one text, a token at a time."""
    m64 = (1 << 64) - 1

    def mix(x):
        x &= m64
        x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & m64
        return x ^ (x >> 29)

    tokens = []
    kinds, lower, _ = quality.chars.tables()
    for c in text or "":
        kind = int(kinds[ord(c)])
        group = 2 if kind >= quality.chars.DIGIT else kind
        if group and tokens and tokens[-1][0] == group and tokens[-1][2]:
            tokens[-1][1].append(c)
        elif group:
            tokens.append([group, [c], True])
        if not group and tokens:
            tokens[-1][2] = False
    lex, form, last = [], [], {}
    for group, part, _ in tokens:
        name = mix(sum(mix(int(lower[ord(c)]) + 1) * (2 * i + 1) for i, c in enumerate(part)))
        of = [int(kinds[ord(c)]) for c in part]
        case = 2 * (quality.chars.UPPER in of) + (quality.chars.LOWER in of) + 4 * (of[0] == quality.chars.UPPER) + 8 * (len(part) == 1)
        shape = case + 1 if group == 2 else name
        form.append(mix(shape + 77) if last.get(group) == name else shape)
        lex.append(name)
        last[group] = name
    ids = [*lex, *((f + 0x5151) & m64 for f in form)]
    for seq, salt, most in ((lex, 11, 2), (form, 23, 3)):
        gram = seq
        for n in range(2, most + 1):
            gram = [mix(a * 31 + b + salt * n) for a, b in zip(gram, seq[n - 1 :])]
            ids += gram
    return [mix(x) & (1 << quality.BITS) - 1 for x in ids], len(tokens)


TEXTS = ["The cat, the CAT!! sat 12 times.", "", None, "a", "!! !! ?", "Ünïcode 漢字 e\u0301 x1 x1", "one\ntwo  two\ttwo"]


def test_features_one_token_at_a_time():
    ids, rows, tokens = quality.features(TEXTS)
    for i, text in enumerate(TEXTS):
        want, n = plain_features(text)
        assert sorted(ids[rows == i].tolist()) == sorted(want) and tokens[i] == n


def test_ftrl_and_scores_written_plainly():
    texts, labels = [t for t in TEXTS if t] * 3, [1, 0, 1, 0, 1] * 3
    model, z, n = quality.Ftrl(), {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02

    def weight(i):
        a, b = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2)

    def vector(text):
        ids, tokens = plain_features(text)
        return {i: quality.SCALE * c / max(tokens, 1) for i, c in Counter(ids).items()} | {1 << quality.BITS: 1.0}

    for (ids, values), text, y in zip(quality.vectors(texts), texts, labels, strict=True):
        model.learn(ids, values, y)
        x = vector(text)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, w in [(i, weight(i)) for i in x]:
            g = (p - y) * x[i]
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
    weights = model.weights()
    assert max(abs(weights[i] - weight(i)) for i in z) < 1e-5
    want = [1 / (1 + math.exp(-sum(weight(i) * v for i, v in vector(t).items()))) for t in TEXTS]
    assert np.abs(quality.score_texts(TEXTS, weights) - want).max() < 1e-5


def test_a_sample_is_bounded_in_characters_too(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_CHARS", 50)
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad " * 500) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    assert quality.score_texts(["good words here"], weights)[0] > 0.5  # texts that don't fit are left out, others learnt

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kairograph.llm import hmm
from tests.llm.util import EDGE_TEXTS, edge_docs, empty_docs

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), "\n"]


def learnt(i, mod=10):
    return i is not None and zlib.crc32(str(i).encode()) % mod != 0


def small(k=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    emit = np.zeros((hmm.CLASSES, k))
    emit[:classes] = rng.dirichlet(np.ones(classes), k).T
    return hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), emit)


def paths(seq, m, start):
    """All state paths of a sequence with their probabilities."""
    for states in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = start[states[0]] * m.emit[seq[0], states[0]]
        for a, b, x in zip(states, states[1:], seq[1:], strict=False):
            p *= m.step[a, b] * m.emit[x, b]
        yield states, p


def test_forward_is_the_sum_over_paths():
    m, rng = small(), np.random.default_rng(1)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 6)]
    got = hmm.log_likelihood(np.concatenate(seqs), np.array([len(s) for s in seqs]), m)
    assert np.allclose(got, [math.log10(sum(p for _, p in paths(s, m, m.start))) for s in seqs])


@pytest.mark.parametrize("segment", [1, 2, 4, 64])
def test_expectations_and_likelihoods_are_over_paths_of_whole_texts(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "GROUP", 5)
    m, rng = small(), np.random.default_rng(2)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 3, 4, 7)]
    lengths = np.array([len(s) for s in seqs])
    start, step, emit = hmm.expectations(np.concatenate(seqs), lengths, m)
    ws, wt, we, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES)), []
    for s in seqs:
        found = list(paths(s, m, m.start))
        total = sum(p for _, p in found)
        logs.append(math.log10(total))
        for states, p in found:
            ws[states[0]] += p / total
            for a, b in zip(states, states[1:], strict=False):
                wt[a, b] += p / total
            for a, x in zip(states, s, strict=True):
                we[a, x] += p / total
    assert np.allclose(start, ws) and np.allclose(step, wt) and np.allclose(emit, we)
    assert np.allclose(hmm.log_likelihood(np.concatenate(seqs), lengths, m), logs)


def test_companions_are_counted_by_text():
    seqs = [np.array(s, np.uint16) for s in ([0, 5, 5, 6], [7], [hmm.FREQUENT + 1, 0])]
    got = hmm.companions(np.concatenate(seqs), np.array([4, 1, 2])).reshape(hmm.CLASSES, hmm.FREQUENT)
    want = np.zeros_like(got)
    for s in seqs:
        top = [x for x in s.tolist() if 0 < x <= hmm.FREQUENT]
        for x in s.tolist():
            for y in top:
                want[x, y - 1] += 1 / len(top)
    assert np.allclose(got, want)


def base_of(rows):
    counts = Counter(t for i, x in rows if learnt(i) for t in plain_tokens(x))
    n, v = sum(counts.values()), len(counts)
    norm = math.log10(n + 0.1 * (v + 1))
    return counts, n, lambda text: sum(math.log10(counts.get(t, 0) + 0.1) - norm for t in plain_tokens(text))


def check(rows, got):
    counts, n, base = base_of(rows)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        tokens = plain_tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), n)
        assert r.held_out == (r.doc_id is not None and not learnt(r.doc_id))
        assert abs(r.base_score - base(texts[r.doc_id])) < 1e-6 * max(1, len(tokens)) and math.isfinite(r.score) and r.score < 0


def test_edge_rows(spark):
    check(EDGE_TEXTS, hmm.score(edge_docs(spark, extra=True)).collect())
    assert hmm.score(empty_docs(spark)).isEmpty()
    out = [i for i in range(200) if not learnt(i)][:3]
    check([(i, "some words") for i in out], hmm.score(spark.createDataFrame([(i, "some words") for i in out], "doc_id long, text string")).collect())


def test_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FLUSH", 50)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    whole = hmm.lexicon
    monkeypatch.setattr(hmm, "lexicon", lambda counts: whole(counts, own=hmm.OWN, known=30))
    check(rows, hmm.op8(spark, "/root/testdata/sf0.001").collect())


def test_query_beats_unigrams_on_held_out_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = hmm.op8(spark, "/root/testdata/sf0.01").collect()
    check(rows, got)
    out = [r for r in got if r.held_out]
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.1


def test_score_written_plainly(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 16)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    held, whole, trained = {}, hmm.lexicon, hmm.baum_welch
    monkeypatch.setattr(hmm, "lexicon", lambda counts: held.setdefault("lex", whole(counts, own=40, known=60)))
    monkeypatch.setattr(hmm, "baum_welch", lambda *a: held.setdefault("model", trained(*a)))
    got = {r.doc_id: r.score for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lex, m, counts = held["lex"], held["model"], base_of(rows)[0]
    bins = {}
    for w, c in counts.items():
        if lex.classes[lex.index[w.encode()]] > hmm.OWN if w.encode() in lex.index else True:
            size, kinds = bins.get(zlib.crc32(w.encode()) % hmm.REST, (0, 0))
            bins[zlib.crc32(w.encode()) % hmm.REST] = size + c, kinds + 1
    for i, text in rows:
        a, total = m.start, 0.0
        for t, w in enumerate(plain_tokens(text)):
            at = lex.index.get(w.encode())
            kind = 1 + hmm.OWN + zlib.crc32(w.encode()) % hmm.REST if at is None else int(lex.classes[at])
            a = (a @ m.step if t else a) * m.emit[kind]
            total += math.log10(a.sum())
            a = a / a.sum()
            if kind > hmm.OWN:
                size, kinds = bins.get(kind - 1 - hmm.OWN, (0, 0))
                total += math.log10((counts.get(w, 0) + 0.1) / (size + 0.1 * (kinds + 1)))
        assert abs(got[i] - total) < 1e-6 * max(1, abs(total))


def test_a_step_of_equally_frequent_words_is_filled_by_a_hash(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), 3) for i in range(500)] + [(bytearray(b"top"), 90), (bytearray(hmm.END), 5)], "word binary, n long")
    lex = hmm.lexicon(counts, own=hmm.OWN, known=200)
    assert 120 < len(lex.index) <= 240 and b"top" in lex.index

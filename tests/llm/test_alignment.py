import dataclasses
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kairograph.llm import alignment
from kairograph.llm.bestfit import glyphs_to_bytes
from tests.llm.util import edge_docs, empty_docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    made = Tokenizer.from_file(A)
    made.encode_special_tokens = True
    return made, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, texts):
    """The contract, token by token."""
    ours, theirs = libraries
    per, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a = [(x, glyphs_to_bytes(ours.id_to_token(x))) for x in ours.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, bytes([int(p[3:5], 16)]) if theirs.is_byte(x) else p.replace("▁", " ").encode()) for x in theirs.encode(text) for p in [theirs.id_to_piece(x)]]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        spans = []
        for side in (a, b):
            at, of = 0, []
            for x, token in side:
                of.append((at, at + len(token), x))
                at += len(token)
            spans.append(of)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ["|".join(",".join(str(x) for s, e, x in of if start <= s and e <= end) for of in spans) for start, end in zip([0, *both], both, strict=False)]
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        counts.update(links)
        per.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(na, nb, ng, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for na, nb, ng, links, sha in per]


def rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def expected(libraries, docs):
    return sorted(((i is None, i or 0), *x) for (i, _), x in zip(docs, plain(libraries, [t for _, t in docs]), strict=True))


def fuzz(n):
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "   ", "\n", "\t", "é", "漢字", "1", "23", "'s", "!", "the", "ing", "▁", "\xa0", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "́", "😀", "ﬁ", "\x00"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_edge_rows_and_odd_texts(spark, libraries):
    docs = edge_docs(spark, extra=True).where("doc_id is null or doc_id <> 6")
    got = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate(fuzz(300)))
    made = spark.createDataFrame(got, "doc_id long, text string")
    found = rows(alignment.align(made, A, B))
    assert found == expected(libraries, got)
    assert any(x[1] == 0 and x[7] == "" for x in found) and any(x[1] > x[3] for x in found)
    assert alignment.align(docs, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_no_rows(spark):
    assert alignment.align(empty_docs(spark), A, B).isEmpty()


def test_rare_pairs_are_joined_apart(spark, libraries, monkeypatch):
    docs = [(i, t) for i, t in enumerate([*fuzz(60), *["the same text"] * 20])]
    monkeypatch.setattr(alignment, "FREQUENT", 50)
    assert rows(alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B)) == expected(libraries, docs)


def test_long_texts_take_linear_time(spark):
    """A text of many words, and one whose only common end is its last."""
    texts = ["word thing " * 40_000, "9" * 100_000]
    out = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    for r in out:
        assert r.n_links == r.n_a + r.n_b - r.n_groups > 20_000 and len(r.groups_sha256) == 64


def test_query(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert rows(alignment.op13(spark, "/root/testdata/sf0.001")) == expected(libraries, [(r.doc_id, r.text) for r in docs])


def test_texts_are_aligned_in_their_batch(spark):
    """No interpreted functions over arrays of tokens in the plan; links of three ends, two of them shared."""
    links, closes_a, closes_b = alignment.cuts(*(np.array(x) for x in ([5, 6], [7, 8, 9], [2, 6], [2, 3, 6])), 10)
    assert sorted(links.tolist()) == [57, 68, 69] and alignment.grouped(np.array([5, 6]), np.array([7, 8, 9]), closes_a, closes_b) == "5|7;6|8,9"
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    plan = alignment.aligned(docs, A, B, 32_000)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "lambda" not in plan and "MapInArrow" in plan


def by_batch(texts, b):
    a_sizes, b_sizes = alignment._sizes(A, False), alignment._sizes(B, True)  # noqa: SLF001
    return [([int(x) for x in n], names, sorted(links.tolist())) for n, names, links in alignment.each(texts, alignment.json_bpe(A), b, a_sizes, b_sizes, 32_000)]


def test_distinct_words_of_a_batch_are_encoded_once():
    """The same words in 50 orders: the batch's texts as before, though the model sees each word once."""
    seen = []

    class Counting:
        def encode(self, text, **how):
            seen.append(len(text))
            return alignment.pieces(B).model.encode(text, **how)

    rng, words = random.Random(3), [f"word{i}ing," for i in range(400)]
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(50)]
    found = by_batch(texts, dataclasses.replace(alignment.pieces(B), model=Counting()))
    assert sum(seen) < 1.1 * len(" ".join(words))
    assert found == by_batch(texts, dataclasses.replace(alignment.pieces(B), apart=False))


def test_cuts_between_words_change_nothing(monkeypatch):
    """Texts of spaces of every kind, marks of the model and contractions, together and each whole."""
    monkeypatch.setattr(alignment, "CHUNK", 64)
    b, rng = alignment.pieces(B), random.Random(9)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "▁", "word", "the", "ing", "'s", "'", "é", "漢字", "7", "42", "!", ".", "<s>", "<0x20>", "\x00", "😀", "e\u0301"]
    texts = [None, "", " ", "▁", *("".join(rng.choices(parts, k=rng.randint(1, 24))) for _ in range(4000))]
    assert b.apart and sum(len(b.words(x)) > 1 for x in texts) > 1000
    assert by_batch(texts, b) == by_batch(texts, dataclasses.replace(b, apart=False)) == [by_batch([x], dataclasses.replace(b, apart=False))[0] for x in texts]

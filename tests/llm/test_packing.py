import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kairograph.llm import packing
from tests.llm.util import edge_docs, empty_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def test_ids_equal_the_library(library):
    coder, rng = packing.WordBpe(PATH), random.Random(1)
    parts = ["a", "B", " ", "\n", "é", "É", "漢", "1", "23", "'s", "'RE", "!", "-", "\t", "the", "ing", "\u0301", "\xa0", "ß", "ſ", "²", "İ", "\x1c", "\x85", "\xad", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(1500)]
    texts += [x for c in range(1, 0x180) for x in (f"a{chr(c)}b", f"A{chr(c)}'S 1{chr(c)}1")]
    for text in texts:
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 30, 3000, 60_000])
def test_plan_places_every_rank_once_and_within_room(n):
    rng = np.random.default_rng(n)
    lengths, counts = np.unique(np.ceil(np.minimum(2047, rng.exponential(700, n).astype(int) + 1) / 4).astype(int), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True)) | {512: n // 2}
    rows = packing.plan(histogram, 512)
    load = {}
    for size, of in rows.groupby("class"):
        of = of.sort_values("first")
        assert of["first"].iloc[0] == 0 and of["last"].iloc[-1] == histogram[size] and (of["first"].iloc[1:].to_numpy() == of["last"].iloc[:-1].to_numpy()).all()
        for r in of.itertuples():
            for k in range((r.last - r.first) // r.each):
                load[r.sequence + k] = load.get(r.sequence + k, 0) + size * r.each
    assert max(load.values()) <= 512 and sorted(load) == list(range(len(load)))
    bound = sum(s * c for s, c in histogram.items()) / 512
    assert len(load) <= bound * (1.004 if n > 10_000 else 1.05) + 2


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes, values = rng.permutation(np.arange(2, 15))[:5], rng.random(5)
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes, values, strict=True) if s <= c)])
        value, uses = packing.best_pattern(sizes, values, 30)
        assert abs(value - best[30]) < 1e-9 and (uses * sizes).sum() <= 30 and abs((uses * values).sum() - value) < 1e-9


def check(rows, want):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for of in seqs.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(seqs) == list(range(len(seqs)))
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert pieces == sorted(want)
    return sum(r.length for r in rows) / (2048 * len(seqs))


def expected(library, docs):
    out = []
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            out.append((doc_id is None, doc_id or 0, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
    return out


def test_edge_rows(spark, library):
    docs = edge_docs(spark, extra=True)
    check(packing.pack_documents(docs, PATH).collect(), expected(library, [(r.doc_id, r.text) for r in docs.collect()]))
    empty = packing.pack_documents(empty_docs(spark), PATH)
    assert empty.isEmpty() and empty.columns[-2:] == ["sequence_id", "offset"]


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert check(packing.op2(spark, "/root/testdata/sf0.01").collect(), expected(library, [(r.doc_id, r.text) for r in docs])) > 0.98

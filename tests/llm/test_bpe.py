import hashlib
import random

import public_tokenizers
import pytest

from kairograph.llm import bpe
from tests.llm.util import EDGE_TEXTS, edge_docs, empty_docs

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "b", " ", "  ", "\n", "é", "漢", "1", "23", "'s", "'re", "!", "??", "\t", "the", "ing", "😀", "\u0301", "\xa0"]


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(RANKS, PATTERN)


def test_random_texts_equal_the_library(coder):
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 60)))
        assert coder.encode(text).tolist() == coder.library.encode_ordinary(text)
        if text:
            assert coder.merge_long(text.encode()) == coder.library._encode_single_piece(text.encode())


def test_long_texts_are_cut_where_nothing_changes(coder, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(bpe, "LONG_PIECE", 64)
    text = "".join(rng.choices([*PARTS, " it's we'll ", "x" * 90, " " * 80, "!" * 70, "7" * 66], k=20_000))
    assert len(bpe.chunks(text, 1000)) > 10 and "".join(bpe.chunks(text, 1000)) == text
    whole = coder.library.encode_ordinary(text)
    assert [i for c in bpe.chunks(text, 1000) for i in coder._encode_chunk(c).tolist()] == whole
    assert coder.decode(coder.encode(text)) == text.encode()


def test_one_huge_run_is_not_quadratic(coder):
    text = "ab" * 150_000
    assert coder.decode(coder.encode(text)) == text.encode()


@pytest.mark.parametrize("extra", [False, True])
def test_edge_rows(spark, coder, extra):
    got = bpe.codec(edge_docs(spark, extra), RANKS, PATTERN).collect()
    assert len(got) == len(EDGE_TEXTS)
    by = {r.doc_id: r for r in got}
    for doc_id, text in EDGE_TEXTS:
        assert by[doc_id].ids == coder.library.encode_ordinary(text or "") and bytes(by[doc_id].decoded) == (text or "").encode()
    assert bpe.codec(empty_docs(spark), RANKS, PATTERN).isEmpty()


def test_query(spark, coder):
    import duckdb

    got = {r.doc_id: r for r in bpe.op1(spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.connect().execute("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = coder.library.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids) and got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()

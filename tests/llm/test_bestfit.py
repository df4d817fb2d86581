import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kairograph.llm import bestfit
from tests.llm.util import EDGE_TEXTS, edge_docs, empty_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def histogram(n, seed=1):
    noise = np.random.default_rng(seed)
    sizes = np.maximum(2, np.exp(noise.normal(6.6, 1.0, n)).astype(int))
    return dict(zip(*(x.tolist() for x in np.unique(np.where(sizes > 2048, (sizes - 1) % 2048 + 1, sizes), return_counts=True)), strict=True))


@pytest.mark.parametrize(
    ("counts", "most"),
    [
        (histogram(300), 1.06), (histogram(3000), 1.004), (histogram(100_000), 1.0005), ({k: 1000 * n for k, n in histogram(100_000).items()}, 1.0005),
        ({n: 10**6 // n for n in range(1, 60)}, 1.001), ({1: 5}, None), ({2048: 7}, None), ({1500: 10**9, 1400: 3, 1030: 7}, None), ({1024: 3}, None), ({1500: 10, 500: 10, 48: 10}, 1.0001),
    ],
)
def test_plan_places_every_rank_once_and_within_room(counts, most):
    rows = bestfit.plan(counts, 2048)
    for size, of in rows.groupby("length"):
        of = of.sort_values("first")
        assert of["first"].iloc[0] == 0 and of["last"].iloc[-1] == counts[size] and (of["first"].iloc[1:].to_numpy() == of["last"].iloc[:-1].to_numpy()).all()
        assert ((of["last"] - of["first"]) % of["each"] == 0).all()
    sequences = 0
    for first, of in rows.groupby("sequence"):
        times = ((of["last"] - of["first"]) // of["each"]).unique()
        assert len(times) == 1 and first == sequences
        sequences += int(times[0])
        at = 0
        for r in of.sort_values("place").itertuples():
            assert r.place == at
            at += r.each * r.length
        assert at <= 2048
    assert len(rows) < 20_000
    if most:
        assert sequences <= np.ceil(sum(k * n for k, n in counts.items()) / 2048) * most


def test_least_squares_against_enumerated_grid():
    """Two patterns over three lengths: the error is the least of a fine grid's."""
    columns, want = np.array([[0, 0, 1, 3], [0, 1, 1, 2]]), np.array([0.0, 9.0, 3.0, 4.0])
    x = bestfit.least_squares(columns, want, np.zeros(2))
    matrix = np.array([[0, 0], [1, 2], [0, 1], [1, 0]])
    grid = np.stack(np.meshgrid(*[np.linspace(0, 8, 161)] * 2), -1).reshape(-1, 2)
    best = ((grid @ matrix.T - want) ** 2).sum(1).min()
    assert ((matrix @ x - want) ** 2).sum() <= best + 1e-6 and (x >= 0).all()


def test_priced_patterns_are_the_best_of_all_triples():
    noise = np.random.default_rng(0)
    rest, have = np.append(noise.normal(size=24), 0.0), np.ones(25, bool)
    rest[0], have[0], have[24] = -9, False, False
    found = bestfit.wanted(rest, have, 24, 100)
    best = max(rest[a] + rest[b] + rest[24 - a - b] for a in range(1, 23) for b in range(1, 24 - a))
    assert all(x.sum() == 24 for x in found) and max(rest[x[x > 0]].sum() for x in found if (x > 0).sum() == 3) == pytest.approx(best)


def test_blocks_cover_the_intervals():
    rows = bestfit.plan(histogram(20_000), 2048)
    widths, cut = bestfit.blocks(rows)
    width = dict(zip(widths["length"], widths["width"], strict=True))
    assert len(cut) <= 2 * len(rows)
    noise = np.random.default_rng(2)
    for r in rows.sample(200, random_state=1).itertuples():
        rank = int(noise.integers(r.first, r.last))
        met = cut[(cut["length"] == r.length) & (cut["block"] == rank // width[r.length]) & (cut["first"] <= rank) & (cut["last"] > rank)]
        assert met["sequence"].tolist() == [r.sequence]


def test_cuts_first_piece_shorter():
    assert bestfit.cuts(5, 4) == [(0, 1), (1, 4)] and bestfit.cuts(8, 4) == [(0, 4), (4, 4)] and bestfit.cuts(4, 4) == [(0, 4)] and bestfit.cuts(3, 4) == [(0, 3)]


def expected(library, docs):
    out = []
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        n = -(-len(ids) // 2048)
        start = 0
        for piece in range(n):
            size = len(ids) - 2048 * (n - 1) if piece == 0 else 2048
            out.append((doc_id is None, doc_id or 0, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            start += size
    return sorted(out)


def check(rows, want):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for of in seqs.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return sum(r.length for r in rows) / (2048 * len(seqs))


def test_edge_rows(spark, library):
    check(bestfit.pack_whole_documents(edge_docs(spark, extra=True), PATH).collect(), expected(library, EDGE_TEXTS))
    docs = [(i, t) for i, t in enumerate(["<|endoftext|> x", "a  b\n\n c", " x", "é'S", "漢字" * 2000] + ["same"] * 300)]
    check(bestfit.pack_whole_documents(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect(), expected(library, docs))
    empty = bestfit.pack_whole_documents(empty_docs(spark), PATH)
    assert empty.isEmpty() and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_query(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert check(bestfit.op11(spark, "/root/testdata/sf0.01").collect(), expected(library, docs)) > 0.99

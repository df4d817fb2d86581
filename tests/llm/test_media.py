import hashlib
import zlib

import numpy as np
import pytest

from kairograph.llm import media
from tests.llm.util import EDGE_TEXTS, edge_docs, empty_docs


def scalar_adpcm(block):
    steps = media.adpcm_steps().tolist()
    now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for code in (c for b in block[4:] for c in (b & 15, b >> 4)):
        step = steps[index]
        diff = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            diff += part if code & bit else 0
        now = max(-32768, min(32767, now - diff if code & 8 else now + diff))
        index = max(0, min(88, index + media.INDEX_MOVES[code & 7]))
        out.append(now)
    return out


def test_tables():
    mu, a = media.mu_law(), media.a_law()
    assert mu[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0] and a[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256  # two zeros in mu-law
    steps = media.adpcm_steps()
    assert len(steps) == 89 and (np.diff(steps) > 0).all()


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(0).integers(0, 256, (6, media.BLOCK)).astype(np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [scalar_adpcm(b.tobytes()) for b in blocks]


def test_resample():
    x = np.array([0, 100, 200, 100, -32768, 32767], np.int16)
    got = media.resample(x)
    assert got[0::2].tolist() == x.tolist() and got[3] == (9 * 300 - 0 - 100 + 8) >> 4 and got.dtype == np.dtype("<i2")


@pytest.mark.parametrize("kind", [media.MU_LAW, media.A_LAW, media.ADPCM])
def test_wav_round_trip(kind):
    data, _ = media.payload("some text " * 100)
    assert media.read_wav(media.wav(data, kind)) == (kind, data)
    with pytest.raises(ValueError):
        media.read_wav(b"RIFFxxxxWAVE")


def test_features_do_not_depend_on_neighbours(monkeypatch):
    parts = [media.payload(t)[0] for t in ["a", "b" * 1000, "", "ü" * 700]]
    together = media.features(parts)
    assert together == [media.features([p])[0] for p in parts]


def test_edge_rows(spark):
    stored = media.store(edge_docs(spark, extra=True))
    got = media.describe(media.pcm(stored)).collect()
    assert len(got) == len(EDGE_TEXTS)
    by = {r.doc_id: r for r in got}
    for doc_id, text in EDGE_TEXTS:
        raw, r = (text or "").encode(), by[doc_id]
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert len(r.pcm16k) == 4 * len(want)
    assert by[1].feature == by[2].feature and by[3].feature == by[4].feature
    assert media.describe(media.store(empty_docs(spark))).isEmpty()
    nothing = spark.createDataFrame([(None,)], "media binary")
    assert media.describe(media.pcm(nothing)).first().payload_sha256 is None


def test_query(spark):
    got = media.op7(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got:
        data, n = media.payload(texts[r.doc_id])
        file = media.wav(data, media.MU_LAW)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.media_sha256) == (n, len(data), len(file), hashlib.sha256(file).hexdigest())

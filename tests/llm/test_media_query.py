import hashlib

from kairograph.llm import media

DIR = "/root/testdata/sf0.001"


def scalar_pcm16k(data):
    """Mu-law bytes to 16-bit PCM at 16 kHz, sample by sample."""
    x = []
    for byte in data:
        u = ~byte & 255
        size = (((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132) & 0xFFFF
        x.append(-size if u & 128 else size)
    out = bytearray()
    for i, now in enumerate(x):
        before, after, last = x[max(i - 1, 0)], x[min(i + 1, len(x) - 1)], x[min(i + 2, len(x) - 1)]
        middle = (9 * (now + after) - before - last + 8) >> 4
        for sample in (now, max(-32768, min(32767, middle))):
            out += sample.to_bytes(2, "little", signed=True)
    return bytes(out)


def test_query_stores_resampled_pcm(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = media.op7(spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        want = scalar_pcm16k(media.payload(texts[r.doc_id])[0])
        assert bytes(r.pcm16k) == want
        assert (r.pcm_bytes, r.pcm_sha256) == (len(want), hashlib.sha256(want).hexdigest())

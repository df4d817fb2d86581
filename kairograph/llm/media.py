"""Telephony audio columns: mu-law, A-law and ADPCM samples in WAV files, expanded to PCM and resampled.

Companded samples expand by tables of 256 entries built from the G.711 rules. ADPCM (IMA, mono, 4 bits) is decoded by
numpy across blocks: a step of the loop decodes one sample of every block at once, so the loop is as long as a block,
however many texts and blocks there are. PCM is resampled from 8 kHz to 16 kHz by the integer filter (-1, 9, 9, -1)/16.
All arithmetic is in integers, so equal bytes give equal features anywhere.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import map_arrow, table

RATE = 8000
BLOCK = 576  # bytes: what payloads are a multiple of, and an ADPCM block
PAD = 255
MOST_BYTES = 4 << 20  # of payloads expanded at once
MU_LAW, A_LAW, ADPCM = 7, 6, 17  # WAV format numbers

# How an ADPCM code moves the step index.
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


@functools.cache
def mu_law() -> np.ndarray:
    """PCM of each mu-law byte: bits inverted, sign, exponent, mantissa, bias 33 in 14 bits, scaled to 16."""
    x = ~np.arange(256, dtype=np.int32) & 255
    size = ((((x & 15) << 1) + 33) << ((x >> 4) & 7)) - 33
    return (np.where(x & 128, -size, size) * 4).astype(np.int32)


@functools.cache
def a_law() -> np.ndarray:
    """PCM of each A-law byte: even bits inverted, sign set for positive, no bias in the lowest segment."""
    x = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (x >> 4) & 7, x & 15
    size = np.where(exponent == 0, (mantissa << 1) + 1, ((mantissa << 1) + 33) << np.maximum(exponent - 1, 0))
    return (np.where(x & 128, size, -size) * 8).astype(np.int32)


@functools.cache
def adpcm_steps() -> np.ndarray:
    """The 89 step sizes: each about 1.1 times the one before, as the standard's integers follow from the rule."""
    return np.array(
        # The standard's step table.
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253,
            279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026,
            4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        np.int32,
    )


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of blocks (n x bytes): a 16-bit first sample, a step index (clipped to the table), a byte of no use, codes.

    Low nibble first; 1 + 2 * (bytes - 4) samples a block.
    """
    steps, moves = adpcm_steps(), np.array(INDEX_MOVES * 2, np.int32)
    now = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(steps) - 1).astype(np.int32)
    # what a code adds at an index, for every pair
    code = np.arange(16, dtype=np.int32)
    grid = steps[:, None]
    change = (grid >> 3) + np.where(code & 4, grid, 0) + np.where(code & 2, grid >> 1, 0) + np.where(code & 1, grid >> 2, 0)
    change = np.where(code & 8, -change, change).ravel()
    follow = np.clip(np.arange(len(steps), dtype=np.int32)[:, None] + moves, 0, len(steps) - 1).ravel()
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.int32)
    data = blocks[:, 4:].T
    codes[0::2], codes[1::2] = data & 15, data >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = now
    for t in range(len(codes)):
        at = index * 16 + codes[t]
        now = np.minimum(np.maximum(now + change[at], -32768), 32767)
        index = follow[at]
        out[t + 1] = now
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the middle of it and the next by a four-point filter; ends are repeated."""
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int32)
    out[0::2] = pcm
    out[1::2] = (9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4
    return np.clip(out, -32768, 32767).astype("<i2")


def wav(data: bytes, kind: int) -> bytes:
    """A mono WAV file of 8-bit companded samples or of ADPCM blocks."""
    if kind == ADPCM:
        per = 1 + 2 * (BLOCK - 4)
        form = struct.pack("<HHIIHHHH", kind, 1, RATE, RATE * BLOCK // per, BLOCK, 4, 2, per)
    else:
        form = struct.pack("<HHIIHHH", kind, 1, RATE, RATE, 1, 8, 0)
    fact = struct.pack("<I", len(data) // BLOCK * (1 + 2 * (BLOCK - 4)) if kind == ADPCM else len(data))
    body = b"".join(name + struct.pack("<I", len(part)) + part + b"\0" * (len(part) % 2) for name, part in ((b"fmt ", form), (b"fact", fact), (b"data", data)))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def read_wav(file: bytes) -> tuple[int, bytes]:
    """Format number and stored bytes of a WAV file; chunks in any order, unknown ones are skipped."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, data = 12, None, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<H", file, at + 8)[0]
        elif name == b"data":
            data = file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if kind is None or data is None:
        raise ValueError("a WAV file without format or data")
    return kind, data


def expand(kind: int, data: bytes) -> np.ndarray:
    """16-bit PCM of stored samples."""
    raw = np.frombuffer(data, np.uint8)
    if kind in (MU_LAW, A_LAW):
        return (mu_law() if kind == MU_LAW else a_law())[raw].astype(np.int16)
    if kind == ADPCM:
        return decode_adpcm(raw.reshape(-1, BLOCK)).reshape(-1)
    raise ValueError(f"format {kind}")


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with PAD up to a positive multiple of BLOCK, and how many are the text's."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (max(-(-len(raw) // BLOCK), 1) * BLOCK - len(raw)), len(raw)


def features(parts: list[bytes]) -> list[str]:
    """Of stored payloads, read as each of the three formats: mean square, crossings of zero and peak of the PCM.

    Payloads are joined, expanded at once, and summed by payload.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    adpcm = decode_adpcm(raw.reshape(-1, BLOCK)).reshape(-1)
    found = []
    for name, pcm, counts in (("mu", mu_law()[raw], sizes), ("a", a_law()[raw], sizes), ("ad", adpcm, sizes // BLOCK * (1 + 2 * (BLOCK - 4)))):
        at = np.cumsum(counts) - counts
        wide = pcm.astype(np.int64)
        square = np.add.reduceat(wide * wide, at) // counts
        cross = np.zeros(len(pcm), np.int64)
        cross[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
        cross[at] = 0
        peak = np.maximum.reduceat(np.abs(wide), at)
        found.append([f"{name}:{s}:{c}:{p}" for s, c, p in zip(square.tolist(), np.add.reduceat(cross, at).tolist(), peak.tolist(), strict=True)])
    return [";".join(x) for x in zip(*found, strict=True)]


def _groups(parts: list[bytes]) -> list[tuple[int, int]]:
    out, first, size = [], 0, 0
    for i, part in enumerate(parts):
        if i > first and size + len(part) > MOST_BYTES:
            out.append((first, i))
            first, size = i, 0
        size += len(part)
    return [*out, (first, len(parts))] if parts else out


def store(docs: DataFrame, kind: int = MU_LAW) -> DataFrame:
    """One row per document: doc_id, n_bytes and media, a WAV file whose samples are the text's payload.

    Null and empty texts are one block of padding; repeated rows and null ids are kept as they are.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [payload(x.as_py()) for x in batch.column(1)]
        files = pa.array([wav(p, kind) for p, _ in made], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), files], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def pcm(media: DataFrame) -> DataFrame:
    """All columns of media and pcm16k: the files' samples, expanded and resampled to 16-bit PCM at 16 kHz. Null: null."""

    @F.pandas_udf("binary")
    def made(files):
        return files.map(lambda x: None if x is None else resample(expand(*read_wav(bytes(x)))).tobytes())

    return media.withColumn("pcm16k", made("media"))


def describe(media: DataFrame) -> DataFrame:
    """All columns of media and what its files hold, read back: payload_bytes, payload_sha256, tail_crc32, feature.

    A null file has nulls.
    """

    def read(files: list[bytes | None]) -> list[tuple]:
        held = [None if f is None else read_wav(f)[1] for f in files]
        known = [i for i, x in enumerate(held) if x is not None]
        parts = [held[i] for i in known]
        names = [x for a, b in _groups(parts) for x in features(parts[a:b])]
        out: list[tuple] = [(None, None, None, None)] * len(files)
        for i, part, name in zip(known, parts, names, strict=True):
            out[i] = (len(part), hashlib.sha256(part).hexdigest(), zlib.crc32(part[-32:]), name)
        return out

    names = media.columns
    fields = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = zip(*read(batch.column(batch.schema.get_field_index("media")).to_pylist()), strict=True)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
        made = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return map_arrow(media, fn, f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op7(spark, sf_dir: str) -> DataFrame:
    found = pcm(describe(store(table(spark, sf_dir, "documents"))))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.octet_length("pcm16k").cast("long").alias("pcm_bytes"), F.sha2("pcm16k", 256).alias("pcm_sha256"), "pcm16k",
    )

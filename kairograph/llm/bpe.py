"""Byte-level BPE: text to token ids and ids back to bytes, by a local rank file and the tiktoken library.

Long texts are cut before they reach the library, only where a cut cannot change a token: before a space that stands
between two letters, where the split pattern always ends one match and begins the next. A single match of over
LONG_PIECE bytes (a run of one kind of character) is merged by a heap over a linked list, in the library's order
(lowest rank, then leftmost), since pairwise merging takes time in the square of a piece's length.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import map_arrow, table

CHUNK = 1 << 16  # characters
LONG_PIECE = 2048  # bytes
SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


class ByteBpe:
    """encode() and decode() of one vocabulary; special tokens are ordinary text."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = [self._encode_chunk(chunk) for chunk in chunks(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _encode_chunk(self, text: str) -> np.ndarray:
        if len(text) <= LONG_PIECE or not has_long_run(text):
            return np.array(self.library.encode_ordinary(text), np.int32)
        ids: list[int] = []
        for match in self.pattern.finditer(text):
            piece = match.group().encode()
            ids += self.merge_long(piece) if len(piece) > LONG_PIECE else self.library._encode_single_piece(piece)  # noqa: SLF001
        return np.array(ids, np.int32)

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece in O(n log n)."""
        n, ranks = len(piece), self.ranks
        if piece in ranks:
            return [ranks[piece]]
        ends, after, before = [*range(1, n + 1)], [*range(1, n + 1)], [*range(-1, n - 1)]
        alive = bytearray(b"\1") * n
        heap = [(rank, at, at + 2) for at in range(n - 1) if (rank := ranks.get(piece[at : at + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            right = after[at] if alive[at] else n
            if right >= n or ends[right] != end or not alive[right]:
                continue  # one of the two has been merged since
            ends[at], alive[right], after[at] = end, 0, after[right]
            if after[at] < n:
                before[after[at]] = at
                if (rank := ranks.get(piece[at : ends[after[at]]])) is not None:
                    heapq.heappush(heap, (rank, at, ends[after[at]]))
            if before[at] >= 0 and (rank := ranks.get(piece[before[at] : end])) is not None:
                heapq.heappush(heap, (rank, before[at], end))
        return [ranks[piece[at : ends[at]]] for at in range(n) if alive[at]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes, which need not be valid UTF-8."""
        return self.library.decode_bytes(ids.tolist())


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Cuts at the first safe boundary from each multiple of size on; the whole rest if there is none."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size and (cut := SAFE.search(text, start + size)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def has_long_run(text: str) -> bool:
    """Whether some match of the pattern may be long: no space over LONG_PIECE / 4 characters, or that many spaces."""
    most = LONG_PIECE // 4
    return max(map(len, text.split(" "))) >= most or " " * most in text


@functools.lru_cache(maxsize=4)
def bpe(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def codec(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>) and decoded (binary, of those ids).

    Null and empty texts give no ids and no bytes; repeated rows and null doc_ids are kept as they are.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(ranks_path, pattern)
        ids = [coder.encode(text.as_py()) for text in batch.column(1)]
        decoded = pa.array([coder.decode(x) for x in ids], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), _list_array(ids), decoded], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), fn, f"doc_id {kind}, ids array<int>, decoded binary")


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = codec(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

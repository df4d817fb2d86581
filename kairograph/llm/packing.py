"""Packing of token pieces into fixed-length sequences by cutting-stock column generation.

Each document's ids, with the end id, are cut at every multiple of the sequence length; full pieces fill a sequence
each, and the remainder is one piece. Remainders are counted in classes of UNIT tokens (lengths rounded up), so the
histogram has at most length / UNIT bins whatever the corpus. Over it a linear program chooses how often to use each
pattern (a multiset of classes that fits a sequence): a revised simplex whose columns are priced by an unbounded
knapsack over the duals, until no column, or none worth `tolerance`, is left. Frequencies are rounded down, and what
remains (less than one use of each pattern) is packed by best fit.

Assignment is distributed. Pieces of a class are ranked: a class is dealt into groups by a hash of the piece, whose
number follows the class's size, so that no class, however frequent, is ranked by one task; group sizes (at most
GROUPS + bins rows) give each group its first rank. A pattern owns an interval of the ranks of each of its classes,
so an equi-join with the bounded table of intervals gives a piece its sequence and slot.
"""

from __future__ import annotations

import functools
import math
import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import durable, map_arrow, table

LENGTH = 2048
UNIT = 4
END_ID = 1
GROUPS = 16384

# ---------------------------------------------------------------- tokens

_PLAIN = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180)] if c != 0x130]


class WordBpe:
    """Ids of a tokenizers file without special tokens.

    Words are cached as their ids' bytes: in texts of Latin letters, digits and punctuation below U+0180, where
    normalisation is lower-casing alone, a word's ids don't depend on its neighbours. Other texts go to the library.
    """

    MOST_WORDS = 50_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.library.model
        kinds = {x: unicodedata.category(x)[0] for x in _PLAIN}
        letters, digits = ("".join(re.escape(x) for x, k in kinds.items() if k == want) for want in "LN")
        self.odd = re.compile("[^" + "".join(map(re.escape, _PLAIN)) + "]")
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+").findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.glyph = [chr(b) if b in printable else chr(next(others)) for b in range(256)]  # byte-level alphabet
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.known_parts.get(part)
        if found is None:
            if len(self.known_parts) >= self.MOST_WORDS:
                self.known_parts.clear()
            glyphs = part if part.isascii() else "".join([self.glyph[b] for b in part.encode()])
            found = np.array([t.id for t in self.model.tokenize(glyphs)], "<u4").tobytes()
            if len(part) < 64:
                self.known_parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        found = b"".join([self._part(x) for x in self.parts(word)])
        if len(word) < 64:
            self.known[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.odd.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) >= self.MOST_WORDS:
            self.known.clear()
        get, make = self.known.get, self._word
        return b"".join([x if (x := get(w)) is not None else make(w) for w in text.lower().split()])


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; a null or empty text is the end id alone."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, end = word_bpe(tokenizer_path), END_ID.to_bytes(4, "little")
        rows, cols = [], []
        for row, text in enumerate(batch.column(1)):
            ids = coder.ids(text.as_py()) + end
            total = len(ids) // 4
            for start in range(0, total, length):
                part = memoryview(ids)[4 * start : 4 * (start + length)]
                rows.append(row)
                cols.append((start, len(part) // 4, zlib.crc32(part), total))
        made = np.array(cols, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, np.ascontiguousarray(made.T))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), fn, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


# ---------------------------------------------------------------- patterns


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value and how often it takes each size."""
    order = np.argsort(sizes)
    size, value = sizes[order], values[order]
    upto = np.searchsorted(size, np.arange(room + 1), side="right")
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            worth = best[c - size[:k]] + value[:k]
            i = int(worth.argmax())
            if worth[i] > best[c]:
                best[c], took[c] = worth[i], i
    uses, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            uses[order[took[c]]] += 1
            c -= size[took[c]]
    return float(best[room]), uses


def greedy_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """A first basis: fill a pattern largest size first, use it until one of its sizes is used up, and so on.

    No later pattern holds a size that is used up, so the columns, each listed at the size that it ends, are independent.
    """
    left, open_ = demand.astype(float).copy(), np.ones(len(sizes), bool)
    columns = np.diag(room // sizes).astype(float)
    while open_.any():
        uses, space = np.zeros(len(sizes)), room
        for i in np.flatnonzero(open_)[np.argsort(-sizes[open_], kind="stable")]:
            if sizes[i] <= space:
                uses[i] = min(space // sizes[i], max(1.0, np.floor(left[i])))
                space -= int(uses[i]) * int(sizes[i])
        ratio = np.where(uses > 0, left / np.where(uses > 0, uses, 1), np.inf)
        ends = int(ratio.argmin())
        left -= ratio[ends] * uses
        columns[:, ends], open_[ends] = uses, False
        for i in np.flatnonzero(open_ & (left <= 1e-9)):
            open_[i] = False  # ended at the same time: its own column, which the program uses 0 times
        np.maximum(left, 0, out=left)
    return columns


def _enter(inverse: np.ndarray, u: np.ndarray, out: int) -> None:
    """The basis inverse after its column `out` is replaced by one whose product with it is u (in place)."""
    row = inverse[out] / u[out]
    inverse -= u[:, None] * row
    inverse[out] = row


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, tolerance: float = 1e-3, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their frequencies in the linear program; each demand is met exactly.

    The lower bound objective / (best column's value) ends the search once it is within `tolerance`; so does `rounds`,
    and then the frequencies are still feasible.
    """
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    for at, column in enumerate(greedy_basis(sizes, demand, room).T):
        _enter(inverse, (inverse * column).sum(1), at)
        columns[:, at] = column
    x = np.maximum((inverse * demand).sum(1), 0)
    bound = float((sizes * demand).sum()) / room
    for _ in range(rounds):
        value, uses = best_pattern(sizes, inverse.sum(0), room)
        bound = max(bound, x.sum() / value)
        if x.sum() <= bound * (1 + tolerance):
            break
        u = (inverse * uses).sum(1)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        if value <= 1 + 1e-9 or not np.isfinite(ratio[out]):
            break
        x -= ratio[out] * u
        x[out] = ratio[out]
        np.maximum(x, 0, out=x)
        _enter(inverse, u, out)
        columns[:, out] = uses
    return columns.astype(np.int64), x


def best_fit(counts: dict[int, int], room: int) -> list[dict[int, int]]:
    """Bins of the rest, largest piece first, each into the fullest bin with space."""
    by_space: list[list[dict[int, int]]] = [[] for _ in range(room + 1)]
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            space = next((s for s in range(size, room + 1) if by_space[s]), room)
            bin_ = by_space[space].pop() if by_space[space] else {}
            bin_[size] = bin_.get(size, 0) + 1
            by_space[space - size].append(bin_)
    return [b for bins in by_space for b in bins if b]


def plan(histogram: dict[int, int], room: int) -> pd.DataFrame:
    """Of counts by class: intervals (class, first, last (exclusive), each, sequence, slot).

    The rank r of a class in [first, last) is in sequence `sequence` + (r - first) // each, at slot + (r - first) % each.
    """
    rest = {c: n for c, n in histogram.items() if n and c < room}
    uses: list[tuple[dict[int, int], int]] = [({room: 1}, histogram[room])] if histogram.get(room) else []
    if rest:
        sizes = np.array(sorted(rest), np.int64)
        left = np.array([rest[int(c)] for c in sizes], np.int64)
        columns, x = cutting_stock(sizes, left.astype(float), room)
        for j in np.argsort(-x, kind="stable"):
            column = columns[:, j]
            has = column > 0
            times = int(min(math.floor(x[j] + 1e-6), (left[has] // column[has]).min())) if has.any() else 0
            if times > 0:
                left -= times * column
                uses.append(({int(s): int(k) for s, k in zip(sizes[has], column[has], strict=True)}, times))
        uses += [(b, 1) for b in best_fit({int(s): int(k) for s, k in zip(sizes, left, strict=True) if k}, room)]
    rows, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in uses:
        slot = 0
        for size in sorted(pattern, reverse=True):
            each = pattern[size]
            rows.append((size, taken[size], taken[size] + each * times, each, sequence, slot))
            taken[size] += each * times
            slot += each
        sequence += times
    return pd.DataFrame(rows, columns=["class", "first", "last", "each", "sequence", "slot"]).astype("int64")


# ---------------------------------------------------------------- assignment


def pack(cut: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...); sequences are numbered from 0 without gaps.

    Repeated pieces are packed as often as they occur. No pieces give no rows.
    """
    spark = cut.sparkSession
    names = cut.columns
    cut = cut.withColumn("class", F.ceil(F.col("length") / unit).cast("long"))
    totals = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}  # length / unit rows at most
    if not totals:
        return cut.drop("class").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    share = max(256, -(-sum(totals.values()) // GROUPS))
    deals = pd.DataFrame([(c, -(-n // share)) for c, n in totals.items()], columns=["class", "deals"])
    dealt = cut.join(F.broadcast(spark.createDataFrame(deals)), "class").withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "deals"))
    sizes = dealt.groupBy("class", "deal").agg(F.count("*").alias("n")).toPandas().sort_values(["class", "deal"])  # GROUPS + bins rows at most
    sizes["before"] = sizes.groupby("class")["n"].cumsum() - sizes["n"]
    ranked = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy("class", "deal").orderBy("doc_id", "start", "ids_crc32")))
    slots = plan({int(c): int(n) for c, n in totals.items()}, length // unit)
    found = (
        ranked.join(F.broadcast(spark.createDataFrame(sizes[["class", "deal", "before"]])), ["class", "deal"])
        .withColumn("__r", F.col("before") + F.col("__rn") - 1)
        .alias("p")
        .join(F.broadcast(spark.createDataFrame(slots)).alias("s"), F.expr("p.class = s.class and p.__r >= s.first and p.__r < s.last"))
        .select(
            *[F.col(f"p.{c}") for c in names],
            F.expr("s.sequence + (p.__r - s.first) div s.each").alias("sequence_id"),
            F.expr("s.slot + (p.__r - s.first) % s.each").alias("__slot"),
        )
    )
    before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("__slot")


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(durable(pieces(docs, tokenizer_path), "pieces"))


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

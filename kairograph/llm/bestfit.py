"""Packing whole documents into few sequences by patterns of few documents and non-negative least squares.

Only a document longer than a sequence is cut, so the histogram of piece lengths has at most `length` bins whatever the
corpus. Patterns are multisets of few lengths that fill a sequence exactly: all pairs, and those triples and quadruples
that the residual of the fit asks for (tables of the best pair of each sum price them). Non-negative least squares fits
how often to repeat each pattern to the histogram; the counts are rounded down, and the residual counts are packed by
best fit: the longest left, filled up, and closed by the one, two or three lengths that fit the rest best. All of this
runs over the histogram, never over documents.

Assignment is distributed. Pieces of a length are ranked (a length is dealt into groups by a hash of its rows, so that
none is ranked by one task), a pattern owns an interval of the ranks of each of its lengths, and intervals are cut by
blocks of ranks, so that an equi-join on (length, block) meets about two intervals a piece. A pattern's lengths are
exact, so a piece's offset follows from its interval and no sequence is gathered.

Edge rows: a null or empty text is the end id alone; repeated rows and null doc_ids are packed as often as they occur;
an empty table gives no rows; other columns of documents are left behind. A text is held whole, with its ids, by the
task that encodes it.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.llm.bpe import ByteBpe
from kairograph.llm.common import durable, map_arrow, table

LENGTH = 2048
END_ID = 0
GROUPS = 16384
ROUNDS = 16  # of pricing
STEPS = 400  # of least squares in a round
NEW = 512  # patterns a round
COLUMNS = "piece long, start long, length long, ids_crc32 long"

# ---------------------------------------------------------------- tokens


class JsonBpe(ByteBpe):
    """Ids of a byte-level BPE in a tokenizers file, as that library gives them without special tokens.

    The file's ids are the order of its merges, so they serve as ranks. Its special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, before = told["model"], told["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or told["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        special = {x["content"] for x in told["added_tokens"]}
        self.ranks = {glyphs_to_bytes(token): rank for token, rank in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or not all(bytes([b]) in self.ranks for b in range(256)):
            raise ValueError(f"{path}: its merges are not in the order of ids, or a byte has no id")
        import public_tokenizers

        self.library = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)


@functools.cache
def _glyphs() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet: printable ones stand for themselves, others follow U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {chr(b) if b in printable else chr(next(others)): b for b in range(256)}


def glyphs_to_bytes(token: str) -> bytes:
    return bytes([_glyphs()[c] for c in token])


@functools.lru_cache(maxsize=2)
def json_bpe(path: str) -> JsonBpe:
    return JsonBpe(path)


def cuts(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids: whole, or full pieces after a first that may be shorter."""
    first = total % length or min(total, length)
    return [(0, first), *((start, length) for start in range(first, total, length))]


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """__row (of the document's row), doc_id, piece, start, length, ids_crc32 of each piece."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = json_bpe(tokenizer_path)
        rows, cols = [], []
        for row, text in enumerate(batch.column(2)):
            ids = np.append(coder.encode(text.as_py()), END_ID).astype("<u4")
            for piece, (start, size) in enumerate(cuts(len(ids), length)):
                rows.append(row)
                cols.append((piece, start, size, zlib.crc32(ids[start : start + size])))
        made, at = np.array(cols, np.int64).reshape(-1, 4), pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, np.ascontiguousarray(made.T))], ["__row", "doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", F.col("text").cast("string")), fn, f"__row long, doc_id {kind}, {COLUMNS}")


# ---------------------------------------------------------------- patterns


def least_squares(columns: np.ndarray, want: np.ndarray, start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that brings |A x - want| down, A's columns given as rows of lengths (0: none), by accelerated projected gradients.

    A column's step is the inverse of its row of sums of A'A, a bound of A'A by a diagonal, so no step overshoots; the
    acceleration starts anew where the error grows.
    """
    width = len(want)
    some = (columns > 0).astype(float)
    times = lambda x: np.bincount(columns.ravel(), (some * x[:, None]).ravel(), width) * (np.arange(width) > 0)
    back = lambda r: (r[columns] * some).sum(1)
    bound = np.maximum(back(times(np.ones(len(columns)))), 1)
    x = y = start
    t, last = 1.0, np.inf
    for _ in range(steps):
        rest = want - times(y)
        error = float((rest**2).sum())
        if error > last:
            y, t = x, 1.0
            rest = want - times(y)
            error = float((rest**2).sum())
        last = error
        new = np.maximum(y + back(rest) / bound, 0)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / ahead * (new - x), ahead
    return np.maximum(x, 0)


def best_pairs(worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sum the worth of its best pair of lengths and the smaller of the two (0: no pair)."""
    room = len(worth)
    best, small = np.full(room, -np.inf), np.zeros(room, np.int64)
    for total in range(2, room):
        half = np.arange(1, total // 2 + 1)
        both = worth[half] + worth[total - half]
        i = int(both.argmax())
        if np.isfinite(both[i]):
            best[total], small[total] = both[i], half[i]
    return best, small


def wanted(rest: np.ndarray, have: np.ndarray, room: int, most: int) -> np.ndarray:
    """The triples and quadruples that fill `room` and gain most by the residual: the best for each first length or pair."""
    worth = np.where(have, rest, -np.inf)
    best, small = best_pairs(np.append(worth, -np.inf)[: room + 1])
    firsts = np.flatnonzero(have[:room])
    firsts = firsts[(firsts > 0) & (room - firsts >= 2)]
    gain3, sums = worth[firsts] + best[room - firsts], np.arange(2, room // 2 + 1)
    gain4 = best[sums] + best[room - sums]
    pair = lambda s: np.stack([small[s], s - small[s]], 1)
    found = np.concatenate([np.column_stack([firsts, pair(room - firsts), np.zeros(len(firsts), np.int64)]), np.column_stack([pair(sums), pair(room - sums)])])
    gain = np.concatenate([gain3, gain4])
    order = np.argsort(-gain, kind="stable")
    order = order[gain[order] > 1e-9][: 2 * most]
    return np.unique(np.sort(found[order], 1), axis=0)[:most] if len(order) else np.zeros((0, 4), np.int64)


def fit(counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of four lengths, 0: none) that fill `room`, and how often each is to be repeated (not yet rounded)."""
    have = counts > 0
    low = np.arange(1, room // 2 + 1)
    low = low[have[low] & have[room - low]]
    columns = np.column_stack([np.zeros((len(low), 2), np.int64), low, room - low])
    x = np.zeros(len(columns))
    most, total = np.inf, counts.sum()
    for _ in range(ROUNDS):
        x = least_squares(columns, counts, x) if len(columns) else x
        rest = counts - np.bincount(columns.ravel(), np.repeat(x, 4), len(counts)) * (np.arange(len(counts)) > 0)
        error = float(np.abs(rest).sum())
        if error <= 1e-3 * total or error > 0.99 * most:
            break
        most = error
        new = wanted(rest, have, room, NEW)
        if not len(new):
            break
        keep = x > 1e-3 * max(1.0, x.max(initial=0))
        columns, at = np.unique(np.concatenate([columns[keep], new]), axis=0, return_inverse=True)
        x = np.bincount(at, np.concatenate([x[keep], np.zeros(len(new))]), len(columns))
    return columns, x


def completion(left: np.ndarray, space: int) -> list[int]:
    """Of the lengths left, one, two or three that fill `space` best; fewer are taken where as good."""
    lengths = np.flatnonzero(left[: space + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    best = [int(lengths[-1])]
    if best[0] < space and len(lengths):
        ok = np.zeros(space + 1, bool)
        ok[lengths] = True
        for third in (0, *lengths[: -len(lengths) - 1 : -1][:64].tolist()):
            gap = space - third
            first = lengths[lengths <= gap]
            if not len(first):
                continue
            # the longest length that still fits beside each first one
            at = np.searchsorted(lengths, gap - first, side="right") - 1
            second = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
            sums = np.where(second > 0, first + second, 0) + third
            for i in np.argsort(-sums, kind="stable")[:8]:
                pick = [x for x in (int(first[i]), int(second[i]), third) if x]
                if sums[i] > sum(best) and all(left[x] >= pick.count(x) for x in pick):
                    best = pick
                    break
            if sum(best) == space:
                break
    return best


def best_fit(left: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and repeats that use up the counts `left` (index: length), longest first; each repeat uses up a length's count."""
    left, out = left.copy(), []
    while (lengths := np.flatnonzero(left)).size:
        longest = int(lengths[-1])
        uses, space = {longest: 1}, room - longest
        left[longest] -= 1
        while space > 3 * longest and (top := np.flatnonzero(left[: space + 1])).size:
            size = int(top[-1])
            n = int(max(1, min(left[size], (space - 3 * longest) // size)))
            uses[size], space, left[size] = uses.get(size, 0) + n, space - n * size, left[size] - n
        while pick := completion(left, space):
            for size in pick:
                uses[size], left[size], space = uses.get(size, 0) + 1, left[size] - 1, space - size
        more = min(int(left[size] // n) for size, n in uses.items())
        for size, n in uses.items():
            left[size] -= more * n
        out.append((uses, more + 1))
    return out


def plan(histogram: dict[int, int], room: int) -> pd.DataFrame:
    """Of counts by length: intervals (length, first, last (exclusive), each, sequence, place).

    The rank r of a length in [first, last) is in sequence `sequence` + (r - first) // each, from `place` +
    (r - first) % each * length on.
    """
    counts = np.zeros(room + 1)
    for size, n in histogram.items():
        counts[size] = n
    uses: list[tuple[dict[int, int], int]] = [({room: 1}, int(counts[room]))] if counts[room] else []
    counts[room] = 0
    left = counts.astype(np.int64)
    if left.any():
        columns, x = fit(counts, room)
        for j in np.argsort(-x, kind="stable"):
            sizes, each = np.unique(columns[j][columns[j] > 0], return_counts=True)
            times = int(min(np.floor(x[j] + 1e-6), (left[sizes] // each).min()))
            if times <= 0:
                continue
            left[sizes] -= times * each
            uses.append((dict(zip(sizes.tolist(), each.tolist(), strict=True)), times))
        uses += best_fit(left, room)
    rows, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in uses:
        place = 0
        for size in sorted(pattern, reverse=True):
            each = pattern[size]
            rows.append((size, taken[size], taken[size] + each * times, each, sequence, place))
            taken[size] += each * times
            place += each * size
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "last", "each", "sequence", "place"]).astype("int64")


def blocks(intervals: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(length, width): the ranks of a length in a block; and the intervals by each block that they reach into.

    A length has as many blocks as intervals, so the second is at most twice as long as the intervals are.
    """
    by = intervals.groupby("length").agg(ranks=("last", "max"), n=("first", "size"))
    by["width"] = -(-by["ranks"] // by["n"])
    widths = by["width"].reset_index()
    cut = intervals.merge(widths, on="length")
    low, high = cut["first"] // cut["width"], (cut["last"] - 1) // cut["width"]
    n = (high - low + 1).to_numpy()
    out = cut.loc[cut.index.repeat(n)].drop(columns="width").reset_index(drop=True)
    out["block"] = low.repeat(n).to_numpy() + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return widths, out


# ---------------------------------------------------------------- assignment


def _bounded(spark: SparkSession, rows: pd.DataFrame) -> DataFrame:
    """A table whose rows are bounded by the sequence length, not by the corpus."""
    return F.broadcast(spark.createDataFrame(rows))


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id (from 0 without gaps) and offset to pieces (__row, piece, length, ...) read from a written table."""
    spark, names = cut.sparkSession, [c for c in cut.columns if c != "__row"]
    totals = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `length` rows at most
    if not totals:
        return cut.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    share = max(256, -(-sum(totals.values()) // GROUPS))
    deals = pd.DataFrame([(size, -(-n // share)) for size, n in totals.items()], columns=["length", "deals"])
    dealt = cut.join(_bounded(spark, deals), "length").withColumn("__deal", F.pmod(F.xxhash64("__row", "piece"), "deals"))
    sizes = dealt.groupBy("length", "__deal").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "__deal"])  # GROUPS + `length` rows at most
    sizes["before"] = sizes.groupby("length")["n"].cumsum() - sizes["n"]
    widths, intervals = blocks(plan({int(c): int(n) for c, n in totals.items()}, length))
    ranked = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy("length", "__deal").orderBy("__row", "piece")))
    return (
        ranked.join(_bounded(spark, sizes[["length", "__deal", "before"]]), ["length", "__deal"])
        .join(_bounded(spark, widths), "length")
        .withColumn("__r", F.col("before") + F.col("__rn") - 1)
        .withColumn("__block", F.expr("__r div width"))
        .alias("p")
        .join(_bounded(spark, intervals).alias("s"), F.expr("p.length = s.length and p.__block = s.block and p.__r >= s.first and p.__r < s.last"))
        .select(
            *[F.col(f"p.{c}") for c in names],
            F.expr("s.sequence + (p.__r - s.first) div s.each").alias("sequence_id"),
            F.expr("s.place + (p.__r - s.first) % s.each * s.length").alias("offset"),
        )
    )


def pack_whole_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(durable(pieces(docs, tokenizer_path), "whole-pieces"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_whole_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

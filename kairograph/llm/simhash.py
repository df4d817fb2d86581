"""SimHash fingerprints linked by Golay-code fuzzy hashing.

Fingerprint. Words are maximal runs of anything but ASCII white space, A-Z lower-cased; each run of `width` words,
joined by one space, is hashed by XXH64 (seed 42); a bit is 1 if set in over half of the hashes, repeats included.

Links at 4 or fewer of 64 bits. The fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the
perfect binary Golay code (23 bits, 4096 codewords, every word within 3 bits of exactly one). Four errors in three
segments leave, by pigeonhole, either
  (i)  a segment without an error: its key is the segment's codeword index with its syndrome, that is its value; or
  (ii) two segments with at most one error each. If x, y differ in one bit, the codeword that x decodes to (distance
       <= 3) is within 4 of y. So x gives, for each pair of segments, the codeword of the first with every codeword
       within 4 of the second, y the reverse, and the two sets share a key: 24 bits, at most 6 keys a pair and side.
Every pair found so is verified by its bit count where it is found, so that only links leave it. Buckets that many
fingerprints share are dealt in blocks, each pair of which gives a row a fingerprint and not its links.

Equal fingerprints are one node; a group of copies, however large, costs one row in the joins. Rows of the search:
3 + 2 * 3 * (1 to 6) per distinct fingerprint. The expected chance pairs are n^2 * (3 / 2^22 + 3 * 28 / 2^25).
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import durable, hot_keys, map_arrow, salted_join
from kairograph.llm.components import components, local_components

GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the code's generator polynomial
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
MOST_BITS = 4
MOST_KEYS = 6  # Golay keys of a pair of segments
BUCKET = 512  # rows of a key that one join compares
CELLS = 1 << 20  # pairs compared at once in a block


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned fingerprint of one text; no word gives 0, fewer words than `width` one hash of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = max(len(words) - width + 1, 1)
    last = (starts + sizes)[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # so that a very long text needs no 64 bytes a word
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the carried columns and fp, the fingerprint's 64 bits as a signed long."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.schema.get_field_index("text"))
        found = np.fromiter((fingerprint(x.as_py(), width) for x in text), np.uint64, len(text)).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carry), pa.array(found)], [*carry, "fp"])

    return map_arrow(docs.select(*carry, F.col("text").cast("string")), fn, f"{fields}, fp long")


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """high: the syndrome of the upper 12 bits; flips: by syndrome, what turns a word into the codewords within 4 of
    it, nearest first, padded by the first; sizes: how many of them there are."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    high = np.array([syndrome(x << 11) for x in range(4096)], np.int64)
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            flip = sum(1 << b for b in bits)
            near[int(high[flip >> 11]) ^ (flip & 2047)].append(flip)
    sizes = np.array([len(x) for x in near], np.int64)
    flips = np.array([x + x[:1] * (int(sizes.max()) - len(x)) for x in near], np.int64)
    return high, flips, sizes


def golay_near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the codewords within 4, nearest first, and how many of each row are real."""
    high, flips, sizes = golay_tables()
    synd = high[words >> 11] ^ (words & 2047)
    return words[:, None] ^ flips[synd], sizes[synd]


def fuzzy_keys(fps: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of one side of join (ii)."""
    unsigned = fps.view(np.uint64)
    near = [golay_near(((unsigned >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for low, bits in SEGMENTS]
    rows, keys = [], []
    for pair, (a, b) in enumerate(combinations(range(3), 2)):
        one, many = (b, a) if second else (a, b)
        codes, sizes = near[many]
        row, col = np.nonzero(np.arange(codes.shape[1])[None, :] < sizes[:, None])
        first, other = near[one][0][row, 0] >> 11, codes[row, col] >> 11  # the upper 12 bits are a codeword's index
        ca, cb = (other, first) if second else (first, other)
        rows.append(row)
        keys.append((np.int64(pair) << 24) | (ca << 12) | cb)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame, second: bool) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = fuzzy_keys(fps, second)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    return map_arrow(nodes.select("fp"), fn, "key long, fp long")


def close_in_block(block: pa.Table) -> pa.Table:
    """(u, v) of rows (side, fp): each fingerprint with the least that links of the other side within four bits reach here."""
    side, fp = block.column("side").to_numpy(), block.column("fp").to_numpy()
    distinct, at = np.unique(fp, return_inverse=True)
    a, b = np.unique(at[side == 0]), np.unique(at[side == 1])
    label = np.arange(len(distinct))
    step = max(1, CELLS // max(len(b), 1))
    for first in range(0, len(a), step):
        part = a[first : first + step]
        i, j = np.nonzero(np.bitwise_count((distinct[part, None] ^ distinct[None, b]).view(np.uint64)) <= MOST_BITS)
        found = local_components(len(distinct), np.concatenate([part[i], np.arange(len(distinct))]), np.concatenate([b[j], label]))
        label = found
    moved = label != np.arange(len(distinct))
    return pa.table({"u": distinct[moved], "v": distinct[label[moved]]})


def close_pairs(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """(u, v) that join all pairs of a and b (key, fp) of one key and within four bits; `rows` of both together.

    A pair must meet in both orders of a and b, as it does in links().

    A bucket of up to BUCKET rows is compared within the join and gives its pairs. A larger one is dealt by hash into
    blocks, and each pair of blocks is a group that returns one row a fingerprint: its least in the group's components.
    """
    both = a.select("key", "fp", F.lit(0).alias("side")).union(b.select("key", "fp", F.lit(1).alias("side")))
    hot = F.broadcast(hot_keys(both, ["key"], rows, BUCKET))
    close = F.expr(f"a.key = b.key and a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {MOST_BITS}")
    cold_a, cold_b = (x.join(hot, "key", "left_anti") for x in (a, b))
    found = cold_a.alias("a").hint("merge").join(cold_b.alias("b"), close).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    dealt = both.join(hot, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = F.col("side") == 0
    dealt = dealt.select("key", F.when(first, F.col("mine")).otherwise(F.col("other")).alias("x"), F.when(first, F.col("other")).otherwise(F.col("mine")).alias("y"), "side", "fp")
    return found.union(dealt.groupBy("key", "x", "y").applyInArrow(close_in_block, "u long, v long"))


def links(nodes: DataFrame) -> DataFrame:
    """Of distinct fingerprints fp: pairs (u, v) that join all of them at 1 to 4 differing bits, as close_pairs() does."""
    values = F.array(*[F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1) + (i << 22) for i, (low, bits) in enumerate(SEGMENTS)])
    exact = nodes.select(F.explode(values).alias("key"), "fp")
    number = nodes.count()
    same = close_pairs(exact, exact, 2 * len(SEGMENTS) * number)
    return same.union(close_pairs(_keyed(nodes, False), _keyed(nodes, True), 2 * len(SEGMENTS) * MOST_KEYS * number))


def link_classes(prints: DataFrame) -> DataFrame:
    """Of rows with fp: (fp, class), where class is the smallest fp reachable; only fps that link with another."""
    return components(links(prints.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("component").alias("class"))


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """One row per document (doc_id, text): doc_id, fp, component_id, the smallest doc_id reachable.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows keep their number. A null
    doc_id takes part, but is a component's id only if all its ids are null. An empty table gives no rows.
    """
    prints = durable(fingerprints(docs.select("doc_id", "text"), width), "prints")
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    classes = durable(link_classes(nodes), "classes")
    linked = classes.join(nodes.select("fp", "least"), "fp")
    ids = linked.groupBy("class").agg(F.min("least").alias("c"))
    named = salted_join(linked.select("fp", "class"), ids, ["class"], hot_keys(classes, ["class"], classes.count(), BUCKET), ["fp"]).select("fp", "c")
    by_fp = nodes.join(named, "fp", "left").select("fp", F.coalesce("c", "least").alias("component_id"))
    hot = hot_keys(nodes, ["fp"], prints.count(), BUCKET, F.col("n"))
    return salted_join(prints, by_fp, ["fp"], hot, ["doc_id"]).select("doc_id", "fp", "component_id")


def op6(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of the table documents by four-word shingles."""
    from kairograph.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

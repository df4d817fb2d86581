"""One document of each group of near copies: SimHash candidates by Golay keys, verified by shingles.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; groups are the
connected components. Candidates are found in two ways, either of which suffices.
  - They differ in at most four bits of one of SEEDS fingerprints over the set of words: a few scattered changes change
    many shingles but few words.
  - They agree in one of BANDS bands of ROWS minimum hashes each over the shingles. A minimum is equal with the
    probability of the Jaccard similarity itself, wherever the texts differ, so this holds for passages appended, cut
    off or replaced as well: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^24 = 0.00007.
Texts with equal words in order are one node, named by their 64-bit hash.

A large group of near copies has links in the square of its size, so neither candidates nor links are made as rows.
First each node is compared with the next few of each of its exact segments' buckets, and joined to the least node of
each of its bands and fingerprints, a number of pairs linear in the nodes. Nodes of one fingerprint are so in one
component, and the full search takes distinct fingerprints and returns pairs of components; a bucket of over BUCKET
fingerprints is dealt in blocks, each pair of which returns one row a component. Both together give the components of
the candidate graph.

These are verified in two steps. A component's nodes are dealt into blocks of about BLOCK nodes or BLOCK_BYTES of
shingles (small components share one), and each block compares its own candidates and those with REPS nodes that all
blocks of the component get. What that joins is a class. Only nodes of different classes are left to compare: each large
class has blocks of its own, the small ones of a component are mixed, and each pair of blocks but those of one large
class is a group. A group of copies that the first step joins whole is so never spread in its square. No candidate pair
is left out, and joins on keys that many nodes share are dealt over parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.chars import mix
from kairograph.llm.common import HOT_KEYS, durable, hot_keys, map_arrow, salted_join
from kairograph.llm.components import components, local_components
from kairograph.llm.simhash import CELLS, MOST_BITS, MOST_KEYS, SEGMENTS, fuzzy_keys

SEEDS = 3
BANDS, ROWS = 24, 5
WIDTH = 5
SIMILARITY = 0.8
NEXT = 4  # nodes of a bucket that each is compared with at first
BUCKET = 512
BLOCK = 256
BLOCK_BYTES = 8 << 20
REPS = 4  # nodes that all blocks of a component are compared with
MINIMA = 1 << 12  # shingles hashed at once


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_of(found: list[bytes]) -> int:
    """The signed 64-bit name of a text: a hash of its words in order."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(found), 1)).astype(np.int64))


def set_fingerprints(found: list[bytes], seeds: int = SEEDS) -> np.ndarray:
    """Fingerprints (signed) over the set of words; no word gives 0."""
    if not found:
        return np.zeros(seeds, np.int64)
    digest = xxhash.xxh64_intdigest
    base = np.fromiter((digest(w, 42) for w in set(found)), np.uint64)
    out = []
    for seed in range(seeds):
        hashes = mix(mix(base + np.uint64(seed) * np.uint64(0x632BE59BD9B4E019))) if seed else base
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).view(">i8")[0])
    return np.array(out, np.int64)


def shingles(found: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; fewer words than `width` are one shingle, none are none."""
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + width])) for i in range(max(len(found) - width + 1, 1))), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The signed key of each band of the hashes of one text's shingles; no shingle gives zeros."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    draw = mix(mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)))
    turn, times = draw[0::2], draw[1::2] | np.uint64(1)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), MINIMA):
        np.minimum(least, ((hashes[at : at + MINIMA, None] ^ turn) * times).min(0), out=least)
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        key = mix(key ^ least[:, row])
    return key.view(np.int64)


def _prints(docs: DataFrame) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.empty((batch.num_rows, 1 + SEEDS), np.int64)
        bands = np.empty((batch.num_rows, BANDS), np.int64)
        for row, text in enumerate(batch.column(1)):  # one text's words at a time
            found = words(text.as_py())
            out[row, 0] = node_of(found)
            out[row, 1:] = set_fingerprints(found)
            bands[row] = band_keys(shingles(found))
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(out.T)), held], ["doc_id", "node", *(f"f{k}" for k in range(SEEDS)), "bands"])

    fields = ", ".join(f"f{k} long" for k in range(SEEDS))
    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, {fields}, bands array<long>")


def _segments(seed: int) -> list:
    f = F.col(f"f{seed}")
    return [F.lit((seed * 3 + i) << 22) + F.shiftrightunsigned(f, low).bitwiseAND((1 << bits) - 1) for i, (low, bits) in enumerate(SEGMENTS)]


def window_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): each node with the next NEXT nodes of each bucket of its exact segments, if within four bits; repeats are possible.

    A bucket of over BUCKET nodes is dealt by a hash into parts of about that size, so that no task orders it whole.
    """
    keyed = nodes.select("node", F.explode(F.array(*[F.struct(k.alias("key"), F.col(f"f{s}").alias("fp")) for s in range(SEEDS) for k in _segments(s)])).alias("k")).select("node", "k.key", "k.fp")
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key", F.ceil(F.col("n") / BUCKET).alias("parts"))
    dealt = keyed.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("node", "key"), F.coalesce("parts", F.lit(1))))
    order = Window.partitionBy("key", "part").orderBy("node")
    ahead = dealt.select("node", "fp", F.array(*[F.struct(F.lead("node", i).over(order).alias("node"), F.lead("fp", i).over(order).alias("fp")) for i in range(1, NEXT + 1)]).alias("ahead"))
    close = F.filter("ahead", lambda m: F.coalesce(F.bit_count(F.col("fp").bitwiseXOR(m["fp"])) <= MOST_BITS, F.lit(False)))
    return ahead.select(F.col("node").alias("u"), F.explode(F.transform(close, lambda m: m["node"])).alias("v"))


def _hot(counted: DataFrame, keys: list[str], total: int, most: int = BUCKET) -> DataFrame:
    """As common.hot_keys(), of a table that holds the numbers of rows n of its keys already."""
    least = max(most, -(-total // HOT_KEYS))
    return counted.where(F.col("n") > least).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("parts"))


def shared_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): each node with the least node of each of its bands and fingerprints; so a key's nodes meet without their square.

    Repeats are possible.
    """
    prints = F.array(*[F.struct(F.lit(s).alias("of"), F.col(f"f{s}").alias("key")) for s in range(SEEDS)])
    bands = F.transform("bands", lambda key: F.struct(F.lit(SEEDS).alias("of"), key.alias("key")))
    keyed = nodes.select("node", F.explode(F.concat(prints, bands)).alias("k")).select("node", "k.of", "k.key")
    shared = keyed.groupBy("of", "key").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1")
    shared = durable(shared, "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = salted_join(keyed, shared.select("of", "key", "u"), ["of", "key"], _hot(shared, ["of", "key"], total), ["node"])
    return met.where("node > u").select("u", F.col("node").alias("v"))


def _fuzzy(prints: DataFrame, second: bool) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, keys = fuzzy_keys(batch.column(1).to_numpy(zero_copy_only=False), second)
        at = pa.array(rows)
        keys = keys + (batch.column(0).to_numpy().astype(np.int64)[rows] << 26)
        return pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1).take(at), batch.column(2).take(at)], ["key", "fp", "comp"])

    return map_arrow(prints.select("seed", "fp", "comp"), fn, "key long, fp long, comp long")


def joined_components(block: pa.Table) -> pa.Table:
    """(u, v) of rows (side, fp, comp): each component with the least that pairs of unlike sides within four bits join it to here."""
    side, fp = block.column("side").to_numpy(), block.column("fp").to_numpy()
    names, comp = np.unique(block.column("comp").to_numpy(), return_inverse=True)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    label = np.arange(len(names))
    step = max(1, CELLS // max(len(b), 1))
    for first in range(0, len(a), step):
        part = a[first : first + step]
        near = (comp[part, None] != comp[None, b]) & (np.bitwise_count((fp[part, None] ^ fp[None, b]).view(np.uint64)) <= MOST_BITS)
        i, j = np.nonzero(near)
        label = local_components(len(names), np.concatenate([comp[part[i]], np.arange(len(names))]), np.concatenate([comp[b[j]], label]))
    moved = label != np.arange(len(names))
    return pa.table({"u": names[moved], "v": names[label[moved]]})


def _close(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """(u, v) that join the components of all pairs of a and b (key, fp, comp) of one key and within four bits.

    A pair must meet in both orders of a and b. A key of up to BUCKET of the `rows` rows is compared within the join; a
    larger one is dealt by a hash into blocks, each pair of which is a group.
    """
    both = a.withColumn("side", F.lit(0)).union(b.withColumn("side", F.lit(1)))
    hot = F.broadcast(durable(hot_keys(both, ["key"], rows, BUCKET), "hot"))
    close = F.expr(f"a.key = b.key and a.comp < b.comp and bit_count(a.fp ^ b.fp) <= {MOST_BITS}")
    cold_a, cold_b = (x.join(hot, "key", "left_anti") for x in (a, b))
    found = cold_a.alias("a").hint("merge").join(cold_b.alias("b"), close).select(F.col("a.comp").alias("u"), F.col("b.comp").alias("v"))
    dealt = both.join(hot, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = F.col("side") == 0
    dealt = dealt.select("key", F.when(first, F.col("mine")).otherwise(F.col("other")).alias("x"), F.when(first, F.col("other")).otherwise(F.col("mine")).alias("y"), "side", "fp", "comp")
    return found.union(dealt.groupBy("key", "x", "y").applyInArrow(joined_components, "u long, v long"))


def cross_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v) that join the components of all nodes (node, comp, f0, ...) within four bits of one fingerprint.

    Nodes of one fingerprint must be in one component, as shared_pairs() puts them.
    """
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"f{s}").alias("fp")) for s in range(SEEDS)]))
    prints = durable(nodes.select("comp", each.alias("p")).groupBy("p.seed", "p.fp").agg(F.first("comp").alias("comp")), "distinct")
    number = prints.count()
    segments = F.array(*[(F.col("seed") * 3 + i) * (1 << 22) + F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1) for i, (low, bits) in enumerate(SEGMENTS)])
    exact = prints.select(F.explode(segments).alias("key"), "fp", "comp")
    same = _close(exact, exact, 2 * len(SEGMENTS) * number)
    return same.union(_close(_fuzzy(prints, False), _fuzzy(prints, True), 2 * len(SEGMENTS) * MOST_KEYS * number))


def shingle_sets(nodes: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, s): the sorted shingle hashes of each of the nodes; only their texts, one a node, are read again."""
    ids = prints.where("doc_id is not null").join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [(node_of(w), shingles(w).tobytes()) for w in (words(x.as_py()) for x in batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array([s for _, s in made], pa.binary())], ["node", "s"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids.select("doc_id"), "doc_id", "left_semi").select("text")
    return map_arrow(texts, sets, "node long, s binary").dropDuplicates(["node"])


def joined_in_block(block: pa.Table, similarity: float = SIMILARITY) -> pa.Table:
    """(u, v) of the rows (node, comp, class, fps, bands, s) of a pair of blocks: each node with the least of its component there.

    Nodes of one class are joined already.
    """
    node, comp = block.column("node").to_numpy(), block.column("comp").to_numpy()
    order = np.argsort(node)
    node, comp = node[order], comp[order]
    _, least, own = np.unique(block.column("class").to_numpy()[order], return_index=True, return_inverse=True)
    prints = [block.column(f"f{k}").to_numpy()[order] for k in range(SEEDS)]
    bands = np.ascontiguousarray(pc.list_flatten(block.column("bands")).to_numpy().reshape(-1, BANDS)[order].T)
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("s")]
    sets = [sets[i] for i in order.tolist()]
    sizes = np.array([len(x) for x in sets])
    parent = least[own].tolist()

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(node) - 1):
        rest = slice(i + 1, None)
        near = np.zeros(len(node) - i - 1, bool)
        for f in prints:
            near |= np.bitwise_count((f[rest] ^ f[i]).view(np.uint64)) <= MOST_BITS
        near |= (bands[:, rest] == bands[:, i, None]).any(0)
        near &= (comp[rest] == comp[i]) & (own[rest] != own[i]) & (np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i])) & (sizes[rest] > 0)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if (a := find(i)) != (b := find(j)):
                small, large = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if both >= similarity * (len(small) + len(large) - both):
                    parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(len(node))], np.int64)
    moved = root != np.arange(len(node))
    return pa.table({"u": node[moved], "v": node[root[moved]]})


def _blocks() -> Column:
    """How many blocks n nodes with shingles of `bytes` bytes make."""
    return F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("long")


def representatives(big: DataFrame) -> DataFrame:
    """Up to REPS rows of each comp, which its hashes choose; big holds comp, node and other columns."""
    chosen = big.groupBy("comp").agg(*[F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node"))["node"].alias(f"r{k}") for k in range(REPS)])
    chosen = chosen.select(F.explode(F.array_distinct(F.array(*[f"r{k}" for k in range(REPS)]))).alias("node"))
    return big.join(chosen, "node", "left_semi")


def first_blocks(dealt: DataFrame, bins: int) -> DataFrame:
    """dealt (placed columns, class, blocks) with (big, x, y): small components share bins; large ones lie in blocks with the representatives."""
    zero = F.lit(0).cast("long")
    one = dealt.where("blocks = 1").select(zero.alias("big"), F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("x"), zero.alias("y"), *dealt.columns)
    big, mine = dealt.where("blocks > 1"), F.pmod(F.xxhash64("node"), "blocks")
    many = big.select(F.col("comp").alias("big"), mine.alias("x"), zero.alias("y"), *dealt.columns)
    others = F.explode(F.filter(F.sequence(zero, F.col("blocks") - 1), lambda x: x != mine))
    guests = representatives(big).select(F.col("comp").alias("big"), others.alias("x"), zero.alias("y"), *dealt.columns)
    return one.union(many).union(guests)


def class_blocks(rows: DataFrame, total: int) -> DataFrame | None:
    """rows (placed columns, class) with (big, x, y): all pairs of blocks of a component that hold unlike classes; None if there are none.

    A class of a quarter of a block or more has blocks of its own; the others of a component are mixed, slot 0.
    """
    sizes = durable(rows.groupBy("comp", "class").agg(F.count("*").alias("n"), F.sum(F.octet_length("s")).alias("bytes")), "classes")
    own = (F.col("n") >= BLOCK // 4) | (F.col("bytes") >= BLOCK_BYTES // 4)
    slotted = sizes.withColumn("own", own).withColumn("slot", F.when(own, F.col("class")).otherwise(0))
    slots = slotted.groupBy("comp", "own", "slot").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes")).withColumn("blocks", _blocks())
    of, before = Window.partitionBy("comp"), Window.partitionBy("comp").orderBy("own", "slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("*", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("low"), F.sum("blocks").over(of).alias("all"), F.sum("classes").over(of).alias("unlike"))
    slots = durable(slots.where("unlike > 1"), "slots")
    if slots.isEmpty():
        return None
    keys = ["comp", "own", "slot"]
    hot = _hot(slots.select(*keys, F.col("classes").alias("n")), keys, total)
    laid = salted_join(slotted.select("class", *keys), slots.select(*keys, "blocks", "low", "all"), keys, hot, ["class"]).drop("slot")
    rows = salted_join(rows, laid, ["comp", "class"], _hot(sizes, ["comp", "class"], total), ["node"])
    none = F.array().cast("array<bigint>")
    up_to = lambda low, high: F.when(high > low, F.sequence(low.cast("long"), high.cast("long") - 1)).otherwise(none)
    zero, end = F.lit(0), F.col("low") + F.col("blocks")
    others = F.when(F.col("own"), F.concat(up_to(zero, F.col("low")), up_to(end, F.col("all")))).otherwise(up_to(zero, F.col("all")))
    met = rows.withColumn("mine", F.col("low") + F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(others))
    return met.select(F.col("comp").alias("big"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), *[c for c in rows.columns if c not in ("own", "blocks", "low", "all")])


def verified(candidates: DataFrame, nodes: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) that join what is alike in each component of candidates (node, component)."""
    placed = durable(nodes.join(candidates, "node").join(shingle_sets(candidates, prints, docs), "node").withColumnRenamed("component", "comp"), "sets")
    spread = placed.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("s")).alias("bytes"))
    spread = durable(spread.withColumn("blocks", _blocks()), "spread")
    small = F.col("blocks") == 1
    total, number, size, blocks = (x or 0 for x in spread.agg(F.sum("n"), F.sum(F.when(small, F.col("n"))), F.sum(F.when(small, F.col("bytes"))), F.max("blocks")).first())
    bins = int(max(1, number // BLOCK, size // BLOCK_BYTES))
    dealt = salted_join(placed, spread.select("comp", "blocks"), ["comp"], _hot(spread, ["comp"], total), ["node"])

    def join(block: pa.Table) -> pa.Table:
        return joined_in_block(block)

    def found(blocks: DataFrame) -> DataFrame:
        return blocks.drop("blocks").groupBy("big", "x", "y").applyInArrow(join, "u long, v long")

    first = found(first_blocks(dealt.withColumn("class", F.col("node")), bins))
    if blocks <= 1:
        return first
    first = durable(first, "first")
    classes = durable(components(first), "joined")
    rows = dealt.where("blocks > 1").drop("blocks").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    rest = class_blocks(rows, total)
    return first if rest is None else first.union(found(rest))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, f0, ..., bands) of every row, and (node, component) of every node that has a near copy."""
    prints = durable(_prints(docs), "prints")
    fps = [f"f{k}" for k in range(SEEDS)]
    nodes = durable(prints.where("doc_id is not null").groupBy("node").agg(*[F.first(f).alias(f) for f in (*fps, "bands")]), "nodes")
    joined = durable(components(window_pairs(nodes).union(shared_pairs(nodes))), "joined")
    placed = durable(nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), *fps), "placed")
    stars = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))  # all that those pairs join, an edge a node
    candidates = durable(components(stars.union(cross_pairs(placed))), "candidates")
    return prints, components(verified(candidates, nodes, prints, docs))


def with_node(docs: DataFrame) -> DataFrame:
    """(row, id, node): each row of docs whole, its doc_id and its text's node."""

    @F.pandas_udf("long")
    def node(texts):
        return texts.map(lambda x: node_of(words(x))).astype("int64")

    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), node(F.col("text").cast("string")).alias("node"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but the least doc_id of each group of near copies.

    Of repeated rows of a doc_id that stays one stays in each group; rows of one doc_id with unlike texts are in groups
    of their own. Rows with a null doc_id stay as they are and compare with nothing. Texts without a word are equal to
    each other and like no other.
    """
    prints, joined = groups(docs)
    ids = prints.where("doc_id is not null").join(joined, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("comp"))
    pairs = durable(ids.groupBy("doc_id", "node").agg(F.min("comp").alias("comp"), F.count("*").alias("times")), "ids")
    least = pairs.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    sizes = durable(pairs.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    judged = durable(salted_join(pairs, least, ["comp"], _hot(sizes, ["comp"], total), ["node"]).select("doc_id", "node", "times", (F.struct("doc_id", "node") == F.col("least")).alias("stays")), "judged")
    per_id = judged.groupBy("doc_id").agg(F.sum("times").alias("times"), F.bool_or("stays").alias("stays"))
    gone = durable(per_id.where("not stays or times > 1").select(F.col("doc_id").alias("__id"), F.col("stays").alias("__again")), "gone")
    ids, again = gone.select("__id").alias("g"), gone.where("__again").select("__id").alias("g")
    same = F.expr("d.doc_id = g.__id")
    out = docs.alias("d").join(ids, same, "left_anti")
    if again.isEmpty():
        return out
    rows = with_node(docs.alias("d").join(again, same, "left_semi"))
    kept = rows.alias("r").join(judged.where("stays").alias("j"), F.expr("r.id = j.doc_id and r.node = j.node"), "left_semi")
    return out.unionByName(kept.dropDuplicates(["id", "node"]).select("row.*"))

"""Near-duplicate embeddings by product quantisation: inverted lists, table-lookup distances, exact rerank.

Vectors are normalised in double precision; equal ones are one class with a multiplicity. Coarse centroids, and with
many vectors a second level of centroids of what the first leaves, make the inverted lists, whose number follows the
number of vectors: about LIST_SIZE to a list. Residuals are coded by the nearest of CODEWORDS codewords in each of some
subspaces. All are fitted on a bounded sample; every vector is indexed, with the length of what its code leaves out.

Sufficient probes. If x and y lie in different lists, their distances to the plane between the two centroids add up to
their difference along that plane's normal, so one of them is within half of it: each vector visits the lists to whose
plane it is within `margin`. That of no lost pair would be r / 2 with r = sqrt(2 - 2 * cosine), but a difference lies
almost never along a normal: `margin` is fitted, on pairs at just the cosine wanted made from the sample, as what MEET of
them need, in random directions and in those between sample vectors. A member passes the lookup distance if that is at
most r plus what its code leaves out, which loses none. What passes is reranked by exact cosine.

A vector is sent once to each list it lies in or visits. The rows of a hot list are dealt by hash into blocks of about
BLOCK, and each pair of blocks is one group, so neither a hot list nor a hot vector meets in one task. A group returns,
per class, a count of links and its component within the group, never pairs; a pair that both would find is counted in
the smaller list alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairograph.llm.common import durable, hot_keys, salted_join, small_batches, table
from kairograph.llm.components import components, local_components

COSINE = 0.95
SAMPLE_FLOATS = 1_500_000
LIST_SIZE = 256
COARSE, FINE = 1024, 4096  # centroids of the two levels at most
SUBSPACES = 8
CODEWORDS = 256
BLOCK = 1024
MEET = 0.9995
CELLS = 1 << 21  # of a table of distances held at once
SLACK = 1e-3  # of single-precision table sums


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most k centroids of x; empty ones keep their place."""
    noise = np.random.default_rng(seed)
    centres = x[noise.permutation(len(x))[:k]].astype(np.float64).copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=len(centres))
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _to_planes(x: np.ndarray, home: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of x to the planes between their home and each centroid."""
    square = (centres**2).sum(1)
    d2 = square - 2 * x @ centres.T
    gap = np.sqrt(np.maximum(square[home][:, None] + square - 2 * centres[home] @ centres.T, 1e-18))
    out = (d2 - d2[np.arange(len(x)), home][:, None]) / (2 * gap)
    out[np.arange(len(x)), home] = 0
    return out


@dataclass
class PqIndex:
    centres: np.ndarray  # coarse x dimensions
    fine: np.ndarray  # of what the coarse centroids leave; a single zero if there is one level
    books: list[np.ndarray]  # per subspace: codewords x its dimensions
    cuts: np.ndarray  # the subspaces' bounds
    radius: float
    margin: float

    def home(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: coarse * number of fine + fine."""
        coarse = nearest(x, self.centres)
        return coarse * len(self.fine) + nearest(x - self.centres[coarse], self.fine)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def probes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that each vector lies in or visits, by row and list."""
        k = len(self.fine)
        rows, lists = np.nonzero(_to_planes(x, home // k, self.centres) <= self.margin)
        if k > 1:
            found = []
            for at in range(0, len(rows), max(1, CELLS // k)):
                r, c = rows[at : at + max(1, CELLS // k)], lists[at : at + max(1, CELLS // k)]
                rest = x[r] - self.centres[c]
                i, j = np.nonzero(_to_planes(rest, nearest(rest, self.fine), self.fine) <= self.margin)
                found.append((r[i], c[i] * k + j))
            rows, lists = (np.concatenate(z) for z in zip(*found, strict=True))
        return rows, lists

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the lengths of what they leave out."""
        rest = x - self.centre(home)
        codes = np.empty((len(x), len(self.books)), np.uint8)
        left = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = nearest(part, book)
            left += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def lookup(self, x: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded members of one list, by one table a subspace."""
        rest = x - self.centre(np.array([of]))
        out = np.zeros((len(x), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            tab = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += tab.astype(np.float32)[:, codes[:, m]]
        return out


def _turned(x: np.ndarray, towards: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at the cosine from x, each in the plane of x and `towards`; where that is none, x."""
    w = towards - (towards * x).sum(1)[:, None] * x
    size = np.sqrt((w**2).sum(1))[:, None]
    w = np.divide(w, size, out=np.zeros_like(w), where=size > 1e-9)
    out = cosine * x + np.sqrt(max(1 - cosine**2, 0)) * w
    return out / np.sqrt((out**2).sum(1))[:, None]


def fitted_margin(sample: np.ndarray, centres: np.ndarray, cosine: float, radius: float, seed: int = 1) -> float:
    """The least margin by which MEET of pairs at the cosine meet, a fifth more, radius / 2 at most."""
    noise = np.random.default_rng(seed)
    x = sample[noise.permutation(len(sample))[:4096]]
    needed = []
    for towards in (noise.normal(size=x.shape), sample[noise.integers(0, len(sample), len(x))]):
        y = _turned(x, towards, cosine)
        hx, hy = nearest(x, centres), nearest(y, centres)
        apart = hx != hy
        both = np.zeros(len(x))
        if apart.any():
            x1, y1, a, b = x[apart], y[apart], hx[apart], hy[apart]
            gap = np.sqrt(((centres[a] - centres[b]) ** 2).sum(1))
            of_x = (((x1 - centres[b]) ** 2).sum(1) - ((x1 - centres[a]) ** 2).sum(1)) / (2 * gap)
            of_y = (((y1 - centres[a]) ** 2).sum(1) - ((y1 - centres[b]) ** 2).sum(1)) / (2 * gap)
            both[apart] = np.minimum(of_x, of_y)
        needed.append(np.quantile(both, MEET))
    return float(min(1.2 * max(needed) + 1e-6, radius / 2))


def fit(sample: np.ndarray, total: int, cosine: float = COSINE, margin: float | None = None) -> PqIndex:
    """An index for `total` unit vectors from a sample of them."""
    radius = float(np.sqrt(max(2 - 2 * cosine, 0)))
    wanted = max(1, total // LIST_SIZE)
    centres = kmeans(sample, min(COARSE, wanted, max(1, len(sample) // 4)))
    rest = sample - centres[nearest(sample, centres)]
    more = min(FINE, wanted // len(centres), max(1, len(sample) // 4))
    fine = kmeans(rest, more, seed=3) if more > 1 else np.zeros((1, sample.shape[1]))
    rest = rest - fine[nearest(rest, fine)]
    cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    books = [kmeans(np.ascontiguousarray(rest[:, a:b]), CODEWORDS, 6, m + 1) for m, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    if margin is None:
        margin = fitted_margin(sample, centres, cosine, radius)
        if len(fine) > 1:
            margin = max(margin, fitted_margin(sample, (centres[:, None] + fine[None, : max(1, 65536 // len(centres))]).reshape(-1, sample.shape[1]), cosine, radius))
    return PqIndex(centres, fine, books, cuts, radius, margin + 1e-9)


def units(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors at length 1, scaled by their largest component first, so that no square overflows or vanishes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v): floats stay floats, other numbers are doubles; v is null for a vector that can't link.

    A vector links if its id isn't null, and it has components, none of them null or non-finite, not all of them zero.
    """
    kind = rows.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    of = "float" if single else "double"
    v = F.col("embedding").cast(f"array<{of}>")
    fine = f"vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {of}('infinity')) and exists(v, x -> x <> 0)"
    found = rows.select("vec_id", v.alias("v"))
    positive = f"transform(v, x -> x + cast(0 as {of}))"  # no negative zeros, which would hash apart
    return found.select("vec_id", F.expr(f"case when {fine} then {positive} end").alias("v"))


def linked(block: pa.Table, index: PqIndex, cosine: float) -> pa.Table:
    """(node, links, least) of one pair of blocks of a list: links to add to each class, and its component's least here."""
    of, gx, gy = (block.column(c)[0].as_py() for c in ("list", "x", "y"))
    x = units(block.column("v"), index.centres.shape[1])
    node, mult, home, blk = (block.column(c).to_numpy() for c in ("node", "mult", "home", "blk"))
    codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), np.uint8).reshape(len(node), -1)
    reach = ((index.radius + block.column("left").to_numpy() + SLACK) ** 2).astype(np.float32)
    member = home == of
    first, second = np.flatnonzero(blk == gx), np.flatnonzero(blk == gy)
    asked = [(first, second[member[second]])]
    if gx != gy:
        asked.append((second[~member[second]], first[member[first]]))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for queries, members in asked:
        step = max(1, CELLS // max(len(members), 1))
        for at in range(0, len(queries) if len(members) else 0, step):
            q = queries[at : at + step]
            near = index.lookup(x[q], of, codes[members]) <= reach[members]
            if gx == gy:  # two members meet twice, and each itself
                near &= (q[:, None] < members) | ~member[q][:, None]
            i, j = np.nonzero(near)
            i, j = q[i], members[j]
            for k in range(0, len(i), 65536):
                u, w = i[k : k + 65536], j[k : k + 65536]
                keep = np.einsum("ij,ij->i", x[u], x[w]) >= cosine
                a.append(u[keep])
                b.append(w[keep])
    i, j = np.concatenate(a), np.concatenate(b)
    counted = np.ones(len(i), bool)
    cross = np.flatnonzero(~member[i])  # visitors: their own list finds the pair too if the member visits it
    if len(cross):
        some, at = np.unique(j[cross], return_inverse=True)
        rows, lists = index.probes(x[some], home[some])
        wide = len(index.centres) * len(index.fine)
        both = np.isin(at * wide + home[i[cross]], rows * wide + lists)
        counted[cross] = ~both | (of < home[i[cross]])
    ci, cj = i[counted], j[counted]
    links = (np.bincount(ci, mult[cj], len(node)) + np.bincount(cj, mult[ci], len(node))).astype(np.int64)
    label = local_components(len(node), i, j)
    some = (links > 0) | (label != np.arange(len(node)))
    return pa.table({"node": node[some], "links": links[some], "least": node[label[some]]})


def _fit_all(rows: DataFrame, sizes: dict[int, int], cosine: float, margin: float | None) -> dict[int, PqIndex]:
    """An index for each length of vectors, from a sample by a hash of about SAMPLE_FLOATS numbers over all lengths."""
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40))
    cuts = rows.sparkSession.createDataFrame([(s, int((1 << 40) * min(1.0, SAMPLE_FLOATS / len(sizes) / s / n))) for s, n in sizes.items()], "size int, cut long")
    picked = rows.withColumn("size", F.size("v")).join(F.broadcast(cuts), "size").where(place < F.col("cut")).select("size", "v")  # a row a length
    got = picked.toArrow()
    out = {}
    for size, total in sizes.items():
        part = got.filter(pc.equal(got.column("size"), size)).column("v")
        x = units(part, size) if len(part) else np.eye(1, size)
        out[size] = fit(np.unique(x, axis=0), total, cosine, margin)
    return out


def _in_blocks(found: DataFrame) -> DataFrame:
    """Rows of lists, dealt to the pairs of blocks (size, list, x, y); blk is a row's own block."""
    total = found.count()
    hot = hot_keys(found, ["size", "list"], total, BLOCK)
    dealt = found.join(F.broadcast(hot), ["size", "list"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("x", F.least("blk", "other")).withColumn("y", F.greatest("blk", "other")).drop("parts", "other")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, margin: float | None = None) -> DataFrame:
    """One row per row (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that can't link (see vectors()) have no links and are their own component; unlike lengths don't link.
    Repeated rows of one vec_id are vectors of their own that link. No rows give no rows. `margin`: of the probes; half
    the radius loses no pair, None fits one.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = vectors(rows)
    usable = rows.where("v is not null")
    sizes = {r["size"]: r["n"] for r in usable.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()}  # a row a length
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    if not sizes:
        return alone.select("*", kept)
    sent = spark.sparkContext.broadcast(_fit_all(usable, sizes, cosine, margin))  # COARSE + FINE centroids and CODEWORDS codewords a length at most
    kind = rows.schema["v"].dataType.simpleString()
    id_kind = rows.schema["vec_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = pc.list_value_length(batch.column("v"))
            for size in pc.unique(wide).to_pylist():
                part = batch.filter(pc.equal(wide, size))
                index, x = sent.value[size], units(part.column("v"), size)
                home = index.home(x)
                codes, left = index.code(x, home)
                at, lists = index.probes(x, home)
                offsets = np.zeros(len(x) + 1, np.int32)
                np.cumsum(np.bincount(at, minlength=len(x)), out=offsets[1:])
                more = [pa.array(np.full(len(x), size, np.int32)), pa.array(home), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "size", "home", "codes", "left", "lists"])

    classes = usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("node", F.monotonically_increasing_id())
    encoded = durable(classes.mapInArrow(encode, f"v {kind}, rep {id_kind}, mult long, node long, size int, home long, codes binary, left double, lists array<long>"), "vectors")
    placed = encoded.select("size", "node", "mult", "v", "home", "codes", "left", F.explode("lists").alias("list"))

    def search(block: pa.Table) -> pa.Table:
        return linked(block, sent.value[block.column("size")[0].as_py()], cosine)

    found = durable(_in_blocks(placed).groupBy("size", "list", "x", "y").applyInArrow(search, "node long, links long, least long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = durable(components(found.select(F.col("node").alias("u"), F.col("least").alias("v"))), "joined")
    reps = encoded.select("node", "rep")
    members = joined.join(reps, "node")
    first = members.groupBy("component").agg(F.min("rep").alias("c"))
    named = salted_join(members.select("node", "component"), first, ["component"], hot_keys(joined, ["component"], joined.count(), BLOCK), ["node"]).select("node", "c")
    known = encoded.select("node", "v", "mult", "rep").join(links, "node", "left").join(named, "node", "left")
    known = known.select(F.xxhash64("v").alias("h"), "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("c", "rep").alias("component_id"))
    hot = hot_keys(encoded.select(F.xxhash64("v").alias("h"), "mult"), ["h"], sum(sizes.values()), BLOCK, F.col("mult"))
    out = salted_join(usable.withColumn("h", F.xxhash64("v")), known, ["h"], hot, ["vec_id"], extra=["v"]).select("vec_id", "n_links", "component_id")
    return out.union(alone).select("*", kept)


def op3(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of the table embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))

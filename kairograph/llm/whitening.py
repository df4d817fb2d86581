"""Whitening of embeddings on exactly centred rows.

Each entry c becomes the integer x = floor(1024 c) + 100000, so that sums over all rows are exact and n x - S, the n-fold
distance from the mean, has no rounding. The centred rows (n x - S) / n, each rounded once, are a RowMatrix; its Gramian
over n is the covariance, whose eigenvectors numpy finds on the driver: a matrix of the vector's length squared, whatever
the number of rows. The whitening matrix is broadcast to mapInPandas, which projects each row.

Edge rows: vectors that are null, or hold null, NaN or infinite entries, are dropped, and so are those with an entry of
2^52 / 1024 or more, whose x is not exact. Vectors of another length are whitened apart, with their own n. Repeated rows
and null ids are kept. A component without variance (one row, equal rows, fewer rows than components) has a null
`whitened` and takes no part in `identity_error`; without any variance `explained` is null too. A `deviation` beyond a
long is null. An empty table gives no rows; columns other than the id and the vector are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import durable, small_batches, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
EXACT = 1 << 52
LONG_MAX = (1 << 63) - 1
#: A component counts as one without variance below this share of the first one's.
NO_VARIANCE = 1e-12
SCHEMA = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the usable rows."""
    vector = F.col("embedding").cast("array<double>")
    exact = lambda c: F.abs(c * SCALE) < EXACT  # noqa: E731  no infinity or NaN, which Spark holds to be the largest
    whole = F.transform(vector, lambda c: F.when(exact(c), F.floor(c * SCALE) + SHIFT))
    return rows.where(F.col("embedding").isNotNull() & F.forall(vector, lambda c: c.isNotNull() & exact(c))).select("vec_id", whole.alias("x"))


def sums(x: DataFrame) -> dict[int, tuple[int, list[int], list[int], list[int]]]:
    """By length of vectors: n, and of each dimension the exact sum, least and largest entry. Rows on the driver: the lengths' sum."""
    wide = F.col("e").cast("decimal(38,0)")
    found = x.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "e")).groupBy("d", "i").agg(F.count("*").alias("n"), F.sum(wide).alias("s"), F.min("e").alias("low"), F.max("e").alias("high"))
    out: dict[int, tuple[int, list[int], list[int], list[int]]] = {}
    for r in found.orderBy("d", "i").collect():
        of = out.setdefault(r["d"], (r["n"], [], [], []))
        for to, value in zip(of[1:], (r["s"], r["low"], r["high"]), strict=True):
            to.append(int(value))
    return out


def centred(x: Column, n: int, s: list[int], fits: bool) -> Column:
    """(n x - S) / n as doubles of exact integers."""
    if fits:
        return F.zip_with(x, F.array(*[F.lit(v) for v in s]), lambda v, of: (v * F.lit(n).cast("long") - of).cast("double") / float(n))
    wide = "decimal(38,0)"
    return F.zip_with(x, F.array(*[F.lit(str(v)).cast(wide) for v in s]), lambda v, of: (v.cast("decimal(17,0)") * F.lit(n).cast("decimal(19,0)") - of).cast("double") / float(n))


def covariance(rows: DataFrame, n: int) -> np.ndarray:
    """Of centred rows (one column of array<double>), divisor n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(rows.columns[0]).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    return np.maximum(values[order], 0), vectors[:, order]


def whitened(x: DataFrame, n: int, s: list[int], fits: bool, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation, w (array<double>, NaN for a component without variance)."""
    with np.errstate(divide="ignore"):
        scale = np.where(values > NO_VARIANCE * values[:1], 1 / np.sqrt(values), np.nan) if values[0] > 0 else np.full(len(values), np.nan)
    shared = x.sparkSession.sparkContext.broadcast((np.array(s, object), np.ascontiguousarray(vectors), scale))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, directions, by = shared.value
        for batch in batches:
            made = np.array(batch["x"].tolist(), np.int64).reshape(len(batch), len(total))
            off = made * np.int64(n) - total.astype(np.int64) if fits else made.astype(object) * n - total
            squares = (off * off).sum(1)
            deviation = pd.array(squares, "Int64") if fits else pd.array([int(q) if q <= LONG_MAX else None for q in squares], "Int64")
            w = (off.astype(float) / n) @ directions * by
            yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": deviation, "w": list(w)})

    small_batches(x.sparkSession)
    kind = x.schema["vec_id"].dataType.simpleString()
    return x.mapInPandas(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(rows: DataFrame, alive: list[int]) -> float:
    """The largest absolute entry of w's covariance minus the identity, centred before multiplying."""
    if not alive:
        return 0.0
    at = [F.col("w")[i] for i in alive]
    means = rows.agg(*[F.avg(c) for c in at]).first()
    off = [c - F.lit(float(m)) for c, m in zip(at, means, strict=True)]
    pairs = [(i, j) for i in range(len(off)) for j in range(i, len(off))]
    found = rows.agg(*[F.avg(off[i] * off[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark, x = embeddings.sparkSession, whole_numbers(embeddings)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    out = spark.createDataFrame([], SCHEMA.format(kind=kind))
    for d, (n, s, low, high) in sums(x).items():
        far = max(max(abs(n * a - t), abs(n * b - t)) for t, a, b in zip(s, low, high, strict=True))
        fits = d * far * far <= LONG_MAX and n * max(abs(v) for v in (*low, *high)) <= LONG_MAX and max(map(abs, s)) <= LONG_MAX
        own = x.where(F.size("x") == d)
        v = covariance(own.select(centred(F.col("x"), n, s, fits).alias("c")), n)
        values, vectors = components(v, most)
        made = durable(whitened(own, n, s, fits, values, vectors), "whitened")
        trace = float(np.trace(v))
        alive = [k for k in range(len(values)) if values[0] > 0 and values[k] > NO_VARIANCE * values[0]]
        wrong = identity_error(made, alive)
        explained = F.array(*[F.lit(float(e / trace) if trace > 0 else None).cast("double") for e in values])
        out = out.unionByName(
            made.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
                "vec_id",
                (F.col("k") + 1).alias("component"),
                F.lit(n).cast("long").alias("n"),
                "deviation",
                F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened"),
                F.get(explained, F.col("k")).alias("explained"),
                F.lit(wrong).alias("identity_error"),
            )
        )
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

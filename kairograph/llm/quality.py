"""Quality of texts by logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits, and runs of other non-space characters. Features are hashed into 2^BITS:
lower-cased tokens and their bigrams, and n-grams (1 to 3) of forms. A form is a run of marks as it stands, or a word's
case pattern, each with whether it repeats the token of its kind before. A text's vector is each feature's share of its
tokens, times SCALE, so that a text's length does not count; scoring is one sparse dot product.

Training takes at most TRAIN_ROWS labelled texts of at most TRAIN_CHARS characters together, those first by a hash of
doc_id that fit: a bounded sample, as a classifier's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairograph.llm import chars
from kairograph.llm.common import crc_mod, give_back, hashed_sample, held_out, map_arrow, small_batches, table

BITS = 18
SCALE = 8.0
TRAIN_ROWS = 6000
TRAIN_CHARS = 40_000_000
EPOCHS = 3
THRESHOLD = 0.3


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, the text (row) of each, and the tokens of each text; one entry per occurrence."""
    kinds, lower, _ = chars.tables()
    all_ids, all_rows, tokens = [], [], np.zeros(len(texts), np.int64)
    mask = np.uint64((1 << BITS) - 1)
    for first, end, cps, sizes in chars.blocks(texts):
        kind = kinds[cps]
        group = np.where(kind >= chars.DIGIT, 2, kind).astype(np.uint8)  # 2: word, 1: marks, 0: space
        starts, ends = chars.runs(group, np.zeros(1, bool))
        if not len(starts):
            continue
        row = np.searchsorted(np.cumsum(sizes), starts, side="right") + first
        tokens[first:end] += np.bincount(row - first, minlength=end - first)
        low = chars.mix(lower[cps].astype(np.uint64) + np.uint64(1))
        begin = np.zeros(len(cps), np.int64)
        begin[starts] = starts
        at = (np.arange(len(cps)) - np.maximum.accumulate(begin)).astype(np.uint64)
        weight = low * (np.uint64(2) * at + np.uint64(1))
        weight[group == 0] = 0
        lex = chars.mix(np.add.reduceat(weight, starts))
        is_word = group[starts] == 2
        case = (np.add.reduceat(kind == chars.UPPER, starts) > 0).astype(np.uint64) * np.uint64(2)
        case += np.add.reduceat(kind == chars.LOWER, starts) > 0
        case += np.uint64(4) * (kind[starts] == chars.UPPER)
        case += np.uint64(8) * (ends - starts == 1)
        form = np.where(is_word, case + np.uint64(1), lex)
        for of in (is_word, ~is_word):  # repeats among words, and among marks
            which = np.flatnonzero(of)
            same = which[1:][(lex[which[1:]] == lex[which[:-1]]) & (row[which[1:]] == row[which[:-1]])]
            form[same] = chars.mix(form[same] + np.uint64(77))
        ids = [lex, form + np.uint64(0x5151)]
        rows = [row, row]
        for seq, salt, most in ((lex, 11, 2), (form, 23, 3)):
            gram = seq
            for n in range(2, most + 1):
                if len(seq) < n:
                    break
                gram = chars.mix(gram[:-1] * np.uint64(31) + seq[n - 1 :] + np.uint64(salt * n))
                inside = row[n - 1 :] == row[: len(row) - n + 1]
                ids.append(gram[inside])
                rows.append(row[n - 1 :][inside])
        all_ids.append((chars.mix(np.concatenate(ids)) & mask).astype(np.int32))
        all_rows.append(np.concatenate(rows))
    if not all_ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), tokens
    return np.concatenate(all_ids), np.concatenate(all_rows), tokens


def vectors(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct features and their values."""
    ids, rows, tokens = features(texts)
    key = rows.astype(np.int64) << BITS | ids
    distinct, counts = np.unique(key, return_counts=True)
    cut = np.searchsorted(distinct, np.arange(1, len(texts)) << BITS) if len(texts) > 1 else []
    return [
        ((k & ((1 << BITS) - 1)).astype(np.int32), (SCALE * c / max(t, 1)).astype(np.float32))
        for k, c, t in zip(np.split(distinct, cut), np.split(counts, cut), tokens.tolist(), strict=True)
    ]


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last coordinate is the intercept."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk)

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(ids, 1 << BITS), np.append(values.astype(np.float64), 1.0)
        w = self.weights(at)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, mod: int = 5) -> np.ndarray:
    """Weights from rows whose crc32(doc_id) modulo `mod` is not 0, `rows` of them and TRAIN_CHARS characters at most.

    Null ids, null labels and labels other than 0 and 1 are not learnt from; of several labels of an id the least
    counts, and all rows of a repeated id are learnt from. Without labelled rows all weights are 0 and every score 0.5.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(crc_mod(F.col("doc_id"), mod) != 0)
    picked = hashed_sample(known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("__y")), ["doc_id"], rows)
    texts = docs.select("doc_id", F.col("text").cast("string"))
    sizes = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "__y").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    fitting, held = [], 0
    for row in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most `rows` ids
        if held + row.chars <= TRAIN_CHARS:
            fitting.append((row.doc_id, row["__y"]))
            held += row.chars
    kept = docs.sparkSession.createDataFrame(fitting, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("__y", T.IntegerType())]))
    joined = texts.join(F.broadcast(kept), "doc_id")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        got = [v for first, end in chars.slices(texts) for v in vectors(texts[first:end])]
        parts = [pa.array([x.tobytes() for x in col], pa.binary()) for col in zip(*got, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *parts, batch.column(2)], ["doc_id", "ids", "x", "y"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_arrow(joined, fn, f"doc_id {kind}, ids binary, x binary, y int").toArrow().combine_chunks()
    sorted_at = pc.sort_indices(got, [("doc_id", "ascending"), ("ids", "ascending")]).to_numpy()
    ids, x, y = got.column("ids"), got.column("x"), got.column("y").to_numpy()
    model = Ftrl()
    order = np.random.default_rng(7)
    for _ in range(EPOCHS if len(sorted_at) else 0):
        for i in sorted_at[order.permutation(len(sorted_at))].tolist():
            model.learn(np.frombuffer(ids[i].as_buffer(), np.int32), np.frombuffer(x[i].as_buffer(), np.float32), int(y[i]))
    weights = model.weights()
    del got, ids, x, y
    give_back()
    return weights


def score_texts(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Sparse dot products: a text's mean weight over its tokens' features, times SCALE, and the intercept."""
    logit = np.full(len(texts), weights[-1])
    for first, end in chars.slices(texts):
        ids, rows, tokens = features(texts[first:end])
        if len(ids):
            logit[first:end] += SCALE * np.bincount(rows, weights=weights[ids], minlength=end - first) / np.maximum(tokens, 1)
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(row, score): each row of docs whole, whatever its columns are named; null and empty texts get the intercept's score.

    Repeated rows keep their number, each with the same score; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS + 1 numbers

    @F.pandas_udf("double")
    def found(texts):
        import pandas as pd

        out = pd.Series(score_texts(texts.tolist(), sent.value))
        give_back()
        return out

    return docs.select(F.struct(*docs.columns).alias("row"), found(F.col("text").cast("string")).alias("score"))


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """All columns of docs and the score of each text under `name`, which replaces a column of that name."""
    return scored(docs, weights).select(*[f"row.{c}" for c in docs.columns if c != name], F.col("score").alias(name))


def op10(spark, sf_dir: str) -> DataFrame:
    """score() over the table documents, learnt from labels.quality; rows as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, weights).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

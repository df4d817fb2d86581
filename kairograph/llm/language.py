"""Language of texts: script ranges narrow the candidates, a Viterbi path with a switching penalty labels spans.

A word is a run of letters. Its score for a language is the sum, over its characters, of the hashed log probability of
the character after the two before it (word ends included), less the mean over languages. A language takes part in a
word only if at least MIN_SHARE of the letters it was learnt from are of the word's script; if none does, the word says
nothing. The path over a text's words maximises the scores less SWITCH for each change of language; all texts of a
batch advance together, word by word. The text's language is that of most letters on the path.

Training takes at most TRAIN_ROWS labelled texts, first by a hash of doc_id: a bounded sample, as a classifier's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm import chars
from kairograph.llm.common import crc_mod, give_back, hashed_sample, held_out, map_arrow, small_batches, table

BITS = 16
TRAIN_ROWS = 6000
SWITCH = 9.0
MIN_SHARE = 0.01
PATH_CHARS = 6_000_000  # of the texts whose paths advance together
UNKNOWN = "und"


@dataclass
class LanguageModel:
    names: list[str]
    scores: np.ndarray  # 2^BITS x languages
    scripts: np.ndarray  # script x languages: takes part


def words(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in code points; per character its hashed trigram, and whether it is in a word."""
    kinds, lower, _ = chars.tables()
    letter = kinds[cps] >= chars.LOWER
    starts, ends = chars.runs(letter.view(np.uint8), np.zeros(1, bool))
    c = np.where(letter, lower[cps], 0).astype(np.uint32)
    gram = c * np.uint32(0x9E3779B1)
    gram[1:] += c[:-1] * np.uint32(0x85EBCA6B)
    before = np.where(letter[1:-1], c[:-2], 0) if len(c) > 2 else np.zeros(0, np.uint32)
    gram[2:] += before * np.uint32(0xC2B2AE35)
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x27D4EB2F)
    return starts, ends, (gram >> np.uint32(32 - BITS)).astype(np.int32), letter


def _counts(texts: list[str | None]) -> np.ndarray:
    """Of all texts together: the trigram table, then counts by script."""
    _, _, script = chars.tables()
    grams, scripts = np.zeros(1 << BITS, np.int64), np.zeros(len(chars.SCRIPTS) + 2, np.int64)
    for _, _, cps, _ in chars.blocks(texts):
        _, ends, gram, letter = words(cps)
        letter[ends] = True  # the end of a word is a character too; each block ends with a line feed
        grams += np.bincount(gram[letter], minlength=1 << BITS)
        scripts += np.bincount(script[cps], minlength=len(scripts))
    return np.concatenate([grams, scripts])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, mod: int = 5) -> LanguageModel:
    """Learn from text and non-null lang of rows whose crc32(doc_id) modulo `mod` is not 0, `rows` ids of them at most.

    All rows of a repeated id count. A table without such rows gives a model of no language. Counts are summed by one
    aggregate over (language, cell); the driver gets its rows, 2^BITS cells and the scripts a language at most.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(crc_mod(F.col("doc_id"), mod) != 0)
    picked = hashed_sample(known.select("doc_id").distinct(), ["doc_id"], rows)
    sample = known.select("doc_id", F.col("lang").cast("string").alias("__lang"), F.col("text").cast("string").alias("__text")).join(F.broadcast(picked), "doc_id")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        langs, cells, n = [], [], []
        for lang, texts in by.items():
            got = _counts(texts)
            at = np.flatnonzero(got)
            langs += [lang] * len(at)
            cells.append(at)
            n.append(got[at])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(n))], ["lang", "cell", "n"])

    counted = map_arrow(sample.select("__lang", "__text"), fn, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    names = sorted(counted["lang"].unique())
    scores = np.zeros((1 << BITS, max(len(names), 1)))
    scripts = np.zeros((len(chars.SCRIPTS) + 2, max(len(names), 1)), bool)
    for i, name in enumerate(names):
        part = counted[counted["lang"] == name]
        all_counts = np.zeros((1 << BITS) + len(scripts))
        all_counts[part["cell"].to_numpy()] = part["n"].to_numpy()
        grams, of = all_counts[: 1 << BITS], all_counts[1 << BITS :]
        scores[:, i] = np.log((grams + 0.05) / (grams.sum() + 0.05 * (1 << BITS)))
        of[0] = 0
        scripts[:, i] = of >= MIN_SHARE * max(of.sum(), 1)
    scores -= scores.mean(1, keepdims=True)
    return LanguageModel(names, scores.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; words of a text are consecutive, counts gives their number by text."""
    total, labels = scores.shape
    out = np.zeros(total, np.int32)
    if not total or labels == 1:
        return out
    firsts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    firsts, lengths = firsts[order], counts[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths.max() + 1), side="right")  # texts with at least t words
    came = np.zeros(total, np.int32)  # best label before a word
    moved = np.zeros((total, labels), bool)  # whether a label is reached from it
    ends = np.zeros(len(order), np.int32)
    v = scores[firsts[: active[0]]].copy()
    for t in range(1, len(active)):
        n = active[t]
        if n < len(v):
            ends[n : len(v)] = v[n:].argmax(1)
        v, at = v[:n], firsts[:n] + t
        came[at] = v.argmax(1)
        top = v.max(1, keepdims=True)
        leap = v < top - switch
        moved[at] = leap
        v = np.where(leap, np.float32(-switch), v - top) + scores[at]
    ends[: len(v)] = v.argmax(1)
    label = np.zeros(len(order), np.int32)
    for t in range(len(active) - 1, -1, -1):
        n, at = active[t], firsts[: active[t]] + t
        fresh = active[t + 1] if t + 1 < len(active) else 0
        label[fresh:n] = ends[fresh:n]
        now = label[:n]
        out[at] = now
        if t:
            label[:n] = np.where(moved[at, now], came[at], now)
    return out


def label_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """Per text its language, a score in [0, 1], and spans (start, end, language) in code points.

    The score is the mean over the text's letters of the probability of their span's language, by the sum of the span's
    scores: a text in several learnt languages scores as its spans do, whatever their shares. Null texts, texts without
    a letter, and any text where no language was learnt, are `und` with score 0.
    """
    _, _, script = chars.tables()
    width = max(len(model.names), 1)
    per_word, row, start, end = [], [], [], []
    for first, _, cps, sizes in chars.blocks(texts):
        starts, ends, gram, letter = words(cps)
        if not len(starts):
            continue
        at = np.searchsorted(np.cumsum(sizes), starts, side="right")
        offset = (np.cumsum(sizes) - sizes)[at]
        g = model.scores[gram]  # a word's characters and its end follow each other
        bounds = np.empty(2 * len(starts), np.int64)
        bounds[0::2], bounds[1::2] = starts, ends + 1
        sums = np.add.reduceat(np.vstack([g, np.zeros((1, width), np.float32)]), bounds, axis=0)[0::2]
        usable = model.scripts[script[cps[starts]]]
        sums = np.where(usable, sums, np.float32(-30.0))
        sums[~usable.any(1)] = 0
        per_word.append(sums)
        row.append(at + first)
        start.append(starts - offset)
        end.append(ends - offset)
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not row or not model.names:
        return names, score, spans
    scores, rows, starts, ends = (np.concatenate(x) for x in (per_word, row, start, end))
    counts = np.bincount(rows, minlength=len(texts))
    label = viterbi(scores, counts)
    letters = np.bincount(rows * width + label, weights=ends - starts, minlength=len(texts) * width).reshape(-1, width)
    best = letters.argmax(1)
    fresh = np.append(True, (label[1:] != label[:-1]) | (rows[1:] != rows[:-1]))
    at = np.flatnonzero(fresh)
    sums = np.add.reduceat(scores.astype(np.float64), at, axis=0)
    odds = np.exp(np.clip(sums - sums.max(1, keepdims=True), -50, 0))
    sure = odds[np.arange(len(at)), label[at]] / odds.sum(1) * np.add.reduceat(ends - starts, at)
    score = np.bincount(rows[at], weights=sure, minlength=len(texts)) / np.maximum(letters.sum(1), 1)
    for i in np.flatnonzero(counts).tolist():
        names[i] = model.names[best[i]]
    last = np.append(at[1:], len(rows)) - 1
    for r, a, b, k in zip(rows[at].tolist(), starts[at].tolist(), ends[last].tolist(), label[at].tolist(), strict=True):
        spans[r].append((a, b, model.names[k]))
    return names, score, spans


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(row, lang): each row of docs whole, whatever its columns are named, and its lang_pred, lang_score, lang_spans.

    Null texts and those without a letter are `und` with score 0 and no span. Repeated rows keep their number, each
    with the same result; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows by the number of languages

    @F.pandas_udf("lang_pred string, lang_score double, lang_spans array<struct<start:int,end:int,lang:string>>")
    def found(texts):
        import pandas as pd

        texts = texts.tolist()
        parts = [label_texts(texts[first:end], sent.value) for first, end in chars.slices(texts, PATH_CHARS)]
        spans = [[{"start": a, "end": b, "lang": c} for a, b, c in s] for part in parts for s in part[2]]
        give_back()
        return pd.DataFrame({"lang_pred": [x for part in parts for x in part[0]], "lang_score": np.concatenate([part[1] for part in parts]), "lang_spans": spans})

    return docs.select(F.struct(*docs.columns).alias("row"), found(F.col("text").cast("string")).alias("lang"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs, and lang_pred, lang_score and lang_spans, which replace columns of these names.

    Rows as identified() gives them; of languages with equally many letters on the path the first by name counts.
    """
    held = [f"row.{c}" for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_spans")]
    return identified(docs, model).select(*held, "lang.*")


def op4(spark, sf_dir: str) -> DataFrame:
    """identify() over the table documents, learnt from its own rows; rows as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

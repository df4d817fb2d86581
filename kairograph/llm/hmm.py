"""A hidden Markov language model over words, and a smoothed unigram score beside it.

Tokens are runs of anything but ASCII white space, A-Z lower-cased, then one end. Words are counted over the whole
training part: each task adds up its own, flushed at FLUSH distinct words, and one aggregate sums them. States emit
classes: the OWN most frequent words and the end are a class each, all others fall into REST classes by a hash; a
word's probability within a REST class is its smoothed share there. So a text's probability is that of its class
sequence, by the scaled forward recursion over the whole text, times those shares.

Baum-Welch: states start as clusters of classes by the frequent words of their texts, counted over the whole training part; then
PASSES rounds run over all of it. Each task adds up expected counts of its texts, and one aggregate over the
states * (classes + states + 1) cells sums them over all tasks.

Long texts are cut into segments of SEGMENT tokens that advance together, and nothing is lost at the cuts: the product
of a segment's steps is a states x states matrix, and the products in order carry the exact forward vector to each
segment's start and the exact backward vector to its end.

Only the KNOWN most frequent words are sent to the tasks; counts of the others meet their texts in a join by word, so
the vocabulary may grow without bound. Texts become rows of 16-bit classes in a durable table that all later steps read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import durable, give_back, held_out, hot_keys, salted_join, small_batches, table

ALPHA = 0.1
END = b"\n"  # can't be a word
OWN, REST = 4096, 256
KNOWN = 200_000
FLUSH = 200_000
STATES = 8
PASSES = 2
FREQUENT = 32  # classes whose shares of a text tell the first states apart
SURE = 0.9  # of a class's first emissions from its cluster's state
STICKY = 0.8  # of a state's first chance to follow itself
SEGMENT = 512
BUCKET = 4096  # rows of a word that one task joins with its count
GROUP = 400_000  # tokens whose expectations are held at once
CLASSES = 1 + OWN + REST


def tokens(text: str | None) -> list[bytes]:
    """Words of a text without the end; bytes lower-case ASCII letters and split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over the texts, the end counted once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                counts[END] += 1
                if len(counts) >= FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What tasks know of the counts: bounded by KNOWN words and CLASSES classes."""

    index: dict[bytes, int]
    classes: np.ndarray  # by index
    logs: np.ndarray  # by index: log10(count + ALPHA)
    total: int  # N
    distinct: int  # V
    rest_logs: np.ndarray  # by class: log10 of its smoothed size, 0 for words' own classes

    @property
    def base_log(self) -> float:
        return float(np.log10(self.total + ALPHA * (self.distinct + 1)))


def lexicon(counts: DataFrame, own: int = OWN, known: int = KNOWN) -> Lexicon:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the most frequent words by steps of a logarithmic histogram: a top-k would send k rows of every task; of the step
    # that doesn't fit whole, the words of the least hashes
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    words = counts.where(F.col("word") != F.lit(END))
    sizes = sorted(((r.step, r.c) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()), reverse=True)  # 16 rows a doubling
    least, over, held, cut = 1 << 30, 1 << 30, 0, 0
    for at, c in sizes:
        if held + c > known:
            over, cut = at, int((1 << 30) * 0.98 * (known - held) / c)
            break
        least, held = at, held + c
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < cut
    top = words.where((step >= least) | ((step == over) & part)).toPandas().sort_values(["n", "word"], ascending=[False, True])  # `known` rows at most
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = [END, *map(bytes, top["word"])]
    n = np.append(ends, top["n"].to_numpy(np.int64)).astype(np.int64)
    classes = np.array([i if i <= own else 1 + OWN + zlib.crc32(w) % REST for i, w in enumerate(words)], np.uint16)
    sizes = counts.groupBy((F.crc32("word") % REST).cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # REST rows
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in sizes:
        size[1 + OWN + row.bin], kinds[1 + OWN + row.bin] = row.n, row.v
    for i, w in enumerate(words[: own + 1]):  # words with a class of their own are in no rest class
        if n[i]:
            size[1 + OWN + zlib.crc32(w) % REST] -= n[i]
            kinds[1 + OWN + zlib.crc32(w) % REST] -= 1
    rest = np.zeros(CLASSES)
    rest[1 + OWN :] = np.log10(size[1 + OWN :] + ALPHA * (kinds[1 + OWN :] + 1))
    return Lexicon({w: i for i, w in enumerate(words)}, classes, np.log10(n + ALPHA), int(total), int(distinct), rest)


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Of rows (doc_id, text): key, doc_id, n_tokens, n_known, base and inside (sums over known words), classes, rare, rare_n.

    base: log10(count + ALPHA) of all known words; inside: of those in rest classes, less the class's size for all.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lex)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        key, get = TaskContext.get().partitionId() << 36, lex.index.get
        in_rest = lex.classes > OWN
        trained = lex.logs > np.log10(ALPHA) + 1e-9  # of the end too, if any text was learnt from
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1):
                words = tokens(text.as_py())
                words.append(END)
                at = np.fromiter([get(w, -1) for w in words], np.int32, len(words))
                seen = at >= 0
                known = at[seen]
                classes = np.empty(len(words), np.uint16)
                classes[seen] = lex.classes[known]
                rare = Counter()
                if len(known) < len(words):
                    missing = [words[i] for i in np.flatnonzero(~seen).tolist()]
                    classes[~seen] = [1 + OWN + zlib.crc32(w) % REST for w in missing]
                    rare.update(missing)
                logs = lex.logs[known]
                row = (key, len(words), int(trained[known].sum()), logs.sum(), logs[in_rest[known]].sum() - lex.rest_logs[classes].sum(), classes.tobytes(), list(rare), list(rare.values()))
                key += 1
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            arrays = [pa.array(col, k) for col, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([arrays[0], batch.column(0), *arrays[1:]], ["key", "doc_id", "n_tokens", "n_known", "base", "inside", "classes", "rare", "rare_n"])

    schema = f"key long, doc_id {kind}, n_tokens long, n_known long, base double, inside double, classes binary, rare array<binary>, rare_n array<long>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the model


@dataclass
class Hmm:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @staticmethod
    def of(start: np.ndarray, step: np.ndarray, emit: np.ndarray, floor: np.ndarray) -> Hmm:
        """From expected counts (emit: states x classes); floor is a class distribution that smooths emissions."""
        held = emit.sum(1)
        return Hmm(
            (start + 0.1) / (start + 0.1).sum(),
            (step + 0.1) / (step + 0.1).sum(1, keepdims=True),
            ((emit + 50.0 * floor) / (held + 50.0)[:, None]).T.copy(),
        )


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")


@dataclass
class Segments:
    """Consecutive texts cut at every SEGMENT tokens."""

    text: np.ndarray
    number: np.ndarray  # within its text
    first: np.ndarray  # token
    length: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Segments:
        pieces = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        return Segments(text, number, (np.cumsum(lengths) - lengths)[text] + number * SEGMENT, np.minimum(lengths[text] - number * SEGMENT, SEGMENT))


def _products(classes: np.ndarray, first: np.ndarray, length: np.ndarray, model: Hmm, begin: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(segments x rows x states, log10 of what they were divided by): products of steps and emissions over each segment.

    begin: what the first token's emissions multiply, in place of the step matrix; then there is one row, else one a state.
    """
    order, active = _order(length)
    at0, logs = first[order], np.zeros(len(order))
    out = np.empty((len(order), model.step.shape[0] if begin is None else 1, model.step.shape[0]))
    out[:] = model.step if begin is None else begin
    for t, n in enumerate(active.tolist()):
        now = out[:n]
        if t:
            now = now @ model.step
        now = now * model.emit[classes[at0[:n] + t]][:, None, :]
        if t % 8 == 7 or t + 1 == len(active) or active[t + 1] < n:
            size = now.sum((1, 2))
            now /= size[:, None, None]
            logs[:n] += np.log10(size)
        out[:n] = now
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back], logs[back]


def boundaries(classes: np.ndarray, of: Segments, model: Hmm, single: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per segment the forward vector before it and at its end (sums are 1), the backward vector at its end (so that its
    product with the forward one is 1), and log10 of the probability that it adds; without `single`, texts of one
    segment are passed over, as they have no cut."""
    k = len(model.start)
    ahead, behind = np.zeros((len(of.text), k)), np.ones((len(of.text), k))
    logs = np.zeros(len(of.text))
    head = np.flatnonzero((of.number == 0) & (single | np.append(of.number[1:] > 0, False)))
    product, logs[head] = _products(classes, of.first[head], of.length[head], model, model.start)
    ahead[head] = product[:, 0]
    rest = np.flatnonzero(of.number > 0)
    if len(rest):
        product, logs[rest] = _products(classes, of.first[rest], of.length[rest], model, None)
        by_number = np.argsort(of.number[rest], kind="stable")
        cuts = np.flatnonzero(np.diff(of.number[rest][by_number])) + 1
        levels = np.split(by_number, cuts)
        for level in levels:  # of the second segments, of the third ones, ...
            at = rest[level]
            now = (ahead[at - 1][:, None, :] @ product[level])[:, 0]
            size = now.sum(1)
            ahead[at] = now / size[:, None]
            logs[at] += np.log10(size)
        for level in reversed(levels):
            at = rest[level]
            now = (product[level] @ behind[at][:, :, None])[:, :, 0]
            behind[at - 1] = now / (now * ahead[at - 1]).sum(1)[:, None]
    before = np.zeros((len(of.text), k))
    before[rest] = ahead[rest - 1]
    return before, ahead, behind, logs


def expectations(classes: np.ndarray, lengths: np.ndarray, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, steps and emissions (states x classes) of consecutive texts of the given lengths, each whole."""
    k = len(model.start)
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES))
    cut = Segments.of(lengths)
    before, _, behind, _ = boundaries(classes, cut, model, single=False)
    groups = np.cumsum(cut.length) // GROUP
    for g in np.unique(groups):
        of = groups == g
        order, active = _order(cut.length[of])
        at0, heads = cut.first[of][order], cut.number[of][order] == 0
        low = int(at0.min())
        part = classes[low : int((at0 + cut.length[of][order]).max())]
        at0 = at0 - low
        came, end = before[of][order], behind[of][order]
        b = model.emit[part]
        alpha, scale = np.empty((len(part), k)), np.empty(len(part))
        a = np.where(heads[:, None], model.start, came @ model.step) * b[at0]
        for t, n in enumerate(active.tolist()):
            at = at0[:n] + t
            if t:
                a = (a[:n] @ model.step) * b[at]
            s = a.sum(1)
            a /= s[:, None]
            alpha[at], scale[at] = a, s
        beta = np.ones((0, k))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if n > len(beta):
                beta = np.vstack([beta, end[len(beta) : n]])
            at = at0[:n] + t
            gamma = alpha[at] * beta
            w = b[at] * beta / scale[at][:, None]
            if t:
                step += alpha[at - 1].T @ w
                beta = w @ model.step.T
            else:
                start += gamma[heads].sum(0)
                step += came.T @ w  # nothing came before a text's first segment
            alpha[at] = gamma  # the text's later positions need alpha no more
        for i in range(k):
            emit[i] += np.bincount(part, weights=alpha[:, i], minlength=CLASSES)
    return start, step * model.step, emit


def log_likelihood(classes: np.ndarray, lengths: np.ndarray, model: Hmm) -> np.ndarray:
    """log10 probability of each whole class sequence, by the scaled forward recursion; every text has a token."""
    cut = Segments.of(lengths)
    return np.bincount(cut.text, boundaries(classes, cut, model)[3], len(lengths))


def _sequences(batch: pa.RecordBatch, name: str = "classes") -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(batch.schema.get_field_index(name))]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def summed(encoded: DataFrame, counts, cells: int) -> np.ndarray:
    """The sum over all rows of encoded (classes) of counts(classes, lengths), an array of `cells` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                got = counts(*_sequences(batch))
                sums = got if sums is None else sums + got
        if sums is not None:
            at = np.flatnonzero(sums > 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.float64))], ["cell", "x"])
        give_back()

    got = encoded.select("classes").mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()  # `cells` rows at most
    out = np.zeros(cells)
    out[got["cell"].to_numpy()] = got["x"].to_numpy()
    return out


def companions(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """By class and frequent class, flat: over all tokens of the class, the frequent one's share of its text's frequent tokens."""
    text, kind = np.repeat(np.arange(len(lengths)), lengths), classes.astype(np.int64)
    top = (kind > 0) & (kind <= FREQUENT)
    share = np.bincount(text[top] * FREQUENT + kind[top] - 1, minlength=len(lengths) * FREQUENT).reshape(-1, FREQUENT).astype(np.float64)
    share /= np.maximum(share.sum(1, keepdims=True), 1)
    return np.stack([np.bincount(kind, weights=of[text], minlength=CLASSES) for of in share.T], axis=1).ravel()


def first_states(beside: np.ndarray, floor: np.ndarray, states: int) -> Hmm:
    """A model whose states are clusters of classes with alike companions, weighted by how often classes occur."""
    beside = beside.reshape(CLASSES, FREQUENT)
    whole = (beside.sum(0) + 1) / (beside.sum() + FREQUENT)
    of = (beside + 20 * whole) / (beside.sum(1, keepdims=True) + 20)
    of = (of - whole) / np.sqrt(whole)
    of /= np.sqrt((of**2).sum(1, keepdims=True)) + 0.3
    centres = [np.average(of, axis=0, weights=floor)]
    for _ in range(states):  # the next is the class that adds most: far from all so far, and frequent
        far = np.min([((of - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(of[int((far * floor).argmax())])
    centres = np.array(centres[1:])
    for _ in range(30):
        near = ((of[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for s in range(states):
            if floor[near == s].sum() > 0:
                centres[s] = np.average(of[near == s], axis=0, weights=floor[near == s])
    share = np.full((states, CLASSES), (1 - SURE) / max(states - 1, 1))
    share[near, np.arange(CLASSES)] = SURE
    step = (1 - STICKY) / states + STICKY * np.eye(states)
    return Hmm.of(np.ones(states), 1e4 * step, share * floor * 1e6, floor)


def baum_welch(encoded: DataFrame, floor: np.ndarray, states: int = STATES, passes: int = PASSES) -> Hmm:
    """Train on all rows of encoded (classes); no rows give a model of the floor alone."""
    spark = encoded.sparkSession
    model = first_states(summed(encoded, companions, CLASSES * FREQUENT), floor, states)
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(model)

        def counts(classes: np.ndarray, lengths: np.ndarray, sent=sent) -> np.ndarray:
            return np.concatenate([x.ravel() for x in expectations(classes, lengths, sent.value)])

        start, step, emit = np.split(summed(encoded, counts, states * (1 + states + CLASSES)), [states, states + states * states])
        model = Hmm.of(start, step.reshape(states, states), emit.reshape(states, CLASSES), floor)
    return model


def class_shares(lex: Lexicon) -> np.ndarray:
    """The training tokens' distribution over classes, smoothed so that none is 0."""
    n = np.zeros(CLASSES)
    own = lex.classes <= OWN
    n[lex.classes[own]] = 10.0 ** lex.logs[own] - ALPHA
    n[1 + OWN :] = 10.0 ** lex.rest_logs[1 + OWN :]
    n += ALPHA
    return n / n.sum()


def score(docs: DataFrame, mod: int = 10) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end alone. Rows with a null doc_id are scored but not learnt from; repeated rows
    keep their number. With nothing to learn from all counts are 0 and the scores those of the smoothing alone.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    learnt = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod))
    counts = durable(word_counts(learnt), "words")
    lex = lexicon(counts)
    encoded = durable(encode(docs, lex), "classes")
    learnt = encoded.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod))
    model = baum_welch(learnt, class_shares(lex))
    rare = encoded.select("key", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("rare_n").alias("times"))))
    rare = rare.toDF("key", "word", "times")
    tokens_ = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]  # rare rows at most
    hot = hot_keys(rare, ["word"], tokens_, BUCKET)  # a word may be frequent outside the training part alone
    rare = salted_join(rare, counts, ["word"], hot, ["key"], "left")
    sums = rare.groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("rare_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = log_likelihood(*_sequences(batch), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "forward"])

    held = ["key", "doc_id", "n_tokens", "n_known", "base", "inside"]
    fields = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in held)
    scored = encoded.select(*held, "classes").mapInArrow(run, f"{fields}, forward double")
    more = F.coalesce("rare_base", F.lit(0.0))
    return scored.join(sums, "key", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), mod).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(lex.base_log)).alias("base_score"),
        (F.col("forward") + F.col("inside") + more).alias("score"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    """score() of the table documents; rows as there."""
    return score(table(spark, sf_dir, "documents"))

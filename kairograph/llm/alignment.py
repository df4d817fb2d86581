"""Cross-tokenizer alignment: how two vocabularies cut the same bytes.

Arrow batches are tokenised by both, checked to give back the text, and aligned by numpy over the sorted byte ends: each
distinct end closes one stretch in which one A token and one B token overlap, and every overlapping pair has exactly one
such stretch, so links are the two tokens found at each end by binary search, and groups end where both end.

A batch encodes each of its distinct words once. Texts are cut before a space that follows a character that is not
white, or that follows another than a space and precedes one that is not white: A's pattern always begins a match there,
and of B's pieces none holds a space after another character (models of other pieces get whole texts), so no token and
no group crosses the cut, and a text's tokens, links and groups are those of its words in turn. Words that may be cut
apart again are encoded many at once, joined by spaces; where the bytes do not come back, by halves. A text with a word
that does not come back alone, or with B's own mark of a space, is encoded whole.

Links are written once, as one number a link. Pairs are counted over the corpus; those with more than a 2^20th of all
links, hence fewer than 2^20 pairs, are broadcast, and only links of rarer pairs are shuffled to their counts, so no
frequent pair meets in one task.

Edge rows: a null or empty text, or one whose tokens' bytes differ from a space and the text, has zeros and an empty
groups_sha256. Repeated rows and null doc_ids each give a row, and each adds to the counts. An empty table gives no rows;
other columns of documents are left behind. A text is held whole, with arrays of its tokens.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.bestfit import JsonBpe, json_bpe
from kairograph.llm.bpe import LONG_PIECE
from kairograph.llm.common import durable, map_arrow, table

#: Pairs that may be broadcast at most.
FREQUENT = 1 << 20
#: Bytes of words that are encoded at once.
CHUNK = 1 << 15
#: Of the spaces before which no token goes on; what is white to A's pattern is white to re.
APART = re.compile(r" (?:(?<=\S )|(?<=[^ ] )(?=\S))")
#: A word to stand before others.
FIRST = "x"


@dataclass
class Pieces:
    """A sentencepiece model and its pieces' bytes: U+2581 is a space, <0xHH> the byte HH."""

    model: object
    bytes: list[bytes]
    apart: bool  # whether no piece holds a space after another character

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        made = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        return cls(model, made, not any("▁" in x.lstrip("▁") for x in names))

    def words(self, text: str | None) -> list[str]:
        """The text without the spaces at which it may be cut; the whole text if the pieces don't allow it, none if it has their mark."""
        return (APART.split(text) if self.apart else [text]) if text and "▁" not in text else []


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces.load(path)


@functools.lru_cache(maxsize=2)
def _sizes(path: str, by_pieces: bool) -> np.ndarray:
    if by_pieces:
        return np.array([len(x) for x in pieces(path).bytes], np.int32)
    ranks = json_bpe(path).ranks
    out = np.zeros(max(ranks.values()) + 1, np.int32)
    out[list(ranks.values())] = [len(x) for x in ranks]
    return out


def both(text: str | None, a: JsonBpe, b: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of space+text by a and of the text by b; none if either's bytes are not those of space+text."""
    none = np.zeros(0, np.int32), np.zeros(0, np.int32)
    if not text:
        return none
    spaced = " " + text
    theirs = b.model.encode(text, num_threads=1)
    if b"".join([b.bytes[i] for i in theirs]) != (want := spaced.encode()):
        return none
    return a.encode(spaced), np.array(theirs, np.int32)  # a's tokens hold all bytes, so that its join is always the text


def cuts(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """links (A id * width + B id), and the numbers of the A and of the B token that close each group.

    Every distinct end of either side closes one link: that of the tokens of both sides that hold its last byte, which
    are each side's first to end there or later. Where both end, a group ends.
    """
    at_a, at_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)  # the last ends are equal, so all are found
    closes_a = np.flatnonzero(b_ends[at_a] == a_ends)
    closes_b = at_a[closes_a]
    alone = np.ones(len(b), bool)
    alone[closes_b] = False
    wide = a.astype(np.int64) * width
    return np.concatenate([wide + b[at_a], wide[at_b[alone]] + b[alone]]), closes_a, closes_b


@functools.lru_cache(maxsize=1)
def _names(most: int) -> list[str]:
    """Every id before each of the marks that may follow it."""
    return [f"{i}{mark}" for mark in ",|;\n" for i in range(most)]


def listed(a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray, last: np.ndarray) -> list[str]:
    """a1,a2|b1;a3|b2,b3 of the ids, cut after the tokens of closes, of each word; last: the number of its last group."""
    most = 1 << max(16, int(max(a.max(initial=0), b.max(initial=0))).bit_length())
    before = np.concatenate([[0], closes_b[:-1] + 1])  # B tokens of the groups before
    marks_a, marks_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    marks_a[closes_a], marks_b[closes_b], marks_b[closes_b[last]] = most, 2 * most, 3 * most
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.repeat(before, np.diff(closes_a, prepend=-1))] = a + marks_a
    order[np.arange(len(b)) + np.repeat(closes_a + 1, np.diff(closes_b, prepend=-1))] = b + marks_b
    return "".join(map(_names(most).__getitem__, order.tolist())).split("\n")[:-1]


def grouped(a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray) -> str:
    return listed(a, b, closes_a, closes_b, np.array([-1]))[0] if len(a) else ""


@dataclass
class Words:
    """Alignments of words, each with a space before it; zeros and no links of one whose bytes do not come back."""

    counts: np.ndarray  # of each word: n_a, n_b, n_groups
    sizes: np.ndarray  # of its links
    starts: np.ndarray  # of its links
    links: np.ndarray
    groups: list[str]

    @classmethod
    def of(cls, words: list[str], a: JsonBpe, b: Pieces, a_sizes: np.ndarray, b_sizes: np.ndarray, width: int) -> Words:
        counts, names, links = np.zeros((len(words), 3), np.int64), [""] * len(words), [np.zeros(0, np.int64)]
        lengths = np.fromiter((len(x.encode()) + 1 for x in words), np.int64, len(words))
        whether = lambda test: np.fromiter(map(test, words), bool, len(words))
        white_first, white_last = whether(lambda x: not x or x[0].isspace()), whether(lambda x: not x or x[-1].isspace())
        space_last = whether(lambda x: not x or x[-1] == " ")
        large = whether(lambda x: not b.apart or len(x) >= LONG_PIECE // 4)  # a slower search for long matches would hold others up
        begin = (np.diff(np.cumsum(lengths) // CHUNK) > 0) | large[1:] | large[:-1] | space_last[:-1] | white_last[:-1] & white_first[1:]
        begin = np.flatnonzero(begin) + 1
        todo = list(itertools.pairwise([0, *begin.tolist(), len(words)]))[::-1] if words else []
        while todo:
            i, j = todo.pop()
            ours, theirs = both(" ".join([FIRST, *words[i:j]] if b.apart else words[i:j]), a, b)
            ends = np.cumsum(np.concatenate([[len(FIRST) + 1] if b.apart else [], lengths[i:j]]).astype(np.int64))
            a_ends, b_ends = np.cumsum(a_sizes[ours]), np.cumsum(b_sizes[theirs])
            at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
            if not len(ours) or (a_ends[at_a] != ends).any() or (b_ends[at_b] != ends).any():
                todo += [((i + j) // 2, j), (i, (i + j) // 2)] if j - i > 1 else []
                continue
            made, closes_a, closes_b = cuts(ours, theirs, a_ends, b_ends, width)
            last = np.searchsorted(closes_a, at_a)
            counts[i:j] = np.diff(np.array([at_a, at_b, last]), axis=1, prepend=-1).T[i - j :]
            made = made[np.argsort(np.concatenate([a_ends, np.delete(b_ends, closes_b)]), kind="stable")]
            links.append(made[len(made) - (counts[i:j] @ [1, 1, -1]).sum() :])
            names[i:j] = listed(ours, theirs, closes_a, closes_b, last)[i - j :]
        sizes = counts @ [1, 1, -1]
        return cls(counts, sizes, np.cumsum(sizes) - sizes, np.concatenate(links), names)

    def joined(self, words: np.ndarray) -> tuple[np.ndarray, str, np.ndarray]:
        """n_a, n_b and n_groups, the groups, and the links of a text of these words."""
        sizes = self.sizes[words]
        at = np.repeat(self.starts[words] - np.cumsum(sizes) + sizes, sizes)
        return self.counts[words].sum(0), ";".join([self.groups[i] for i in words.tolist()]), self.links[at + np.arange(len(at))]


def each(texts: list[str | None], a: JsonBpe, b: Pieces, a_sizes: np.ndarray, b_sizes: np.ndarray, width: int) -> Iterator[tuple[Sequence[int], str, np.ndarray]]:
    """(n_a, n_b, n_groups), groups and links of each text."""
    numbers = defaultdict(itertools.count().__next__)
    held = [np.fromiter(map(numbers.__getitem__, b.words(text)), np.int32) for text in texts]
    known = Words.of(list(numbers), a, b, a_sizes, b_sizes, width)
    for text, words in zip(texts, held, strict=True):
        if len(words) and known.counts[words, 0].all():
            yield known.joined(words)
        else:
            ours, theirs = both(text, a, b)
            made, closes_a, closes_b = cuts(ours, theirs, np.cumsum(a_sizes[ours]), np.cumsum(b_sizes[theirs]), width)
            yield (len(ours), len(theirs), len(closes_a)), grouped(ours, theirs, closes_a, closes_b), made


def aligned(docs: DataFrame, a_path: str, b_path: str, width: int) -> DataFrame:
    """__row, doc_id, n_a, n_b, n_groups, groups_sha256 and links (array<long>: A id * width + B id)."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = json_bpe(a_path), pieces(b_path)
        a_sizes, b_sizes = _sizes(a_path, False), _sizes(b_path, True)
        counts, shas, links = [], [], []
        for n, names, made in each(batch.column(2).to_pylist(), a, b, a_sizes, b_sizes, width):
            counts.append(n)
            shas.append(hashlib.sha256(names.encode()).hexdigest() if n[0] else "")
            links.append(made)
        offsets = np.zeros(len(links) + 1, np.int32)
        np.cumsum([len(x) for x in links], out=offsets[1:])
        numbers = np.ascontiguousarray(np.array(counts, np.int64).T)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *map(pa.array, numbers), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(links)))],
            ["__row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", F.col("text").cast("string")), fn,
        f"__row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>",
    )


def counted(links: DataFrame, width: int) -> DataFrame:
    """pair, count over the corpus, best (whether it is the highest of its B id, ties included)."""
    counts = durable(links.groupBy("pair").agg(F.count("*").alias("count")), "pair-counts").withColumn("b", F.col("pair") % width)
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    width = pieces(b_path).model.get_piece_size()
    kept = durable(aligned(docs, a_path, b_path, width), "links", compression="zstd", **{"parquet.enable.dictionary": "false"})
    links = kept.select("__row", F.explode("links").alias("pair"))
    counts = counted(links, width)
    total = kept.agg(F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("n")).first()["n"]
    often = total // FREQUENT
    frequent = F.broadcast(counts.where(F.col("count") > often))
    rare = counts.where(F.col("count") <= often)
    gathered = [F.sum("n").alias("n_links"), F.sum("best").alias("n_best"), F.sum("count_sum").alias("count_sum")]
    some = lambda found: found.groupBy("__row").agg(F.count("*").alias("n"), F.sum("best").alias("best"), F.sum("count").alias("count_sum"))
    sums = some(links.join(frequent, "pair"))
    if often:
        sums = sums.unionByName(some(links.join(frequent, "pair", "left_anti").join(rare.hint("merge"), "pair")))
    sums = sums.groupBy("__row").agg(*gathered)
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return kept.drop("links").join(sums.hint("merge"), "__row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

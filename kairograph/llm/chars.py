"""Texts as arrays of code points, so that tokens are found and hashed by numpy over many texts at once."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

MOST_CHARS = 400_000  # of a block of texts; a longer text is a block of its own
SPACE, MARK, DIGIT, LOWER, UPPER = range(5)

# First and last code point of the main blocks of each script that has letters of its own.
SCRIPTS = {
    "Latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F),),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF),),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "Devanagari": ((0x900, 0x97F),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Kana": ((0x3040, 0x30FF),),
    "Han": ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
    "Hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its kind; its lower case (where that is one character); its script, 0 for none, last for others."""
    kinds = np.full(0x110000, MARK, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        x = chr(cp)
        if x.isalpha():
            kinds[cp] = LOWER
            low = x.lower()
            if len(low) == 1 and low != x:
                kinds[cp], lower[cp] = UPPER, ord(low)
        elif x.isspace():
            kinds[cp] = SPACE
        elif x.isdecimal():
            kinds[cp] = DIGIT
        elif unicodedata.category(x) in ("Mn", "Mc"):
            kinds[cp] = LOWER  # combining marks belong to the word they stand in
    script = np.where(kinds >= LOWER, len(SCRIPTS) + 1, 0).astype(np.uint8)
    for number, blocks in enumerate(SCRIPTS.values(), 1):
        for first, last in blocks:
            part = script[first : last + 1]
            part[part > 0] = number
    return kinds, lower, script


def slices(texts: list[str | None], most: int = 4 * MOST_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most `most` characters, or one text; bounds what is held at once."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text or "") > most:
            yield first, i
            first, size = i, 0
        size += len(text or "")
    if texts:
        yield first, len(texts)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, code points, lengths) of consecutive texts; each text is followed by a line feed."""
    first, size = 0, 0
    for i in range(len(texts) + 1):
        more = len(texts[i] or "") + 1 if i < len(texts) else 0
        if i > first and (i == len(texts) or size + more > MOST_CHARS):
            part = [x or "" for x in texts[first:i]]
            raw = ("\n".join(part) + "\n").encode("utf-32-le", "surrogatepass")
            yield first, i, np.frombuffer(raw, "<u4"), np.array([len(x) + 1 for x in part], np.int64)
            first, size = i, 0
        size += more


def runs(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero value in codes; `wanted` breaks a run where it is true."""
    change = np.empty(len(codes), bool)
    change[:1] = True
    np.not_equal(codes[1:], codes[:-1], out=change[1:])
    change |= wanted
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(codes))
    keep = codes[at] != 0
    return at[keep], ends[keep]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) over uint64."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))

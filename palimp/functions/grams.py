"""Anchors for substring search: hashes that a text must share with any needle it contains.

A needle of 12 or more characters spans whole windows of eight 5-grams, and the smallest hash of such a
window (its minimiser) is also a minimiser of every text around it. Shorter needles are their own anchor, whole: texts emit the
windows of each length that occurs. So a text that contains the needle always emits the needle's anchor;
sharing an anchor makes a candidate, which the caller confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimp.session import ship_by_value

ship_by_value(__name__)

LONG_NEEDLE, GRAM, WINDOW = 12, 5, 8
#: The class of long needles; a shorter needle's class is its length.
LONG = 0
#: Strings, or places of a text, that are hashed at once.
AT_ONCE = 1 << 18

# Odd 64-bit multipliers of the rolling and mixing hashes.
_ROLL = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9


def _gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    if len(codes) < size:
        return np.empty(0, dtype=np.uint64)
    count = len(codes) - size + 1
    h = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        h = h * np.uint64(_ROLL) + codes[i:i + count]
    h ^= h >> np.uint64(31)
    h *= np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def needle_class(length: int) -> int:
    return LONG if length >= LONG_NEEDLE else length


def _class_anchors(codes: np.ndarray, cls: int) -> np.ndarray:
    if cls != LONG:
        return _gram_hashes(codes, cls)
    h = _gram_hashes(codes, GRAM)
    if len(h) < WINDOW:
        return np.empty(0, dtype=np.uint64)
    return np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)


def short_anchors(needles: Column) -> Column:
    """The one anchor of each needle below the long ones; needles of one length are hashed together."""
    @F.pandas_udf("bigint")
    def anchors(given: pd.Series) -> pd.Series:
        lengths, out = given.str.len().to_numpy(), np.zeros(len(given), dtype=np.int64)
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            codes = _codes("".join(given.iloc[at])).reshape(len(at), size)
            out[at] = _gram_hashes(codes.T, int(size))[0].view(np.int64)
        return pd.Series(out)
    return anchors(needles)


def needle_anchors(needle: Column) -> Column:
    """All anchors of a needle in its class."""
    @F.pandas_udf("array<bigint>")
    def anchors(needles: pd.Series) -> pd.Series:
        def one(n):
            return np.unique(_class_anchors(_codes(n), needle_class(len(n)))).view(np.int64)
        return needles.map(one)
    return anchors(needle)


def let_pass(anchors: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """The anchors that a Bloom filter of 64-bit words knows; an anchor's two bits are its low half and its high half."""
    bits = anchors.view(np.uint64)
    known = np.ones(len(bits), dtype=bool)
    for half in (bits, bits >> np.uint64(32)):
        place = half & np.uint64(len(bloom) * 64 - 1)
        known &= (bloom[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1
    return anchors[known]


def text_anchors(text: Column, classes: list[int], bloom: np.ndarray) -> Column:
    """Distinct anchors of a whole text in the given classes that the filter lets pass."""

    @F.pandas_udf("array<bigint>")
    def anchors(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return np.empty(0, dtype=np.int64)
            codes = _codes(t)
            return let_pass(np.unique(np.concatenate([_class_anchors(codes, c) for c in classes])).view(np.int64), bloom)
        return texts.map(one)
    return anchors(text)


def _bytes_of(strings: pa.StringArray) -> np.ndarray:
    """The UTF-8 bytes of all strings, one after the other."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and len(ends) else np.empty(0, np.uint8)


def _all_codes(strings: pa.StringArray) -> np.ndarray:
    """The characters of all strings, one after the other."""
    return np.frombuffer(_bytes_of(strings).tobytes().decode().encode("utf-32-le"), np.uint32)


def joined(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, one after the other, and where each text ends."""
    texts = pc.fill_null(texts, "").combine_chunks()
    return _all_codes(texts), np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)


def as_rows(strings: pa.StringArray, size: int) -> np.ndarray:
    """The characters of strings of one length, a string in a row."""
    return _all_codes(strings).reshape(len(strings), size)


def whole_hashes(strings: pa.StringArray) -> np.ndarray:
    """A hash of each string, which for a short needle is its anchor; strings of one length are hashed together."""
    lengths, out = pc.utf8_length(strings).to_numpy(zero_copy_only=False), np.zeros(len(strings), dtype=np.uint64)
    for size in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == size)
        for at in (places[i : i + AT_ONCE] for i in range(0, len(places), AT_ONCE)):
            out[at] = _gram_hashes(as_rows(strings.take(pa.array(at)), size).astype(np.uint64).T, size)[0]
    return out


def windows(codes: np.ndarray, ends: np.ndarray, cls: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, where they begin, number of the text) of a class, for texts one after the other; none spans two texts."""
    span = GRAM + WINDOW - 1 if cls == LONG else cls
    for first in range(0, len(codes) - span + 1, AT_ONCE):
        anchors = _class_anchors(codes[first : first + AT_ONCE + span - 1].astype(np.uint64), cls)
        starts = np.arange(first, first + len(anchors))
        text = np.searchsorted(ends, starts, side="right")
        inside = starts + span <= ends[text]
        yield anchors[inside], starts[inside], text[inside]


def pieces(texts: pa.StringArray, size: int, step: int) -> pa.StringArray:
    """The pieces of ``size`` characters that begin at every ``step``-th character of a text, but none that begins or ends
    with a blank, holds two in a row or a sharp s."""
    texts = pc.fill_null(texts, "")
    data = np.concatenate([_bytes_of(texts), np.zeros(2, np.uint8)])
    at = np.flatnonzero((data[:-2] & 0xC0) != 0x80)  # where characters begin
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.maximum((lengths - size) // step + 1, 0)
    begin = np.repeat(np.cumsum(lengths) - lengths - step * (np.cumsum(count) - count), count) + step * np.arange(count.sum())
    lead, after, third = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    blank = (lead == 32) | ((lead >= 9) & (lead <= 13))
    # Before an end of line other than a line feed a blank counts as the last character, as it does in Java's patterns.
    line_end = ((lead == 0xC2) & (after == 0x85)) | ((lead == 0xE2) & (after == 0x80) & ((third == 0xA8) | (third == 0xA9)))
    twice = np.concatenate([[0], np.cumsum(blank[:-1] & blank[1:])])
    sharp = np.concatenate([[0], np.cumsum((lead == 0xC3) & (after == 0x9F))])
    last = begin + size - 1
    kept = ~blank[begin] & ~blank[last] & (twice[last] == twice[begin]) & (sharp[last + 1] == sharp[begin])
    if size > 1:
        kept &= ~(line_end[last] & blank[last - 1])
    begin = begin[kept]
    bounds = np.append(at, len(data) - 2)
    first, width = bounds[begin], bounds[begin + size] - bounds[begin]
    ends = np.concatenate([[0], np.cumsum(width)])
    chosen = data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], width)]
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(chosen))

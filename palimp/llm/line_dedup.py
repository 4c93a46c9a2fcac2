"""Repeated passages, by hashing sentences, lines and windows of words.

A unit is a line or a sentence of one. Units are normalised and hashed; their digests are grouped over all documents, and
the document with the smallest id owns a unit. In every other document the unit is a repeat, as is a second occurrence
in one document. A passage need not begin or end where a unit does, so windows of MIN_WORDS words are owned and repeated
in the same way. Only those are hashed that can repeat: the smallest hash of a window's short word runs is its print, equal
windows have equal prints, and a window whose print stands in one document only is left out.
A run of repeated words is cut out if it is long enough to be a passage, so single common sentences stay where they are;
the spans that are cut are reported by their offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.base import query, staged, table, text_of
from palimp.llm.shingles import U, _powers_to, mixed, word_hashes
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Words that a run of repeats has at least to be cut out.
MIN_WORDS = 40
#: Words of the short runs of which a print is one.
PRINT_WORDS = 12
#: A run that goes on for fewer words in a sentence that does not repeat agrees with it by chance, and ends before it.
EDGE_WORDS = 3
#: Up to the first marks before a blank or an end of line, else the rest of the line.
UNIT = re.compile(r"(?:[^\n.!?]++|[.!?]++(?=[^ \t\n]))*+[.!?]*+")
#: White space of str.split() that is not an ASCII blank of :func:`word_hashes`.
OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def units_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, form) of each unit that has a word; the form is its lower-cased words joined by spaces."""
    found = []
    for m in UNIT.finditer(text):
        words = m.group().lower().split()
        if words:
            found.append((*m.span(), len(words), " ".join(words)))
    return found


def digest_of(form: str) -> bytes:
    return hashlib.blake2b(form.encode("utf-8", "replace"), digest_size=16).digest()


def hashed_words(text: str) -> np.ndarray:
    """A hash of each lower-cased word."""
    lower = text.lower()
    return word_hashes((" ".join(lower.split()) if OTHER_BLANK.search(lower) else lower).encode("utf-8", "replace"))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by its first word."""
    if len(words) < n:
        return words[:0]
    up, down = _powers_to(len(words))
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(words * up, dtype=U)])
    return mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def window_prints(words: np.ndarray, min_words: int) -> np.ndarray:
    """The print of each window of ``min_words`` words, by its first word."""
    width = min(PRINT_WORDS, min_words)
    low, have, want = run_hashes(words, width), 1, min_words - width + 1
    if len(low) < want:
        return low[:0]
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def repeated_runs(text: str, repeats: set[bytes], windows: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Spans of the runs of at least ``min_words`` words that are in repeated units or windows."""
    units = units_of(text)
    first = np.cumsum([0, *[u[2] for u in units]])
    if first[-1] < min_words:
        return []
    seen: set[str] = set()
    again_units = []
    for i, (_, _, _, form) in enumerate(units):
        if form in seen or repeats and digest_of(form) in repeats:
            again_units.append(i)
        seen.add(form)
    hashes, again = run_hashes(hashed_words(text), min_words), np.zeros(0, dtype=np.int64)
    ordered = np.sort(hashes)
    if (ordered[1:] == ordered[:-1]).any():
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        # In one document, a repeat lies wholly behind the first occurrence.
        again = np.flatnonzero(at[which] + min_words <= np.arange(len(hashes)))
    if len(windows):
        again = np.union1d(again, np.flatnonzero(np.isin(hashes, windows)))
    if not again_units and not len(again):
        return []
    marked = np.zeros(first[-1] + 1, dtype=np.int32)
    at_units = np.array(again_units, dtype=np.int64)
    np.add.at(marked, np.concatenate([first[at_units], again]), 1)
    np.add.at(marked, np.concatenate([first[at_units + 1], again + min_words]), -1)
    inside = np.concatenate([[False], np.cumsum(marked[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    runs = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= min_words]
    if not runs:
        return []
    places = [m.span() for m in re.finditer(r"\S+", text)]
    spans = []
    for a, b in runs:
        # The units that hold the first and the last word.
        i, j = (int(np.searchsorted(first, x, "right")) - 1 for x in (a, b - 1))
        if i < j and first[i] < a and first[i + 1] - a < EDGE_WORDS:
            i, a = i + 1, int(first[i + 1])
        if i < j and b < first[j + 1] and b - first[j] < EDGE_WORDS:
            j, b = j - 1, int(first[j])
        spans.append((units[i][0] if a == first[i] else places[a][0], units[j][1] if b == first[j + 1] else places[b - 1][1]))
    return spans


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            forms = [{u[3] for u in units_of(text)} for text in part.column("text").to_pylist()]
            halves = np.frombuffer(b"".join([digest_of(form) for own in forms for form in own]), dtype=np.int64).reshape(-1, 2)
            owners = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(forms)), [len(own) for own in forms])))
            yield pa.RecordBatch.from_arrays([owners, pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "h1", "h2"])


def _printer(min_words: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                found = np.unique(window_prints(hashed_words(text.as_py()), min_words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(key, len(found)), pa.array(found)], ["doc_id", "h"])

    return prints


def _windower(min_words: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, shared in zip(batch.column("doc_id"), batch.column("text"), batch.column("prints")):
                words = hashed_words(text.as_py())
                there = np.isin(window_prints(words, min_words), shared.values.to_numpy().astype(U))
                found = np.unique(run_hashes(words, min_words)[there]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(key, len(found)), pa.array(found)], ["doc_id", "h"])

    return windows


def _pairs(units: pa.ListScalar) -> set[bytes]:
    """The digests of units that are given as two halves."""
    if not units.is_valid:
        return set()
    raw = np.column_stack([units.values.field(half).to_numpy() for half in ("h1", "h2")]).tobytes()
    return {raw[at : at + 16] for at in range(0, len(raw), 16)}


def _cutter(min_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, spans = [], []
                for text, repeats, windows in zip(part.column("text"), part.column("repeats"), part.column("windows")):
                    text, known = text.as_py(), _pairs(repeats)
                    found = repeated_runs(text, known, windows.values.to_numpy().astype(U) if windows.is_valid else [], min_words)
                    pieces, last = [], 0
                    for start, end in found:
                        pieces.append(text[last:start])
                        last = end
                    kept.append("".join([*pieces, text[last:]]))
                    spans.append([{"start": s, "end": e, "words": len(text[s:e].split())} for s, e in found])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.string()), pa.array(spans, kind)], ["doc_id", "text", "removed"]
                )

    return cut


def repeated_windows(ranked: DataFrame, min_words: int) -> DataFrame:
    """doc_id, h: the windows of each document that stand in one with a smaller id too."""
    prints = staged(ranked.mapInArrow(_printer(min_words), "doc_id long, h long"), "prints")
    several = prints.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("last > owner").select("h")
    shared = prints.join(several, "h").groupBy("doc_id").agg(F.collect_list("h").alias("prints"))  # bounded by one document
    windows = staged(ranked.join(shared, "doc_id").select("doc_id", "text", "prints").mapInArrow(_windower(min_words), "doc_id long, h long"), "windows")
    owners = windows.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("last > owner").select("h", "owner")
    return staged(windows.join(owners, "h").where("doc_id > owner").select("doc_id", "h"), "repeated")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, removed: one row per input row; ``removed`` has start, end (in characters of the original) and words
    of each span that was cut out, ``text`` what is left.

    The occurrence in the smallest id stays, in the first place in it. Null text is empty and stays empty; a null id
    counts as the largest. Rows that repeat an id count as one document for ownership, so a passage that they share stays
    in all of them. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    ranked = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    digests = staged(ranked.mapInArrow(_digests, "doc_id long, h1 long, h2 long"), "digests")  # read twice
    owners = digests.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("last > owner")
    repeats = digests.join(owners, ["h1", "h2"]).where("doc_id > owner")
    both = repeats.select("doc_id", F.struct("h1", "h2").alias("unit"), F.lit(None).cast("long").alias("h")).unionByName(
        repeated_windows(ranked, min_words), allowMissingColumns=True)
    per_doc = both.groupBy("doc_id").agg(F.collect_list("unit").alias("repeats"), F.collect_list("h").alias("windows"))  # bounded by one document
    marked = ranked.join(per_doc, "doc_id", "left").select("doc_id", "text", "repeats", "windows")
    out = marked.mapInArrow(_cutter(min_words), "doc_id long, text string, removed array<struct<start:int,end:int,words:int>>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != 2**63 - 1, F.col("doc_id")))


@query("op5_line_hash_dedup")
def op5(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))

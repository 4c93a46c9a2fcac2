"""Many terms in one pass over a text, run on the searched views, with offsets back to the text.

An automaton of the first characters of all terms tells where one may begin; the terms themselves are a sorted list, in which the
longest that begins there is found by binary search and the shorter ones by links to the terms that begin it. So what a task
holds is little more than the terms.

The views and foldings are those of :mod:`palimp.operators.terms`: page text with white space squeezed and, where a line ends in
a hyphen, without hyphenation; raw content folded in ASCII only; other values folded. Folding goes character by character.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa

from palimp.session import ship_by_value

ship_by_value(__name__)

#: Characters of a term in the automaton; characters of a text that are first looked up among the terms.
HEAD, AHEAD = 6, 64
#: Bytes of rows that are turned into Python objects at once.
SLICE_BYTES = 2 << 20
_BLANKS = re.compile(r"[\x20\x09-\x0D]")
_ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fold_char(c: str) -> str:
    return c.upper().lower()


def folded(text: str) -> tuple[str, np.ndarray | None]:
    """The folded text and, for each of its characters, the index of the one it comes from; None where they are the same."""
    if text.isascii():
        return text.lower(), None
    # Character by character: a small sigma at the end of a word is the only letter that lower() decides by its neighbours.
    whole = text.upper().lower().replace("\u03c2", "\u03c3")
    if len(whole) == len(text):
        return whole, None
    lengths = np.ones(len(text), dtype=np.int64)
    for i in np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) > 127):
        lengths[i] = len(fold_char(text[i]))
    return whole, np.repeat(np.arange(len(text)), lengths)


def squeezed(text: str, hyphens: bool) -> tuple[str, np.ndarray]:
    """White space runs as one space, none at the ends, without hyphenation if asked; and the index each character comes from."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    index = np.arange(len(codes))
    if hyphens:
        at = np.flatnonzero((codes[:-1] == 45) & (codes[1:] == 10))
        keep = np.ones(len(codes), dtype=bool)
        keep[at] = keep[at + 1] = False
        codes, index = codes[keep], index[keep]
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    keep = ~blank | np.concatenate([[False], ~blank[:-1]])
    if len(keep) and blank[keep][-1:].any():
        keep[np.flatnonzero(keep)[-1]] = False
    codes = np.where(blank, np.uint32(32), codes)[keep]
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), index[keep]


def searched(text: str, kind: str, case_sensitive: bool) -> list[tuple[str, np.ndarray | None]]:
    """The views of a value with their offsets."""
    views: list[tuple[str, np.ndarray | None]] = [(text, None)]
    if kind == "page_text":
        views = [squeezed(text, hyphens) for hyphens in ((False, True) if "-\n" in text else (False,))]
    if case_sensitive:
        return views
    if kind == "raw_content":
        return [(text.translate(_ASCII), None)]
    out = []
    for view, index in views:
        whole, inner = folded(view)
        out.append((whole, index if inner is None else inner if index is None else index[inner]))
    return out


def needle(term: str, kind: str, case_sensitive: bool) -> str:
    if kind == "page_text" and _BLANKS.search(term):
        term = squeezed(term, False)[0]
    if case_sensitive:
        return term
    return term.translate(_ASCII) if kind == "raw_content" else folded(term)[0]


class Needles:
    """The searched forms of terms of one kind, sorted. Terms with the same form share it."""

    def __init__(self, words: list[str]):
        order = sorted((i for i, word in enumerate(words) if word), key=words.__getitem__)
        starts = [k for k, i in enumerate(order) if not k or words[i] != words[order[k - 1]]]
        self.words, self.starts, self.ids = [words[order[k]] for k in starts], array("i", [*starts, len(order)]), array("i", order)
        self.most = max(map(len, self.words), default=0)
        self.shorter = array("i", [-1]) * len(self.words)  # the longest other form that begins this one
        self.heads, last = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), -1
        for i, word in enumerate(self.words):
            while last >= 0 and not word.startswith(self.words[last]):
                last = self.shorter[last]
            self.shorter[i], last = last, i
            self.heads.add_word(word[:HEAD])
        self.heads.make_automaton()

    def places(self, text: str) -> list[tuple[int, int]]:
        """(start, form) of every occurrence."""
        found, words, shorter = [], self.words, self.shorter
        for start in {last + 1 - length for last, length in self.heads.iter(text)} if words else ():
            ahead = text[start : start + AHEAD]
            i = bisect_right(words, ahead)
            if self.most > AHEAD and i < len(words) and words[i].startswith(ahead):
                i = bisect_right(words, text[start : start + self.most])
            i -= 1
            while i >= 0 and not text.startswith(words[i], start):
                i = shorter[i]
            while i >= 0:
                found.append((start, i))
                i = shorter[i]
        return found

    def terms(self, i: int) -> array:
        """The terms of a form."""
        return self.ids[self.starts[i] : self.starts[i + 1]]


class Matcher:
    """All terms as needles per kind of value, built when they are first asked for."""

    def __init__(self, terms: list[str], case_sensitive: bool = False):
        self.terms, self.case_sensitive, self.built = terms, case_sensitive, {}

    def needles(self, kind: str) -> Needles:
        if kind not in self.built:
            words = (needle(term, kind, self.case_sensitive) for term in self.terms)
            # Where the searched form is the term itself, they are one object.
            self.built[kind] = Needles([term if word == term else word for term, word in zip(self.terms, words)])
        return self.built[kind]

    def spans(self, text: str, kind: str) -> set[tuple[int, int, int]]:
        """(start, end, number of the term) of every occurrence, overlapping ones too."""
        needles, found = self.needles(kind), set()
        for view, index in searched(text, kind, self.case_sensitive) if needles.words else []:
            for first, i in needles.places(view):
                last = first + len(needles.words[i]) - 1
                span = (first, last + 1) if index is None else (int(index[first]), int(index[last]) + 1)
                found.update((*span, term) for term in needles.terms(i))
        return found

    def found(self, text: str, kind: str) -> list[str]:
        """The terms that occur."""
        needles, forms = self.needles(kind), set()
        for view, _ in searched(text, kind, self.case_sensitive) if needles.words else []:
            forms.update(i for _, i in needles.places(view))
        return [self.terms[t] for t in sorted(t for i in forms for t in needles.terms(i))]

    def chosen(self, text: str, kind: str) -> tuple[list[tuple[int, int]], int]:
        """Spans to remove, longest terms first and none over another, and the number of occurrences of every term in the text."""
        by_term: dict[int, list[tuple[int, int]]] = {}
        for start, end, term in sorted(self.spans(text, kind)):
            by_term.setdefault(term, []).append((start, end))
        taken, spans, occurrences = bytearray(len(text)), [], 0
        for term in sorted(by_term, key=lambda i: (-len(self.terms[i]), self.terms[i])):
            last = 0
            for start, end in by_term[term]:
                if start >= last:  # occurrences in the text as it was do not overlap
                    occurrences, last = occurrences + 1, end
                if not any(taken[start:end]):  # what is left of the text may hold others
                    taken[start:end] = b"\1" * (end - start)
                    spans.append((start, end))
        return sorted(spans), occurrences


def matcher_of(held: dict) -> Matcher:
    """The matcher of a broadcast dictionary of terms, kept in it for the tasks that follow in the same worker."""
    if "matcher" not in held:
        held["matcher"] = Matcher(held["terms"], held["case_sensitive"])
    return held["matcher"]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about ``most`` bytes: a task holds one batch as it came, but only one piece of it as objects."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

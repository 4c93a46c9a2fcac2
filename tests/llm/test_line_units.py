"""What repeated passages are found by: units by their words, hashed only where a digest is compared, and once a document."""

import random
import re

import numpy as np

from palimp.llm import line_dedup

#: The units as they are defined: up to marks before a blank or an end of line, else the rest of the line.
DEFINED = re.compile(r"[^\n]*?[.!?]+(?=[ \t]|\n|$)|[^\n]+")


def test_units_are_those_defined():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choices("ab.!? \n\t\r\x1c\xa0ΣσİÉé", k=rng.randrange(60)))
        spans = [m.span() for m in DEFINED.finditer(text) if m.group().split()]
        assert [u[:2] for u in line_dedup.units_of(text)] == spans
        whole = line_dedup.word_hashes(" ".join(text.lower().split()).encode())
        assert np.array_equal(line_dedup.hashed_words(text), whole)


def test_a_text_without_known_units_is_not_digested(monkeypatch):
    monkeypatch.setattr(line_dedup.hashlib, "blake2b", None)
    words = " ".join(f"w{i}" for i in range(50))
    assert line_dedup.repeated_runs(f"{words}.\nOther {words}.\n{words}.", set(), [], 40) == [(197, 578)]  # from the second on, behind its first word


def test_digests_are_made_once(spark, monkeypatch):
    labels, staged = [], line_dedup.staged
    monkeypatch.setattr(line_dedup, "staged", lambda df, label, **options: labels.append(label) or staged(df, label, **options))
    line = " ".join(f"w{i}" for i in range(50)) + "."
    rows = [(2, f"First.\n{line}\nLast."), (1, line), (None, line), (3, None)]
    out = line_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.text, [(s.start, s.end, s.words) for s in r.removed]) for r in out.collect()}
    assert labels.count("digests") == 1
    assert got == {1: (line, []), 2: ("First.\n\nLast.", [(7, 7 + len(line), 50)]), None: ("", [(0, len(line), 50)]), 3: ("", [])}

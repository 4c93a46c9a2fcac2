"""What a task holds for many terms and long batches."""

import random

import pyarrow as pa

from palimp.functions import matching
from palimp.functions.matching import HEAD, Matcher, slices


def test_matcher_holds_little_more_than_its_terms():
    rng = random.Random(5)
    terms = ["".join(rng.choices("abcdefgh.", k=40)) for _ in range(2000)]
    matcher = Matcher(terms)
    assert matcher.found(f"x{terms[7]}y", "other") == [terms[7]]
    assert matcher.needles("other").heads.get_stats()["nodes_count"] <= HEAD * len(terms) + 1


def test_nested_long_and_repeated_terms_match_brute_force():
    rng = random.Random(6)
    terms = ["".join(rng.choices("ab", k=k)) for k in (1, 2, 3, 5, 6, 7, 9, 70, 130) for _ in range(4)] + ["Ab", "aB", "ß", "ss", "Σ"]
    texts = ["".join(rng.choices("ab", k=300)) for _ in range(20)] + ["".join(rng.sample(terms, 20)) for _ in range(20)] + ["", "ΑΣ ας", "İß"]
    fold = lambda t: "".join(c.upper().lower() for c in t)
    for case_sensitive, form in ((True, str), (False, fold)):
        matcher = Matcher(terms, case_sensitive)
        for text in texts:
            assert matcher.found(text, "other") == [t for t in terms if form(t) in form(text)]
            if case_sensitive:
                assert {s[:2] for s in matcher.spans(text, "other")} == {(i, i + len(t)) for t in terms for i in range(len(text)) if text.startswith(t, i)}


def test_batches_are_worked_on_in_pieces():
    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "t": ["x" * 10_000] * 1000})
    pieces = list(slices(iter([batch, batch.slice(0, 0)]), 1 << 20))
    assert pa.Table.from_batches(pieces).to_pylist() == batch.to_pylist() and max(p.num_rows for p in pieces) < 110


def test_terms_without_a_blank_are_not_squeezed(monkeypatch):
    terms = ["a@b.c", "x y", "", "-\n", " a  b\t"]
    forms = [matching.squeezed(t, False)[0] for t in terms]
    asked = []
    monkeypatch.setattr(matching, "squeezed", lambda text, hyphens, done=matching.squeezed: asked.append(text) or done(text, hyphens))
    assert [matching.needle(t, "page_text", True) for t in terms] == forms and asked == terms[3:]

"""Decontamination against brute force, with nulls, repeats, short items, clashing names and a benchmark beyond the broadcast bound."""

import hashlib
import random
import re

import pytest

from palimp.llm import decontamination

SCHEMA = "doc_id long, text string, n_hit int, row string, windows string, spans string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for i in range(len(w)):
            for size in range(1, window + 1):
                if i + size <= len(w) and tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids |= windows[tuple(w[i : i + size])]
        out.append((doc_id, len(w), len(hit), sorted(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    random.seed(3)
    vocabulary = ["the", "of", "Été", "naïve", "x1", "b", "c", "d", "e", "ß"]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, text(random.choice([14, 25]))) for i in range(12)] + [(20, "Q-tip"), (21, None), (22, ""), (None, "one two three"), (20, "Q-tip"), (30, "?!")]
    docs = [(i, text(40) + ", " + (items[i % 12][1].upper() if i % 3 else "") + "; " + text(5)) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "a q TIP b"), (104, "one, TWO\nthree"), (105, items[0][1]), (105, items[0][1]), (None, "q tip"), (106, " ".join(vocabulary * 3000))]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, items = corpus
    return (spark.createDataFrame([(i, t, 1, "r", "w", "s") for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("most", [100_000, 0])
def test_leaks_equal_brute_force(tables, corpus, most):
    found = decontamination.leaks(*tables, most_windows=most).select("row.doc_id", "n_words", "n_hit", "item_ids", "items_sha256").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(*corpus)


def test_spans_and_documents_are_removed(tables, corpus):
    docs, items = tables
    cut = decontamination.decontaminated(docs, items)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[104] == " " and texts[103] == "a   b" and texts[102] == "..." and texts[100] is None
    assert decontamination.leaks(cut.where("doc_id < 100"), items.where("item_id < 12")).where("n_hit > 0").count() == 0
    clean = {r[0] for r in brute(*corpus) if r[2] == 0}
    kept = decontamination.decontaminated(docs, items, remove="documents")
    assert {r.doc_id for r in kept.collect()} == clean and kept.columns == docs.columns


def test_empty_tables(tables):
    docs, items = tables
    assert decontamination.leaks(docs.limit(0), items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError):
        decontamination.decontaminated(docs, items, remove="words")

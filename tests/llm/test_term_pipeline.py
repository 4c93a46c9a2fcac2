"""Pipelined term search against brute force: ties, repeats, nulls, many shards and blocks, a vocabulary beyond the broadcast bound."""

import math
import random
import re
from collections import Counter

import pytest

from palimp.llm import term_pipeline

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in counts:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    random.seed(5)
    common, rare = ["the", "a", "und", "naïve", "Été"], [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(random.choice(common if random.random() < 0.5 else rare) for _ in range(n))
    docs = [(i, text(random.choice([1, 5, 40, 300]))) for i in range(120)] + [(3, "the w1"), (500, "The, W1!"), (501, "the w1"), (501, "the w1"), (None, "the w1")]
    docs += [(600, None), (601, ""), (602, "?!"), (603, " ".join(rare * 300))]
    items = [(i, text(12)) for i in range(9)] + [(20, "the w1"), (20, "w2"), (21, None), (22, "..."), (23, "unheard"), (None, "w3 THE")]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, items = corpus
    schema = "doc_id long, text string, item_id long, score string, shard int, term string"
    return spark.createDataFrame([(i, t, 1, "s", 2, "t") for i, t in docs], schema).repartition(3), spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, block int, w int")


@pytest.mark.parametrize("shard_docs,block_items,most_terms", [(2048, 256, 200_000), (7, 2, 0), (30, 1, 200_000)])
def test_search_equals_brute_force(tables, corpus, monkeypatch, shard_docs, block_items, most_terms):
    monkeypatch.setattr(term_pipeline, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(term_pipeline, "BUNDLE_ITEMS", block_items)
    got = term_pipeline.search(*tables, k=10, most_terms=most_terms).collect()
    assert sorted(map(tuple, got), key=str) == brute(*corpus, 10)


def test_empty_tables_and_nothing_in_common(tables):
    docs, items = tables
    assert term_pipeline.search(docs.limit(0), items).count() == 0
    assert term_pipeline.search(docs, items.limit(0)).count() == 0
    assert term_pipeline.search(docs, items.where("item_id in (21, 22, 23)")).count() == 0

"""The paths for large or skewed input give the same rows as the plain ones."""

import pytest
from pyspark.sql import functions as F

from palimp.operators import dedup, lang, ordered, pages, redact, terms
from palimp.plans import page_queries as pq


def collected(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
                                    (F.col("id") * 7 % 5).alias("v"))
    return rows


def test_prefix_sum_in_chunks(skewed):
    plain = ordered.prefix_sum(skewed, ["k"], "doc_id", "v", "before")
    chunked = ordered.prefix_sum(skewed, ["k"], "doc_id", "v", "before", rows_per_chunk=100)
    assert collected(plain) == collected(chunked)


def test_next_value_in_chunks(skewed):
    plain = ordered.next_value(skewed, ["k"], "doc_id", "doc_id", "b")
    chunked = ordered.next_value(skewed, ["k"], "doc_id", "doc_id", "b", rows_per_chunk=100)
    assert collected(plain) == collected(chunked)


def test_first_following_in_chunks(skewed):
    sparse = skewed.withColumn("p", F.when(F.col("v") == 3, F.col("doc_id")))
    plain = ordered.first_following(sparse, ["k"], "doc_id", ["p"], "_next")
    chunked = ordered.first_following(sparse, ["k"], "doc_id", ["p"], "_next", rows_per_chunk=100)
    assert collected(plain) == collected(chunked)
    held = skewed.collect()
    expected = sorted((r.doc_id, min((x.doc_id for x in held if x.k == r.k and x.doc_id > r.doc_id and x.v == 3), default=-1)) for r in held)
    assert sorted((r.doc_id, -1 if r.p_next is None else r.p_next) for r in chunked.collect()) == expected


def test_chunks_are_bounded(skewed):
    cut, many = ordered.with_chunks(skewed, "doc_id", 100)
    assert many
    assert max(r["count"] for r in cut.groupBy(ordered.CHUNK).count().collect()) < 300


def test_plans_in_chunks(spark, sf_dir):
    for query in (pq.disambiguate_names, pq.merge_renumber, pq.page_offsets, pq.toc_ranges, pq.compare_pages):
        assert collected(query(spark, sf_dir)) == collected(query(spark, sf_dir, rows_per_chunk=40))


def test_dedup_with_hot_content(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    plain = dedup.content_hash_dedup(docs, F.col("text"))
    split = dedup.content_hash_dedup(docs, F.col("text"), hot_rows=50)
    assert collected(plain) == collected(split)
    assert plain.where("kept").count() == 401


TERMS = ["the", "x", "ab", "token", "straße", "a@example.com", "bob.smith@example.com", "Top Secret", "long needle with spaces", "  ", "",
         "aaaaaaaaaaaaaaaa", "ünïcödé wörds"]
TEXTS = [
    "The TOKEN of bob.smith@example.com and a@example.com", "Top\nSecret", "Top-\nSecret Confi-\ndential tok-\nen", "STRASSE", "x", "",
    "a long  needle\twith\nspaces here", "a" * 40, "ÜNÏCÖDÉ WÖRDS in caps", "nothing to find, surely", "AB" * 200, "cab",
]


def brute(texts, wanted, surface):
    squeeze = lambda t: " ".join(t.split())
    found = set()
    for i, value in enumerate(texts):
        for term in wanted:
            if not term.strip():
                continue
            if surface == "page_text":
                views = (value, squeeze(value), squeeze(value.replace("-\n", "")))
                hit = any(t.casefold() in v.casefold() for v in views for t in (term, squeeze(term)))
            elif surface == "raw_content":
                hit = term.encode().lower() in value.encode().lower()
            else:
                hit = term.casefold() in value.casefold()
            if hit:
                found.add((i, surface, term))
    return found


@pytest.mark.parametrize("few,bound,hot", [(100, 1000, 1000), (0, 1000, 1000), (0, 1, 1000), (0, 1, 1)])
def test_term_hits_match_brute_force(spark, few, bound, hot):
    wanted = spark.createDataFrame([(t,) for t in TERMS], "term string")
    data = [(i, s, t) for s in ("page_text", "raw_content", "links") for i, t in enumerate(TEXTS)]
    rows = spark.createDataFrame(data, "doc_id bigint, surface string, value string")
    got = [(r.doc_id, r.surface, r.term) for r in terms.term_hits(rows, ["doc_id"], wanted, few=few, bound=bound, hot=hot).collect()]
    expected = set().union(*[brute(TEXTS, TERMS, s) for s in ("page_text", "raw_content", "links")])
    assert len(got) == len(set(got))
    assert set(got) == expected


@pytest.mark.parametrize("few,bound", [(0, 1000), (0, 1)])
def test_redaction_is_the_same_on_every_path(spark, sf_dir, few, bound):
    doc_pages = pq.doc_pages(spark, sf_dir)
    wanted = spark.createDataFrame([("the",), ("token",), ("other words",)], "term string")
    assert collected(redact.redact_terms(doc_pages, wanted)) == collected(redact.redact_terms(doc_pages, wanted, few=few, bound=bound))


def test_detection_with_the_profile_in_many_parts(spark, sf_dir):
    docs = pq.docs(spark, sf_dir).select("doc_id", "lang", "text")
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab"), (-4, "12 345"), (-5, "日本語 𝔘𝔫𝔦")], "doc_id bigint, text string"))
    profile = lang.train_profile(docs)
    plain = lang.detect_language(texts, ["doc_id"], profile)
    assert collected(plain) == collected(lang.detect_language(texts, ["doc_id"], profile, most_bytes=20_000))
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange hashpartitioning" not in plan
    got = {r.doc_id: r.lang for r in plain.collect()}
    assert [got[i] for i in (-1, -2, -3, -4)] == [None] * 4 and got[-5] is not None


def test_page_groups_round_trip(spark, sf_dir):
    """Splitting and merging gives the pages back."""
    doc_pages = pq.doc_pages(spark, sf_dir)
    groups = pages.page_groups(pq.sized(spark, sf_dir), "every_n", 2)
    assert collected(pages.assign_pages(groups, doc_pages).select("doc_id", "page_no", "text")) == collected(doc_pages)

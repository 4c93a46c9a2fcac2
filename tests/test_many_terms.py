"""The search for more terms than can be broadcast: what it writes, and that it gives the rows of the other plans."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from palimp.functions import grams, packs
from palimp.operators import terms
from palimp.session import shared_dir

BLANKS = " \t\n\x0b\f\r"


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def on_disk(spark):
    """Bytes of staged tables and shuffled rows."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = [p for top in (f"{shared_dir(spark)}/palimp", *local) for p in Path(top).rglob("*") if p.suffix == ".parquet" or p.match("shuffle_*.data")]
    return sum(p.stat().st_size for p in files if p.exists())


def test_many_terms_take_little_disk(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=10)) for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=30)) + "".join(rng.choices("abcdefghijklmnop", k=200)) for _ in range(300)]
    wanted = spark.createDataFrame([(w,) for w in words], "term string")
    rows = spark.createDataFrame([(i, "links", t) for i, t in enumerate(texts)], "doc_id bigint, surface string, value string")
    before = on_disk(spark)
    got = collected(terms.term_hits(rows, ["doc_id"], wanted, few=0, bound=100))
    took = on_disk(spark) - before
    assert len(got) >= sum(len(set(t[: 30 * 11].split())) for t in texts)
    # It took more than five times the characters of terms and texts while each term and each anchor of a text was a row.
    assert took < 2.5 * (sum(map(len, words)) + sum(map(len, texts)))


@pytest.mark.parametrize("gain", [1 << 30, 0])
def test_parts_blocks_and_hot_anchors_lose_nothing(spark, monkeypatch, gain):
    rng = random.Random(4)
    # Many long terms share their only anchors, or differ in case only.
    wanted = ["a" * k for k in range(12, 40)] + ["".join(rng.choices("abAB", k=rng.randint(1, 16))) for _ in range(200)] + ["ß", "ŉ b", " ", "x\ny", "x  y"]
    texts = ["a" * 45, "x\ny", "x  y", "STRASSE", ""] + ["".join(rng.choices("abAB \n", k=rng.randint(0, 400))) for _ in range(60)]
    rows = spark.createDataFrame([(i, s, t) for s in ("page_text", "raw_content", "links") for i, t in enumerate(texts)] + [(-1, "links", None)],
                                 "doc_id bigint, surface string, value string")
    table = spark.createDataFrame([(t,) for t in wanted * 2], "term string")
    plain = collected(terms.term_hits(rows, ["doc_id"], table, few=0))
    for name, value in {"PART_TERMS": 16, "BLOCK_BYTES": 500, "PACK_TERMS": 50, "BLOOM_GAIN": gain}.items():
        monkeypatch.setattr(terms, name, value)
    monkeypatch.setattr(grams, "AT_ONCE", 64)
    assert collected(terms.term_hits(rows, ["doc_id"], table, few=0, bound=1, hot=2)) == plain and len(plain) > 1000


def test_repeated_and_missing_keys(spark):
    """Rows with the same keys stand for each other, and a row without a key has no hits."""
    long = "a needle of many characters"
    rows = spark.createDataFrame([(1, "links", f"ab {long}"), (1, "links", "ab"), (1, "other", "ab"), (None, "links", "ab"), (2, None, "ab"), (3, "links", "xab")],
                                 "doc_id bigint, surface string, value string")
    wanted = spark.createDataFrame([(t,) for t in ("ab", long, "zz")], "term string")
    got = collected(terms.term_hits(rows, ["doc_id"], wanted, few=0, bound=1))
    assert got == sorted([(1, "links", "ab")] * 4 + [(1, "links", long), (1, "other", "ab"), (3, "links", "ab")])


def test_no_terms_or_no_texts(spark):
    rows = spark.createDataFrame([(1, "links", "ab")], "doc_id bigint, surface string, value string")
    wanted = spark.createDataFrame([("ab",), ("b",), ("c",)], "term string")
    assert terms.term_hits(rows.where("doc_id > 1"), ["doc_id"], wanted, few=0, bound=1).collect() == []
    assert terms.term_hits(rows, ["doc_id"], wanted.where("term = 'none'"), few=0, bound=-1).collect() == []


def cut(text, size, step):
    """The pieces of a text that have no blank at an end, as Java's patterns see it, no two in a row and no sharp s."""
    for p in (text[i : i + size] for i in range(0, len(text) - size + 1, step)):
        ends = p[0] in BLANKS or p[-1] in BLANKS or (p[-1] in "\x85  " and p[-2] in BLANKS)
        if not (ends or "ß" in p or any(a in BLANKS and b in BLANKS for a, b in zip(p, p[1:]))):
            yield p


def test_distinct_pieces_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(terms, "PACK_TERMS", 40)
    monkeypatch.setattr(terms, "PART_TERMS", 30)
    rng = random.Random(5)
    texts = [None, "", "short", "just  ten."] + ["".join(rng.choices("ab cß\t\x0béç日𝔘\x85  \x1c\xa0", k=rng.randint(0, 90))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for size, step in ((10, 4), (4, 1)):
        found = [r.term for r in terms.distinct_pieces(df, size, step).collect()]
        assert len(found) == len(set(found)) and set(found) == {p for t in texts for p in cut(t or "", size, step)}


def test_pieces_are_those_of_the_pattern(spark):
    """Against Java's patterns, in which the phrases were cut and chosen before."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab cß\t\x0b\r\né日𝔘\x85  \x1c\xa0", k=rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = df.selectExpr(r"explode(regexp_extract_all(text, '(?s)(?=(.{10})).{4}', 1)) as term").where(r"not term rlike '^\\s|\\s$|\\s\\s|ß'").distinct()
    assert collected(terms.distinct_pieces(df, 10, 4)) == collected(old)


def test_packs_come_back():
    table = pa.table({"term": ["a", "ab", "é"], "needle": pa.array([None, "x", None], pa.string()), "anchor": pa.array([None, 5, -7], pa.int64())})
    assert packs.unpack(pa.chunked_array([[packs.pack(table)]])) == [table]
    for values in ([], [0], [5, 5, 1 << 20, (1 << 32) - 1]):
        assert packs.unpack_numbers(packs.pack_numbers(np.array(values, np.uint32))).tolist() == values

"""Steps whose work must not grow faster than their input."""

import time

from pyspark.sql import functions as F

from palimp.functions import grams
from palimp.operators import lang, terms


def test_short_needles_are_their_own_anchor(spark):
    """A text that holds all six-character pieces of a needle, but not the needle, is no candidate."""
    needles = spark.createDataFrame([("page_text", "abcdefg", "abcdefg"), ("page_text", "xyz", "xyz")], "kind string, term string, needle string")
    owned = terms._owned_anchors(needles)
    assert owned.count() == 2
    texts = spark.createDataFrame([("no abcdef and no bcdefg, xy yz",), ("it is abcdefgh",), ("xyz",), ("",)], "hay string")
    emitted = texts.select("hay", grams.text_anchors(F.col("hay"), terms._classes(owned), terms.anchor_filter(owned)).alias("a"))
    assert {r.hay: len(r.a) for r in emitted.collect()} == {"no abcdef and no bcdefg, xy yz": 0, "it is abcdefgh": 1, "xyz": 1, "": 0}


def test_a_text_is_split_once_and_not_once_per_literal(spark):
    text = " ".join(f"no {i}" for i in range(6000))
    begun = time.time()
    rows = spark.createDataFrame([(text,), ("none",), ("",), (None,)], "t string").select("t", lang.literal_spans(F.col("t")).alias("spans")).collect()
    assert time.time() - begun < 20
    found = {r.t: r.spans for r in rows}
    assert [text[s.s : s.e] for s in found[text]] == [str(i) for i in range(6000)]
    assert found["none"] == [] and found[""] == [] and not found[None]

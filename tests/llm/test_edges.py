"""Clashing column names, and quotations of any length."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimp.llm import content_dedup, maxscore, minhash_tensor, mixing, quote_linking, toxicity

TAKEN = ["toxic", "__id", "__text", "__score", "__at", "__norm", "__sha", "__starts", "__part", "__head", "__h", "__class", "__parts", "__cdf", "__n"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"word{i % 4} and some more words {i % 4} here", "src1", *[f"{c}{i}" for c in TAKEN]) for i in range(12)]
    rows += [(None, None, None, *TAKEN), (3, "word3 and some more words 3 here", "src1", *TAKEN)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in TAKEN))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")


def test_clashing_names_stay(clashing, labels):
    held = {(r.doc_id, *[r[c] for c in TAKEN]) for r in clashing.collect()}
    operators = [lambda d: toxicity.drop_toxic(d, labels), content_dedup.drop_exact_duplicates, minhash_tensor.drop_near_duplicates,
                 lambda d: mixing.mix(d, {"src1": 1.0, mixing.OTHER: 1.0}).drop("copy", "order_key")]
    for operator in operators:
        out = operator(clashing)
        assert out.columns == clashing.columns
        assert {(r.doc_id, *[r[c] for c in TAKEN]) for r in out.collect()} <= held
        assert operator(clashing.limit(0)).count() == 0
    assert content_dedup.drop_exact_duplicates(clashing).count() == 5
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encoding"]


def test_quotations_of_any_length(spark):
    said = "\n".join(f"This is line {i}." for i in range(20_000))
    rows = [(1, 0, "user", said), (1, 1, "assistant", "\n".join("> " + x for x in said.split("\n")) + "\nYes."), (1, 2, "user", ">" * 50_000 + " deep"),
            (1, 3, "user", "> Yes.\n>> This is line 7.\n> Yes.\nNo."), (2, 0, None, None), (2, None, "user", "> nothing said")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, level int, digest string")
    got = {(r.conv_id, r.turn): r for r in quote_linking.thread_messages(df).collect()}
    assert got[1, 1].parent_turn == 0 and got[1, 1].content == "Yes." and got[1, 1].n_quoted == 1
    assert got[1, 2].parent_turn is None and got[1, 2].n_quoted == 1
    assert got[1, 3].parent_turn == 1 and got[1, 3].content == "No." and got[1, 3].n_quoted == 2 and got[1, 3].n_linked == 2
    assert got[2, 0].content == "" and got[2, None].n_linked == 0
    assert quote_linking.thread_messages(df.limit(0)).count() == 0
    levels = {(r.level, r.bare) for r in quote_linking.quoted_passages(df.where("turn = 3").select("conv_id", "turn", F.col("text"))).collect()}
    assert levels == {(1, "Yes."), (2, "This is line 7.")}


@pytest.mark.parametrize("shard_rows,block_rows,group", [(4096, 256, 16), (5, 2, 1)])
def test_top_k_of_repeated_ids(spark, monkeypatch, shard_rows, block_rows, group):
    """Of rows that repeat an id the best score of the two ids counts, on either side."""
    for name, value in (("SHARD_ROWS", shard_rows), ("BLOCK_ROWS", block_rows), ("GROUP_BLOCKS", group)):
        monkeypatch.setattr(maxscore, name, value)
    rows = [(i % 17, [float((i * 7 + j * j) % 11 - 5) / 4 for j in range(6)], 0) for i in range(60)] + [(3, None, 0), (4, [None] * 6, 0), (None, [1.0] * 6, 0)]
    v = maxscore.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in maxscore.top_k(v, v.where("vec_id % 5 = 0"), k=4).collect()}
    held = [(i, [int(256 * x // 1) for x in e]) for i, e, _ in rows[:60]]
    for q in (0, 5, 10, 15):
        best = {}
        for i, a in held:
            for j, b in held:
                if i == q and j != q:
                    best[j] = max(best.get(j, -10**18), sum(x * y for x, y in zip(a, b)))
        assert [got[q, r] for r in range(1, 5)] == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert len(got) == 16


def test_components_out_of_range_are_refused(spark):
    far = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        maxscore.integer_vectors(far).collect()

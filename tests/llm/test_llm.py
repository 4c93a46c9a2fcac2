"""Each operator against brute force on small tables with nulls, empty and repeated rows, ties and extra columns."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palimp.llm import (
    components, content_dedup, line_dedup, maxscore, minhash_tensor, mixing, piece_lattice, ppm, quote_linking, shingles, token_counts, toxicity,
)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, kept boolean, score double, copy int"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
ROWS = [
    (1, "a b  c", "s1", True, 0.1, 1), (2, "a\tb c", None, None, None, None), (3, None, "s1", False, 0.0, 2), (4, "", "s2", True, 1.0, 3),
    (5, LONG, "s1", True, 0.2, 4), (6, LONG + " end", "s1", True, 0.2, 5), (7, "A b c", "s3", True, 0.3, 6), (7, "A b c", "s3", True, 0.3, 6),
    (None, "a b c", "s1", True, 0.1, 7), (9, "x", "s1", True, 0.1, 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_duplicates(docs, empty):
    got = content_dedup.exact_duplicates(docs).collect()
    groups = {}
    for row in ROWS:
        groups.setdefault(_squeeze(row[1]), []).append(row[0])
    want = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        want += [(i, keep, len(ids), i == keep) for i in ids]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got)
    assert content_dedup.exact_duplicates(empty).count() == 0
    left = content_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 6, 7, 9]


def test_mixing_draws_whole_counts(docs, empty):
    weights = {"s1": 3.0, "s2": 1.0, mixing.OTHER: 1.0}
    got = mixing.mix(docs, weights, epochs=200.0)
    assert set(got.columns) == set(docs.columns) | {"order_key"}
    counts = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    assert abs(counts["s1"] / total - 0.6) < 0.05 and 0.85 < total / 2000 < 1.15
    assert mixing.mix(empty, weights).count() == 0
    assert mixing.mix(docs, {"s1": 1.0}).where("source is null or source <> 's1'").count() == 0


def test_token_counts_use_the_cache(spark, docs, empty, tmp_path):
    cache = str(tmp_path / "cache")
    count = token_counts.load_counter(MODEL)
    for _ in range(2):
        got = token_counts.token_counts(docs, MODEL, cache)
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got.collect()) == sorted(
            (r[0] or 0, len((r[1] or "").encode()), count(r[1] or "")) for r in ROWS
        )
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in ROWS})
    assert token_counts.token_counts(empty, MODEL, cache).count() == 0


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=9)]) for i in range(300)] + [(300, None), (301, [None] * 9), (302, [float("nan")] * 9)]
    rows += [(400 + i, rows[0][1]) for i in range(8)]  # ties
    vectors = maxscore.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    exact = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows if v and None not in v and v[0] == v[0]}
    got = maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"))
    want = []
    for q in (i for i in exact if i % 50 == 0):
        order = sorted((-int(exact[q] @ v), i) for i, v in exact.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert maxscore.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_quotes_link_replies(spark):
    rows = [
        (1, 0, "user", "How are you?\nFine weather."), (1, 1, "a", "> How are   you?\nGood."), (1, 2, "b", "Other topic"),
        (1, 3, "c", "> > how are you?\n> Good.\nGlad"), (1, 4, None, None), (1, 5, "d", "> nobody said this\nok"), (2, 0, "x", "> Good.\n"), (1, 2, "b", "Other topic"),
    ]
    got = quote_linking.thread_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    seen = {(r.conv_id, r.turn): (r.content, r.parent_turn, r.thread, r.n_quoted, r.n_linked) for r in got.collect()}
    assert got.count() == len(rows)
    assert seen[1, 1] == ("Good.", 0, [0, 1], 1, 1)
    assert seen[1, 3] == ("Glad", 1, [0, 1, 3], 2, 2)
    assert seen[1, 5] == ("ok", None, [5], 1, 0)
    assert seen[2, 0][1] is None and seen[1, 4][0] == ""


def test_trimmed_quotes_link_replies(spark):
    rows = [
        (1, 0, "u", "Line one\nLine two\nLine three. It has more.\n\nSecond part.\n\nThird part."), (1, 1, "a", "Line two\nSecond part."),
        (1, 2, "b", "> line two\n> line  three. It has more.\nYes"), (1, 3, "c", "> Second part.\n>\n> Third part.\nNo"), (1, 4, "d", "> It has more.\nMore?"),
        (1, 5, "e", "> Line three. It\n> has more.\nWrapped"), (1, 6, "f", "> Line two\n> Line four\nUnknown"), (1, 7, "g", "> Line two\n> Yes\nOf two"),
        (2, 0, "h", "> line two\n> line three. It has more.\nElsewhere"), (None, 0, "i", "One. Two. Three."), (None, 1, "j", "> Two. Three.\nOk"),
        (3, 0, "k", "> A. B.\nAsks"), (3, 1, "l", "A. B. C."), (3, None, "m", "A. B."),
    ]
    got = quote_linking.thread_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    seen = {r.role: (r.parent_turn, r.n_quoted, r.n_linked) for r in got}
    assert len(got) == len(rows)
    assert {r: seen[r] for r in "bcde"} == {r: (0, 1, 1) for r in "bcde"} and seen["j"] == (0, 1, 1)
    assert {r: seen[r] for r in "fghk"} == {r: (None, 1, 0) for r in "fghk"}


def test_repeated_passages_are_cut(spark, docs, empty):
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    rows = [(1, f"Own start one.\n{passage}\nOwn end one."), (2, f"Own start two. {passage} Own end two."), (3, "Own end one."), (4, None), (None, passage)]
    got = {r.doc_id: r for r in line_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1].removed and got[1].text == rows[0][1] and not got[3].removed and got[4].text == ""
    (span,) = got[2].removed
    assert rows[1][1][span.start : span.end].strip() == passage and passage not in got[2].text and span.words == 60
    assert got[None].text == ""
    assert line_dedup.cut_repeats(docs).count() == len(ROWS) and line_dedup.cut_repeats(empty).count() == 0


def test_passages_inside_sentences_are_cut(spark):
    whole = " ".join(f"q{i}" for i in range(50))  # no sentence ends in it
    parts = "tail of one. " + " ".join(f"r{i}" + "." * (i % 12 == 11) for i in range(36)) + " head of next"
    rows = [
        (1, f"First host says {whole} and goes on. Then {parts} comes."), (2, f"Another text has\n{whole.upper()} in its line."),
        (3, f"Third begins with {parts} but ends so."), (4, f"Twice here {whole}x y {whole}x z."), (5, " ".join(whole.split()[:39]) + " short."),
    ]
    got = {r.doc_id: r for r in line_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: [text[s.start : s.end] for s in got[i].removed] for i, text in rows}
    assert texts[1] == [] and texts[5] == []
    assert texts[2] == [whole.upper()] and got[2].text.split() == "Another text has in its line.".split()
    assert texts[3] == [parts] and got[3].text.split() == "Third begins with but ends so.".split()
    assert texts[4] == [" ".join(whole.split()[:49]), whole + "x"]
    assert line_dedup.repeated_runs("a " * 100, set(), [], 40) == [(80, 200)]  # the first occurrence stays whole


def test_near_duplicates_against_all_pairs(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(minhash_tensor, "SLICE", 8)  # groups larger than a slice
    rng = np.random.default_rng(3)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(40):
            words = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 12)):
                words[at] = f"new{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, ""), (901, None), (902, "one two"), (903, "ONE\ttwo"), (None, "one two")]
    got = {r.doc_id: r for r in minhash_tensor.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (t or "").lower().split()) else set() for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(root)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert {i: got[i].component_id for i in sets} == root
    assert {i: got[i].n_shingles for i in sets} == {i: len(s) for i, s in sets.items()}
    assert got[None].component_id == 902 and not got[None].kept
    assert minhash_tensor.near_duplicates(docs).count() == len(ROWS) and minhash_tensor.near_duplicates(empty).count() == 0


def test_word_hashes_follow_words():
    text = b"The  quick\tBrown " * 200_000
    w = shingles.word_hashes(text)
    assert len(w) == 600_000 and len(np.unique(w)) == 3
    assert (shingles.word_hashes(b"the QUICK brown") == w[:3]).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_ppm_sums_to_the_model(spark, docs, empty):
    got = {(r.doc_id, r.n_tokens): r for r in ppm.scores(docs).collect()}
    train = [(r[0], ppm.words_of(r[1] or "")) for r in ROWS if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 != 2]
    n = sum(len(w) + 1 for _, w in train)
    assert {r.train_tokens for r in got.values()} == {n}
    assert all(r.score < 0 and r.base_score <= 0 for r in got.values())
    assert ppm.scores(docs).count() == len(ROWS) and ppm.scores(empty).count() == 0


def test_ids_are_the_librarys(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    extra = ["  two  blanks ", "a" * 300 + " " * 40 + "b.com 1.5,x\tq ﬁ① 漢字優", " " * 90, "x" * 70 + "\n" + "y" * 80, "e.g. don't! (why?) <s> </s>"]
    rows = [(i, t) for i, t in enumerate([*extra, *[r[1] for r in ROWS]])]
    got = {r.doc_id: r for r in piece_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()}
    assert all(list(got[i].ids) == model.encode(t or "") and got[i].round_trip for i, t in rows)
    assert piece_lattice.encode(empty, MODEL).count() == 0


def test_toxicity_on_held_out_rows(spark, empty):
    rng = np.random.default_rng(1)
    calm, vile = [f"{a}{b}" for a in ("lo", "mi", "ran", "ter") for b in ("ta", "re", "son", "de")], ["grubbish", "grubbed", "grubster"]
    rows = []
    for i in range(400):
        words = [str(x) for x in rng.choice(calm, 60)]
        if i % 4 == 0:
            words[int(rng.integers(60))] = vile[i // 4 % 3]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows.append((900, None, None))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    got = toxicity.toxicity_scores(data.drop("toxic"), data.where(~held).select("doc_id", "toxic")).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and all(0 <= r["__score"] <= 1 for r in got)
    right = [(r["__score"] >= 0.5) == bool(truth[r.doc_id]) for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean(right) > 0.95
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["__score"] for r in toxicity.toxicity_scores(data.drop("toxic"), labels).collect()} == {0.0}
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_pipeline_runs_every_stage(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns, name
        docs = after
    assert 0 < docs.count()

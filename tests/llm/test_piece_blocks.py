"""What a task does for a block of texts: ids are picked for distinct words and runs, and the model is not loaded for them."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from palimp.llm import piece_lattice
from palimp.llm.piece_lattice import Vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def cuts_by_library(model, words):
    """Boundaries of words that begin with a blank, as the library has them."""
    rows = []
    for place, word in enumerate(words):
        bits, at = 0, 0
        for piece in model.encode(word[1:], out_type=str)[:-1]:
            at += len(piece)
            bits |= 1 << at
        rows.append((place, bits - (1 << 64) if bits >= 1 << 63 else bits))
    return pa.table({"place": pa.array([r[0] for r in rows], pa.int32()), "bits": pa.array([r[1] for r in rows], pa.int64())})


def test_runs_of_a_block_without_the_model(monkeypatch):
    monkeypatch.setattr(piece_lattice, "WORDS_AT_ONCE", 3)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = Vocabulary.of(Vocabulary(MODEL).state())
    runs = ["block", "a", "wonderfully", "x" * 63, "0", "unlikeliest", "blockade"]
    found = piece_lattice.lattice_words(map(own.words, runs))
    ids, starts = piece_lattice.ids_by_run(own, runs, cuts_by_library(model, found).take(pa.array(range(len(found) - 1, -1, -1))))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [model.encode(r) for r in runs]
    assert own.round_trips(pa.array(runs), ids, starts).all()
    assert "model" not in vars(own)


def test_runs_that_do_not_come_back_are_told_apart():
    own = Vocabulary(MODEL)
    good, bad = own.model.encode("block"), own.model.encode("blocks")
    ids, starts = np.array([*good, *bad, *good], np.int32), np.cumsum([0, len(good), len(bad), len(good)])
    assert own.round_trips(pa.array(["block", "black", "block"]), ids, starts).tolist() == [True, False, True]


def test_characters_without_a_piece_become_bytes():
    own = Vocabulary(MODEL)
    ids, sizes = own.ids_of_pieces(["a", "\U0001d518", "b", "\x00"])
    assert sizes.tolist() == [1, 4, 1, 1] and own.decode(ids.tolist()) == "a\U0001d518b\x00"


def test_texts_with_the_mark_for_a_blank_do_not_come_back(spark):
    rows = [(1, "a▁b"), (2, "▁"), (3, " a"), (4, "a \n "), (5, "a b"), (6, "▁ x"), (7, None), (None, "a  b")]
    got = piece_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r.doc_id: (list(r.ids), r.round_trip) for r in got} == {i: (model.encode(t or ""), "▁" not in (t or "")) for i, t in rows}


def test_all_runs_of_a_block_are_cut_at_once():
    own, rng = Vocabulary.of(Vocabulary(MODEL).state()), random.Random(4)
    runs = ["", ".", "a.b,c", "é.ü", "²!½(Ⅷ)", "x\n\ny\t", "  a", "\x00.\x00"] + ["".join(rng.choices("ab.,!'\n\té中²\U0001d518\x00_9 ", k=rng.randint(0, 40))) for _ in range(500)]
    inside = {c for p in own.ids if len(p) > 1 for c in p}
    after = {b for p in own.ids for a, b in zip(p, p[1:]) if a.isalpha()}
    closing = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
    alone = "".join(c for c in "\n\t\r" if c not in inside)
    cut = re.compile(rf"(?<=[^\W\d_])(?=[{closing}])|(?<=[{alone}])|(?=[{alone}])")
    words, places = own.cut(pa.array(runs).slice(1))
    wanted = [[w for w in cut.split("▁" + run.replace(" ", "▁")) if w] for run in runs[1:]]
    assert [words.to_pylist()[a:b] for a, b in zip(places, places[1:])] == wanted
    some = sorted({w for run in wanted for w in run if 1 < len(w) <= 64 and "▁" * 17 not in w})
    assert words.unique().take(pa.array(piece_lattice.lattice_places(words.unique()))).to_pylist() == some
    assert own.cut(pa.array([], pa.string()))[0].to_pylist() == []

"""SentencePiece encoding as a relational lattice.

Texts are cut where no piece of the vocabulary can cross, which leaves few distinct words. For every distinct word all
substrings of bounded length are exploded and joined with the piece table; the edges of a word are grouped and folded
with a higher-order aggregate. The fold depends on the kind of model: for a BPE model, edges are applied by falling
score as merges (an edge joins two neighbouring pieces), which is what the library does; folding a BPE model's scores by
Viterbi gives other pieces. Decoding joins pieces and bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.llm.base import query, staged, table
from palimp.llm.blocks import packed, payloads, per_block
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Text bytes of a block: with its words and their ids it is held by one task, which bounds the memory of an executor.
BLOCK_BYTES = 8 << 20

SPACE = "▁"
#: Characters of the longest word that goes through the lattice, and of the longest run of blanks in it. Other words, which
#: are few in text, are encoded by the library: all their merges would be tied or would make long arrays.
LONGEST, LONGEST_RUN = 64, 16
#: Words whose ids a task picks at once.
WORDS_AT_ONCE = 1 << 15
#: Kinds of characters, which tell where texts can be cut: between a letter and a closing one, and on both sides of one that stands alone.
LETTER, CLOSING, ALONE = 1, 2, 4
#: All boundaries inside a word of 2 to 64 characters.
ALL_BITS = "shiftleft(shiftrightunsigned(-1L, 65 - length(word)), 1)"


class Vocabulary:
    """Pieces of a model file, and where texts can be cut."""

    def __init__(self, path: str):
        self.path = path
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [i for i, p in enumerate(self.pieces) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [p.encode() for p in self.pieces]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        self.known, self.known_ids = pa.array(self.ids, pa.string()), np.fromiter(self.ids.values(), np.int32, len(self.ids))
        self.raw_bytes, self.raw_starts = np.frombuffer(b"".join(self.raw), np.uint8), end_to_end(np.fromiter(map(len, self.raw), np.int64))
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        closing = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after_letter]
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        self.kinds = np.zeros(0x110000, np.uint8)
        self.kinds[code_points("".join(re.findall(r"[^\W\d_]", every)))] = LETTER
        self.kinds[code_points("".join(closing))] = CLOSING
        self.kinds[[ord(c) for c in "\n\t\r" if c not in inside]] = ALONE
        self.run = re.compile(" +[^ ]*")

    @cached_property
    def model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def state(self) -> dict:
        """What a task needs; the model is loaded there by the first word that asks for it."""
        return {name: value for name, value in vars(self).items() if name != "model"}

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        own = cls.__new__(cls)
        vars(own).update(state)
        return own

    def runs(self, text: str) -> list[str]:
        """What stands between blanks. Where several blanks follow each other, all but the first go to the run after them."""
        if not text:
            return []
        found = text.replace(SPACE, " ").split(" ")
        return [run[1:] for run in self.run.findall(" " + " ".join(found))] if "" in found else found

    def cut(self, runs: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all runs end to end, and where those of each run begin and the last end. A run is taken with the blank
        before it and cut where no piece crosses."""
        data, ends = flat_bytes(marked(runs))
        kinds, places = self.kinds[code_points(data.tobytes().decode())], char_places(data)
        first = np.ones(len(kinds), bool)
        first[1:] = (kinds[:-1] & LETTER).astype(bool) & (kinds[1:] & CLOSING).astype(bool) | ((kinds[:-1] | kinds[1:]) & ALONE).astype(bool)
        first[np.searchsorted(places, ends[:-1])] = True
        starts = places[:-1][first]
        return strings(data, starts), np.searchsorted(starts, ends)

    def words(self, run: str) -> list[str]:
        """The words of one run."""
        return self.cut(pa.array([run], pa.string()))[0].to_pylist()

    def ids_of_pieces(self, pieces: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has; a character without a piece becomes its bytes."""
        pieces = pa.array(pieces, pa.string())
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy()
        ids = np.where(at < 0, -1, self.known_ids[at]).astype(np.int32)
        sizes = np.ones(len(pieces), np.int64)
        missing = np.flatnonzero(ids < 0)
        as_bytes, ends = flat_bytes(pieces.take(pa.array(missing)))
        sizes[missing] = np.diff(ends)
        ids = np.repeat(ids, sizes)
        ids[ids < 0] = np.array(self.bytes, np.int32)[as_bytes]
        return ids, sizes

    def ids_of_long(self, word: str) -> list[int]:
        if word.startswith(SPACE):
            return self.model.encode(word[1:].replace(SPACE, " "))
        return self.model.encode("\n" + word)[2:]  # a line end is a piece of its own

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def round_trips(self, runs: pa.Array, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each run whether its ids decode to it. All are decoded at once; only if that differs, one by one."""
        wanted, ends = flat_bytes(marked(runs))
        ids_end = end_to_end(np.diff(self.raw_starts)[ids])
        if np.array_equal(ids_end[starts], ends) and np.array_equal(picked(self.raw_bytes, self.raw_starts, ids), wanted):
            return np.ones(len(runs), bool)
        return np.array([self.decode(ids[a:b].tolist()) == run for run, a, b in zip(runs.to_pylist(), starts, starts[1:])], bool)


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """piece, score of the pieces longer than a character; as many rows as the vocabulary."""
    rows = [(p, vocabulary.model.get_score(i)) for p, i in vocabulary.ids.items() if len(p) > 1]
    return spark.createDataFrame(rows, "piece string, score double")


def segment(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """word, bits: which boundaries inside a distinct word are left, bit i for the one before character i; words of at most
    64 characters. Words that contain no piece of several characters are not returned: all their boundaries are left."""
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("start")).where(F.col("start") < n - 1)
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), n - F.col("start")))).alias("size"))
    edges = spans.join(F.broadcast(pieces), F.substring("word", F.col("start") + 1, F.col("size")) == F.col("piece"))  # a vocabulary
    ends = F.expr("if(start > 0, shiftleft(1L, start), 0L) | if(start + size < length(word), shiftleft(1L, start + size), 0L)")
    inner = F.expr("shiftleft(shiftrightunsigned(-1L, 65 - size), start + 1)")
    edge = F.struct((-F.col("score")).alias("rank"), "start", "size", ends.alias("ends"), inner.alias("inner"))
    lattice = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    tied = F.filter("edges", lambda e: e["rank"] >= 1e9)  # runs of blanks, all of one score: they may need to be seen again
    again = F.when(F.element_at("edges", -1)["rank"] >= 1e9, F.concat("edges", tied, tied)).otherwise(F.col("edges"))
    merged = F.aggregate(
        again, F.expr(ALL_BITS),
        lambda bits, e: F.when(
            (bits.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(bits.bitwiseAND(e["inner"])) == 1),
            bits.bitwiseAND(F.bitwise_not(e["inner"])),
        ).otherwise(bits),
    )
    return lattice.select("word", merged.alias("bits"))


def lattice_places(words: pa.Array) -> np.ndarray:
    """Which of the distinct words of a block go through the lattice, in the order of the words; both passes over a block see the
    same words in the same order."""
    size = pc.utf8_length(words)
    fit = pc.and_(pc.and_(pc.greater(size, 1), pc.less_equal(size, LONGEST)), pc.invert(pc.match_substring(words, SPACE * (LONGEST_RUN + 1))))
    at = np.flatnonzero(fit.to_numpy(False))
    return at[pc.sort_indices(words.take(pa.array(at))).to_numpy()]


def lattice_words(split: Iterable[list[str]]) -> list[str]:
    """The distinct words that go through the lattice, sorted."""
    words = pa.array(dict.fromkeys(chain.from_iterable(split)), pa.string())
    return words.take(pa.array(lattice_places(words))).to_pylist()


def end_to_end(sizes: np.ndarray) -> np.ndarray:
    """Where things of these sizes begin that lie end to end, and where the last ends."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def char_places(data: np.ndarray) -> np.ndarray:
    """Where each character of UTF-8 begins, and where the last ends."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts end to end, and where each begins and the last ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The texts that begin at these bytes and run to the next."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def marked(runs: pa.Array) -> pa.Array:
    """Runs with the blank before them, and blanks as their mark."""
    return pc.binary_join_element_wise(SPACE, pc.replace_substring(runs, " ", SPACE), "")


def split_runs(vocabulary: Vocabulary, group: pa.Table) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """The documents of a block in batches, each with the runs of its texts."""
    for batch in payloads(group):
        plain = pc.replace_substring(batch["text"], SPACE, " ")
        # Blanks in a row, or at an end, go by the vocabulary's rule; other texts are split where a blank stands.
        odd = pc.or_(pc.match_substring(plain, "  "), pc.match_substring_regex(plain, r"^( |\z)| \z"))
        even = pc.invert(odd)
        yield batch.filter(even), pc.split_pattern(plain.filter(even), " ")
        yield batch.filter(odd), pa.array([vocabulary.runs(text) for text in batch["text"].filter(odd).to_pylist()], pa.list_(pa.string()))


def ids_of_words(vocabulary: Vocabulary, words: pa.Array, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words with the boundaries that are left in them, end to end, and how many each has."""
    # A row of 64 bits for each word; the first, which no boundary takes, marks its start.
    marks = np.flatnonzero(np.unpackbits((bits | 1).astype("<i8").view(np.uint8), bitorder="little"))
    of_word, at = np.divmod(marks, 64)
    data, ends = flat_bytes(words)
    places = char_places(data)
    ids, sizes = vocabulary.ids_of_pieces(strings(data, places[np.searchsorted(places, ends)[of_word] + at]))
    return ids, np.bincount(of_word, sizes, len(words)).astype(np.int64)


def ids_by_run(vocabulary: Vocabulary, runs: list[str] | pa.Array, cuts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all runs of a block end to end, and where those of each run begin and the last end."""
    words, per_run = vocabulary.cut(pa.array(runs, pa.string()))
    coded = words.dictionary_encode()
    found = lattice_places(coded.dictionary)
    bits = np.zeros(len(found), np.int64)
    bits[cuts["place"].to_numpy()] = cuts["bits"].to_numpy()
    some = [slice(at, at + WORDS_AT_ONCE) for at in range(0, len(found), WORDS_AT_ONCE)]
    known = [ids_of_words(vocabulary, coded.dictionary.take(pa.array(found[s])), bits[s]) for s in some]
    # The words that do not go through the lattice come after those that do.
    others = np.setdiff1d(np.arange(len(coded.dictionary)), found)
    more = [vocabulary.ids_of_pieces([w])[0] if len(w) == 1 else np.array(vocabulary.ids_of_long(w), np.int32) for w in coded.dictionary.take(pa.array(others)).to_pylist()]
    ids = np.concatenate([np.zeros(0, np.int32), *(held for held, _ in known), *more])
    starts = end_to_end(np.concatenate([*(sizes for _, sizes in known), np.array([len(m) for m in more], np.int64)]))
    number = np.argsort(np.concatenate([found, others]))
    codes = number[coded.indices.to_numpy()]
    return picked(ids, starts, codes), end_to_end(starts[codes + 1] - starts[codes])[per_run]


def picked(ids: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the coded runs, or the bytes of the coded pieces, one after the other."""
    first, sizes = starts[codes], starts[codes + 1] - starts[codes]
    ends = np.cumsum(sizes)
    return ids[np.repeat(first - (ends - sizes), sizes) + np.arange(sizes.sum())]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, round_trip: the piece ids of each text, and whether they decode to it; one row per input row.

    A null or empty text has no ids. Repeated rows and null ids are encoded like others; an empty table gives no rows.
    Other columns are ignored. ``model_path`` must be readable on every executor, as the tokenizer files are.
    """
    spark, vocabulary = docs.sparkSession, Vocabulary(model_path)
    if vocabulary.model.get_score(vocabulary.ids[max(vocabulary.ids, key=vocabulary.ids.get)]) > -1000:
        raise ValueError("only BPE models, whose scores are the order of merges, are folded here")

    shared = spark.sparkContext.broadcast(vocabulary.state())

    def block_words(group: pa.Table) -> pa.Table:
        own = Vocabulary.of(shared.value)
        runs = pa.concat_arrays([split.flatten() for _, split in split_runs(own, group)]).unique()
        words = own.cut(runs)[0].unique()
        found = words.take(pa.array(lattice_places(words)))
        return pa.table({
            "block": pa.array(np.full(len(found), group["block"][0].as_py(), np.int64)),
            "place": pa.array(np.arange(len(found), dtype=np.int32)), "word": found,
        })

    def block_ids(group: pa.Table, cuts: pa.Table) -> pa.Table:
        own, done = Vocabulary.of(shared.value), []
        batches, splits = zip(*split_runs(own, group))
        coded = pa.concat_arrays([split.flatten() for split in splits]).dictionary_encode()
        runs, codes = coded.dictionary, coded.indices.to_numpy()
        ids, starts = ids_by_run(own, runs, cuts)
        wrong, at = ~own.round_trips(runs, ids, starts), 0
        for batch, split in zip(batches, splits):
            ends = end_to_end(pc.list_value_length(split).to_numpy())
            mine, at = codes[at : at + ends[-1]], at + ends[-1]
            tokens = end_to_end(starts[mine + 1] - starts[mine])[ends]
            # The mark for a blank decodes to a blank, so a text that holds it does not come back.
            right = (np.diff(end_to_end(wrong[mine])[ends]) == 0) & ~pc.match_substring(batch["text"], SPACE).to_numpy(False)
            lists = pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(picked(ids, starts, mine), pa.int32()))
            done.append(pa.RecordBatch.from_arrays([batch["doc_id"], lists, pa.array(right, pa.bool_())], ["doc_id", "ids", "round_trip"]))
        return pa.Table.from_batches(done)

    blocks = packed(docs, key, text, BLOCK_BYTES)
    # A block's words are sorted, so that each is stored as what differs from the one before.
    stored = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
    words = staged(per_block(blocks, block_words, "block long, place int, word string"), "piece-words", **stored)
    cuts = segment(words.select("word").distinct(), piece_table(spark, vocabulary))
    # What goes back to a block is a place in its sorted words and a bit per boundary, not the words.
    answers = words.join(cuts, "word", "left").select(F.col("block").alias("to"), "place", F.coalesce("bits", F.expr(ALL_BITS)).alias("bits"))
    back = staged(answers, "piece-cuts", compression="zstd")
    return blocks.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(block_ids, "doc_id long, ids array<int>, round_trip boolean")


@query("op4_piece_lattice")
def op4(spark, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "round_trip", digest.alias("ids_sha256"))

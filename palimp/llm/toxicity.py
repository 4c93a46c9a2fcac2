"""Toxicity by two Kneser-Ney models of how words are spelled, one for toxic and one for ordinary text.

Both models interpolate over byte n-grams inside a word. The longest n-grams are counted by class; everything shorter is
one table of continuation counts that both classes back off to, so a spelling that neither class has seen often gets the
same probability from both and says nothing. The evidence of a word is the difference of its two log-likelihoods by
byte; a document is judged by its words' mean evidence and its strongest evidence, which a logistic curve turns into a
probability. The curve is fitted on halves of the sample scored by the model of the other half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.base import fold, query, set_apart, table, text_of
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Bytes of the longest n-gram, the discount, and how many labelled documents are learnt from at most (those with the
#: smallest hash of their id); the size of the model is bounded by these documents.
ORDER, DISCOUNT, MAX_LABELLED = 6, 0.75, 20_000


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, owner): for each byte of each word and its end, the n-gram that ends there, at most ORDER bytes and not
    further back than the blank before the word. A gram is its bytes as a number with its length above them."""
    joined = np.frombuffer(b"".join(b" " + w + b" " for w in words), dtype=np.uint8).astype(np.int64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(joined)) - starts[owner]
    grams = np.zeros(len(joined), dtype=np.int64)
    for back in range(ORDER):
        shifted = np.concatenate([np.zeros(back, dtype=np.int64), joined[: len(joined) - back]])
        grams += np.where(place >= back, shifted << (8 * back), 0)
    size = np.minimum(place + 1, ORDER)
    keep = place > 0
    return (grams | size << 48)[keep], owner[keep]


def _context(grams: np.ndarray) -> np.ndarray:
    """The gram without its last byte."""
    return ((grams & ((1 << 48) - 1)) >> 8) | ((grams >> 48) - 1) << 48


def _shorter(grams: np.ndarray) -> np.ndarray:
    """The gram without its first byte."""
    size = grams >> 48
    return (grams & ((np.int64(1) << (8 * (size - 1))) - 1)) | (size - 1) << 48


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


class SpellingModels:
    """The two models, from counts of each longest n-gram in toxic and in ordinary text."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], np.stack([toxic[order], ordinary[order]]).astype(float)
        self.contexts, inverse = np.unique(_context(self.grams), return_inverse=True)
        width = len(self.contexts)
        self.totals = np.stack([np.bincount(inverse, c, width) for c in self.counts])
        self.kinds = np.stack([np.bincount(inverse, c > 0, width) for c in self.counts])
        # Shared continuation counts, longest first: a gram counts the different bytes that stand before it.
        levels, longer = [], self.grams[self.grams >> 48 == ORDER]
        for size in range(ORDER - 1, 0, -1):
            found, n = np.unique(_shorter(longer), return_counts=True)
            levels.append((found, n.astype(float)))
            longer = np.concatenate([found, self.grams[self.grams >> 48 == size]])
        self.levels = []
        below = None
        for found, n in reversed(levels):  # shortest first
            contexts, inverse = np.unique(_context(found), return_inverse=True)
            totals, kinds = np.bincount(inverse, n), np.bincount(inverse)
            weight = DISCOUNT * kinds / totals
            rest = np.full(len(found), 1 / 256) if below is None else self._shared(_shorter(found), len(self.levels) - 1)
            self.levels.append((found, np.maximum(n - DISCOUNT, 0) / totals[inverse] + weight[inverse] * rest, contexts, weight))
            below = found
        # Every worker holds the models, so they are kept in half the bytes; sums are taken in full precision.
        half = np.float32
        self.counts, self.totals, self.kinds = self.counts.astype(half), self.totals.astype(half), self.kinds.astype(half)
        self.levels = [(found, p.astype(half), contexts, weight.astype(half)) for found, p, contexts, weight in self.levels]

    def _shared(self, grams: np.ndarray, level: int) -> np.ndarray:
        if level < 0:
            return np.full(len(grams), 1 / 256)
        found, p, contexts, weight = self.levels[level]
        at, known = _look(found, grams)
        out = np.where(known, p[at].astype(float) if len(p) else 0.0, 0.0)
        if not known.all():
            missing = ~known
            c, there = _look(contexts, _context(grams[missing]))
            back = np.where(there, weight[c].astype(float) if len(weight) else 1.0, 1.0)
            shorter = self._shared(_shorter(grams[missing]), level - 1) if level else np.full(missing.sum(), 1 / 256)
            out[missing] = back * shorter
        return out

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Of each word, log P(toxic model) - log P(ordinary model), by byte."""
        grams, owner = word_grams(words)
        shared = np.empty(len(grams))
        sizes = grams >> 48
        for size in np.unique(sizes).tolist():
            mine = sizes == size
            shared[mine] = self._shared(_shorter(grams[mine]), size - 2)
        at, known = _look(self.grams, grams)
        c, there = _look(self.contexts, _context(grams))
        difference = np.zeros(len(grams))
        for side, sign in ((0, 1), (1, -1)):
            n, total, kinds = (np.where(there_, x[side][i], 0).astype(float) for there_, x, i in ((known, self.counts, at), (there, self.totals, c), (there, self.kinds, c)))
            safe = np.maximum(total, 1)
            p = np.where(total > 0, np.maximum(n - DISCOUNT, 0) / safe + DISCOUNT * kinds / safe * shared, shared)
            difference += sign * np.log(p)
        return np.bincount(owner, difference, len(words)) / np.bincount(owner, minlength=len(words))


def features(text: str, evidence: dict[bytes, float], models: SpellingModels) -> list[float]:
    """Mean evidence of the words, the strongest, the next strongest different one, and the share of strong ones.
    ``evidence`` remembers words that were seen before."""
    words = text.encode("utf-8", "replace").lower().split()
    new = list({w for w in words if w not in evidence})
    for i in range(0, len(new), 4096):
        part = new[i : i + 4096]
        evidence.update(zip(part, models.evidence(part).tolist()))
    if not words:
        return [0.0, 0.0, 0.0, 0.0]
    each = [evidence[w] for w in words]
    top = sorted({(evidence[w], w) for w in set(words)}, reverse=True)[:2]
    return [sum(each) / len(each), top[0][0], top[-1][0], sum(x > 1 for x in each) / math.sqrt(len(each))]


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small penalty, by Newton's method; the last is the constant."""
    scale = x.std(axis=0) + 1e-9
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - w)
    w[:-1] /= scale
    return w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of labelled texts: counts by class and half."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keys, columns = [], []
            for text, toxic, half in zip(*(part.column(n).to_pylist() for n in ("text", "toxic", "half"))):
                words = text.encode("utf-8", "replace").lower().split()
                for i in range(0, len(words), 100_000):
                    grams, _ = word_grams(words[i : i + 100_000])
                    keys.append(grams)
                    columns.append(np.full(len(grams), 2 * half + toxic))
            if keys:
                found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                kind = np.concatenate(columns)
                counts = [np.bincount(inverse[kind == k], minlength=len(found)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(c.astype(np.int64)) for c in counts]], ["gram", "o0", "t0", "o1", "t1"])


def train(labelled: DataFrame) -> tuple[SpellingModels, np.ndarray] | None:
    """Models and curve from (doc_id, text, toxic), of at most MAX_LABELLED documents. None if a class is missing."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), half.alias("half"))
    grams = rows.mapInArrow(_count, "gram long, o0 long, t0 long, o1 long, t1 long").groupBy("gram").agg(
        *[F.sum(c).alias(c) for c in ("o0", "t0", "o1", "t1")]
    )
    model = grams.toArrow()  # bounded by the sample
    g, o0, t0, o1, t1 = (model[c].to_numpy() for c in ("gram", "o0", "t0", "o1", "t1"))
    if not (t0.sum() and t1.sum() and o0.sum() and o1.sum()):
        return None
    parts = [SpellingModels(g[o + t > 0], t[o + t > 0], o[o + t > 0]) for o, t in ((o0, t0), (o1, t1))]
    shared = labelled.sparkSession.sparkContext.broadcast(parts)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: list[dict] = [{}, {}]
        for batch in batches:
            for text, toxic, own in zip(*(batch.column(n).to_pylist() for n in ("text", "toxic", "half"))):
                x = features(text, memory[1 - own], shared.value[1 - own])
                yield pa.RecordBatch.from_pylist([{"x": x, "toxic": toxic}], pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int32())]))

    fitted = rows.mapInArrow(crossed, "x array<double>, toxic int").toArrow()
    x = np.array(fitted["x"].to_pylist())
    return SpellingModels(g, t0 + t1, o0 + o1), fit_curve(x, fitted["toxic"].to_numpy())


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, float] = {}
        for batch in batches:
            scores = []
            for text in batch.column("__text"):
                if len(memory) > 1_000_000:
                    memory.clear()  # only remembered, so memory stays bounded
                if shared is None:
                    scores.append(0.0)
                    continue
                models, curve = shared.value
                z = float(np.dot(curve[:-1], features(text.as_py(), memory, models)) + curve[-1])
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores, pa.float64())], [*names, "__score"])

    return score


@set_apart("toxic", "__text", "__id")
def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The documents' columns with ``__score``, the probability that a document is toxic: one row per input row.

    Learns from the labelled rows that are given, at most MAX_LABELLED documents; null labels and null ids are not learnt
    from, and a document with several labels counts by the largest. Null text is empty; empty texts get the score of no
    evidence. Labelled documents are halved by a hash of their ids; unless each half has both classes, every score is 0. An
    empty table gives no rows. A column ``__score`` is replaced; all others, clashing names included, stay as they are.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(label).alias("toxic"))
    sample = docs.select(F.col(key).alias("__id")).distinct().join(marked, "__id")
    chosen = sample.orderBy(F.xxhash64("__id"), "__id").limit(MAX_LABELLED)
    chosen = docs.sparkSession.createDataFrame(chosen.toArrow()) if chosen.head(1) else chosen  # at most MAX_LABELLED ids
    labelled = docs.join(F.broadcast(chosen), docs[key] == chosen["__id"]).select(
        F.col("__id").alias("doc_id"), text_of(docs, text).alias("text"), "toxic"
    )
    trained = train(labelled)
    shared = None if trained is None else docs.sparkSession.sparkContext.broadcast(trained)
    rows = docs.withColumn("__text", text_of(docs, text))
    schema = docs.withColumn("__score", F.lit(0.0)).schema
    return rows.mapInArrow(_score(shared), schema)


@set_apart("__score")
def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, with their columns as they were, clashing names included.

    Nulls, repeats and empty tables as in :func:`toxicity_scores`: rows that repeat an id are judged each by its own text.
    """
    scored = toxicity_scores(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return scored.where("__score < 0.5").drop("__score")


@query("op1_class_kneser_ney")
def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = toxicity_scores(docs, labels)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )

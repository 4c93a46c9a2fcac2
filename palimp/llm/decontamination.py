"""Benchmark decontamination by a hash set of test n-grams.

Every window of consecutive words of a benchmark item is reduced to a digest. The distinct windows are broadcast as a hash
set after a check of their number and bytes; each document's windows are looked up in it where the document lies, hits are
verified word by word, and the words inside a verified window are marked. Nothing of the documents is shuffled. A benchmark
beyond the bound is joined by digest instead, and each document is marked with the windows that it met there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.llm.base import query, staged, table
from palimp.llm.shingles import U, mixed, word_hashes
from palimp.llm.words import SQL_WORDS, normal
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Words of a window.
WINDOW = 10
#: Distinct windows, and bytes of their words, that are broadcast at most.
BROADCAST_WINDOWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Text bytes hashed in one go; a longer text is taken whole.
PIECE = 1 << 20
_STEP, _FILTER = U(0x9E3779B97F4A7C15), 1 << 18

WINDOWS = "size int, digest long, words binary, item string"
FOUND = ("n_words long, n_hit long, item_ids array<string>, items_sha256 string, "
         "spans array<struct<start_char: int, end_char: int>>")


def window_digests(w: np.ndarray, size: int) -> np.ndarray:
    """A digest for each run of ``size`` words, from the words' hashes."""
    if len(w) < size:
        return np.zeros(0, dtype=U)
    total = np.full(len(w) - size + 1, size, dtype=U)
    for i in range(size):
        total = total * _STEP + w[i : len(w) - size + 1 + i]
    return mixed(total)


def _item_windows(window: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = normal(text).split()
                size = min(window, len(words))
                digests = window_digests(word_hashes(b" ".join(words)), size).view(np.int64) if words else []
                found += [(size, int(d), b" ".join(words[i : i + size]), item) for i, d in enumerate(digests)]
            columns = list(zip(*found)) or [[], [], [], []]
            types = pa.int32(), pa.int64(), pa.binary(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["size", "digest", "words", "item"])

    return windows


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """size, digest, words, items: the distinct windows of all items and the sorted ids, as text, of those that hold them."""
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(_item_windows(window), WINDOWS)
    return found.groupBy("size", "digest", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class HashSet:
    """Windows by digest; finds and verifies them in normalised texts."""

    def __init__(self, windows: list[tuple[int, int, bytes, list[str]]]):
        self.known: dict[tuple[int, int], list[tuple[bytes, list[str]]]] = {}
        by_size: dict[int, list[int]] = {}
        for size, digest, words, items in windows:
            self.known.setdefault((size, digest), []).append((words, items))
            by_size.setdefault(size, []).append(digest)
        self.digests = {size: np.unique(np.array(d, dtype=np.int64).view(U)) for size, d in by_size.items()}
        self.maybe = {}
        for size, digests in self.digests.items():
            self.maybe[size] = np.zeros(_FILTER, dtype=bool)
            self.maybe[size][digests % U(_FILTER)] = True

    def search(self, texts: list[bytes]) -> list[tuple[int, bytearray | None, set[str]]]:
        """(number of words, a byte per word that is 1 where it is hit, ids of the items found) of each normalised text."""
        counts = np.array([len(t.split()) for t in texts], dtype=np.int64)
        ends = np.cumsum(counts)
        hashes = word_hashes(b" ".join(texts))
        split: dict[int, list[bytes]] = {}
        masks: dict[int, bytearray] = {}
        items: dict[int, set[str]] = {}
        for size, known in self.digests.items():
            digests = window_digests(hashes, size)
            at = np.flatnonzero(self.maybe[size][digests % U(_FILTER)])
            at = at[np.isin(digests[at], known)]
            docs = np.searchsorted(ends, at, side="right")
            places = at - (ends - counts)[docs]
            for doc, place, digest in zip(docs.tolist(), places.tolist(), digests[at].view(np.int64).tolist()):
                if place + size > counts[doc]:
                    continue  # the window goes on into the next text
                words = split.setdefault(doc, texts[doc].split() if doc not in split else [])
                here = b" ".join(words[place : place + size])
                for words_of_window, held_by in self.known[size, digest]:
                    if here == words_of_window:
                        masks.setdefault(doc, bytearray(len(words)))[place : place + size] = b"\1" * size
                        items.setdefault(doc, set()).update(held_by)
        return [(int(counts[i]), masks.get(i), items.get(i, set())) for i in range(len(texts))]


def hit_spans(text: bytes, mask: bytearray) -> list[dict[str, int]]:
    """Start and end, in characters, of each run of hit words in the original text."""
    runs, inside = [], False
    for word, hit in zip(re.finditer(rb"[^ ]+", normal(text)), mask):
        if hit and inside:
            runs[-1][1] = word.end()
        elif hit:
            runs.append([word.start(), word.end()])
        inside = bool(hit)
    spans, at, chars = [], 0, 0
    for start, end in runs:
        first = chars + len(text[at:start].decode("utf-8", "replace"))
        chars, at = first + len(text[start:end].decode("utf-8", "replace")), end
        spans.append({"start_char": first, "end_char": chars})
    return spans


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > PIECE:
            yield held
            held, size = [], 0
    yield held


def _marker(shared):
    """Rows with their text to rows with what was found; the windows are the broadcast ones, or else each row's own."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything = HashSet(shared.value) if shared else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if everything:
                found = [x for piece in _pieces([normal(t) for t in texts]) for x in everything.search(piece)]
            else:
                own = batch.column("windows").to_pylist()
                found = [HashSet([(w["size"], w["digest"], w["words"], w["items"]) for w in mine or []]).search([normal(t)])[0] for t, mine in zip(texts, own)]
            ids = [sorted(items) for _, _, items in found]
            columns = [
                batch.column("row"), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([mask.count(1) if mask else 0 for _, mask, _ in found], pa.int64()), pa.array(ids, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], pa.string()),
                pa.array([hit_spans(t, mask) if mask else [] for t, (_, mask, _) in zip(texts, found)],
                         pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_hit", "item_ids", "items_sha256", "spans"])

    return mark


def _own_digests(sizes: list[int]):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist()):
                hashes = word_hashes(normal(text))
                for size in sizes:
                    own = np.unique(window_digests(hashes, size)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), at)), pa.array(np.full(len(own), size, dtype=np.int32)), pa.array(own)], ["at", "size", "digest"])

    return digests


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW,
          keep: list[str] | None = None, most_windows: int = BROADCAST_WINDOWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """row, n_words, n_hit, item_ids, items_sha256, spans: one row per row of ``docs``, whose columns (or those of ``keep``) are in ``row``.

    A word is hit inside any occurrence of a window; ``spans`` are the runs of hit words in the text. Null and empty texts,
    and those without a word, have no words; items without words have no window. Repeated rows stay, each with the same
    finding; items that repeat an id count once, and a null id counts as the empty one. Columns of any name are kept, as they
    are inside ``row``. An empty benchmark hits nothing.
    """
    known = staged(item_windows(items, item_key, item_text, window), "windows")
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    rows = docs.select(row.alias("row"), F.col(text).cast("binary").alias("text"))
    result = f"row {rows.schema['row'].dataType.simpleString()}, {FOUND}"
    held = F.sum(F.octet_length("words") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i)))
    n, size = known.agg(F.count("*"), F.coalesce(held, F.lit(0))).first()
    if n <= most_windows and size <= most_bytes:
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast([(w["size"], w["digest"], bytes(w["words"]), w["items"]) for w in known.collect()])
        return rows.mapInArrow(_marker(shared), result)
    sizes = [r[0] for r in known.select("size").distinct().collect()]  # one to ``window``
    placed = staged(rows.withColumn("at", F.monotonically_increasing_id()), "placed")
    met = placed.select("at", "text").mapInArrow(_own_digests(sizes), "at long, size int, digest long").join(known, ["size", "digest"])
    mine = met.groupBy("at").agg(F.collect_list(F.struct("size", "digest", "words", "items")).alias("windows"))
    return placed.join(mine, "at", "left").select("row", "text", "windows").mapInArrow(_marker(None), result)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans, a space for each."""
    edges = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end_char"]))
    starts = F.concat(F.transform(spans, lambda s: s["start_char"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(edges, starts, lambda a, b: F.substring(text, a + 1, b - a)), " ")


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "spans", text: str = "text", **options) -> DataFrame:
    """The documents without what leaks: the hit spans cut out of their texts, or the documents that have one (``remove="documents"``).

    Columns are those of ``docs``. Rows without a hit are returned as they are, nulls and repeats included.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be spans or documents")
    found = leaks(docs, items, text, **options)
    if remove == "documents":
        return found.where("n_hit = 0").select("row.*")
    cut = F.when(F.col("n_hit") > 0, without_spans(F.col("row")[text], F.col("spans"))).otherwise(F.col("row")[text])
    return found.select(F.col("row").withField(f"`{text}`", cut).alias("row")).select("row.*")


ORACLE = f"""
with b as (select coalesce(item_id::varchar, '') as item_id, {SQL_WORDS.format("text")} as words from benchmark where text is not null),
s as (select item_id, words, least({WINDOW}, len(words)) as size from b where len(words) > 0),
p as (select item_id, words, size, unnest(range(1, len(words) - size + 2)) as i from s),
win as (select distinct item_id, size, array_to_string(words[i:i + size - 1], ' ') as words from p),
d as (select row_number() over () as rid, doc_id, coalesce({SQL_WORDS.format("text")}, []) as words from documents),
q as (select rid, words, size, unnest(range(1, len(words) - size + 2)) as i from d cross join (select distinct size from win) z where len(words) >= size),
hit as (select rid, i, size, item_id from (select rid, i, size, array_to_string(words[i:i + size - 1], ' ') as words from q) o join win using (size, words)),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + size)) as p from hit) x group by rid),
its as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from hit) x group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (rid) left join its using (rid)
"""


@query("op12_ngram_decontamination", ORACLE)
def op12(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n = F.size("item_ids").cast("long").alias("n_items")
    return found.select("row.doc_id", "n_words", "n_hit", n, "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))

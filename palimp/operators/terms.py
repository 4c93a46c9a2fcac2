"""Which terms occur in which texts: an exact substring join that never pairs all terms with all texts.

Three plans, chosen by the counted number and bytes of the terms:
* few terms: an array of literals filtered inside each row, no join and no Python;
* up to a broadcast bound: one automaton of the terms' first characters is run once over each text, where the text lies;
* beyond it: a short term is its own anchor, a long one owns that which is rarest among the terms. Texts are dealt into blocks;
  a block asks for its anchors once each (where texts are far more than terms, those that a Bloom filter of the owned ones lets pass).
  Terms and anchors meet in parts, hot anchors salted, as sorted packs of a few bytes for each instead of a row; the terms found go
  back to the blocks, where the texts are searched for them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions import grams
from palimp.functions import patterns as P
# What tasks use is named one by one: functions travel with the tasks, modules do not.
from palimp.functions.grams import LONG, LONG_NEEDLE, as_rows, joined, let_pass, pieces, whole_hashes, windows
from palimp.functions.matching import matcher_of, slices
from palimp.functions.packs import ROWS, ascending, by_part, in_batches, once, pack, pack_numbers, spans, stretches, unpack, unpack_numbers
from palimp.functions.text import ascii_fold, dehyphenate, escape_regex, fold, squeeze
from palimp.session import scratch_path, ship_by_value

ship_by_value(__name__)

FEW_TERMS = 256
#: Terms, and bytes of them, that are broadcast; a task holds them as sorted lists with an automaton of their first characters.
AUTOMATON_TERMS, AUTOMATON_BYTES = 300_000, 4 << 20
#: Bits of the Bloom filter of anchors for each term, and at most (16 MB).
BLOOM_BITS, MOST_BLOOM_BITS = 16, 1 << 27
#: Anchors asked for to a term from which the filter saves more than its bits cost.
BLOOM_GAIN = 8
#: Terms of one anchor from which it is hot, and the parts that they are then dealt to.
HOT_ANCHOR, SALTS = 100_000, 64
#: Terms and anchors that meet in one part, at most on average; terms to a part from which it is split for the sake of more tasks.
PART_TERMS, PART_ANCHORS, LEAST_TERMS = 1 << 20, 1 << 24, 1 << 16
#: Bytes of the texts of a block on average; terms that are packed at once.
BLOCK_BYTES, PACK_TERMS = 2 << 20, 1 << 22
#: Spark's setting to delete the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
KINDS = ("page_text", "raw_content", "other")
_VIEW_BREAK = "\uffff"  # not a character, so no term spans two views


def usable(terms: DataFrame) -> DataFrame:
    """Distinct terms that are not blank."""
    return _not_blank(terms).distinct()


def _not_blank(terms: DataFrame) -> DataFrame:
    return terms.select("term").where(F.col("term").rlike(P.NOT_SPACE))


def distinct_pieces(texts: DataFrame, size: int, step: int) -> DataFrame:
    """term: the distinct pieces of the column ``text`` as :func:`palimp.functions.grams.pieces` cuts them, written."""
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = chars // step // (2 * PART_TERMS) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            terms = pa.chunked_array(held, pa.string()).combine_chunks()
            part = (whole_hashes(terms) % np.uint64(parts)).astype(np.int64)
            return pa.RecordBatch.from_pylist([{"part": p, "payload": x} for p, x in by_part(pa.table({"term": terms}), part)],
                                              pa.schema([("part", pa.int64()), ("payload", pa.binary())]))

        for batch in slices(batches):
            held.append(pieces(batch.column("text"), size, step))
            n += len(held[-1])
            if n > PACK_TERMS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def unique(part: pa.Table) -> pa.Table:
        return in_batches(once(pa.concat_tables(unpack(part["payload"])).combine_chunks()))

    dealt = texts.select("text").mapInArrow(cut, "part long, payload binary")
    return _written(dealt.groupBy("part").applyInArrow(unique, "term string"), "pieces")


def hay(kind: Column, value: Column, case_sensitive: bool = False) -> Column:
    """The searched form of a value: page text in its normalised views, raw content byte-wise, others folded."""
    normal = squeeze(value)
    views = F.when(F.contains(value, F.lit("-\n")), F.concat(normal, F.lit(_VIEW_BREAK), squeeze(dehyphenate(value)))).otherwise(normal)
    if case_sensitive:
        return F.when(kind == "page_text", views).otherwise(value)
    return F.when(kind == "page_text", fold(views)).when(kind == "raw_content", ascii_fold(value)).otherwise(fold(value))


def needle(kind: Column, term: Column, case_sensitive: bool = False) -> Column:
    if case_sensitive:
        return F.when(kind == "page_text", squeeze(term)).otherwise(term)
    return F.when(kind == "page_text", fold(squeeze(term))).when(kind == "raw_content", ascii_fold(term)).otherwise(fold(term))


def _kind(surface: Column) -> Column:
    return F.when(surface.isin("page_text", "raw_content"), surface).otherwise("other")


def term_hits(rows: DataFrame, keys: list[str], terms: DataFrame, case_sensitive: bool = False,
              few: int = FEW_TERMS, bound: int = AUTOMATON_TERMS, hot: int = HOT_ANCHOR) -> DataFrame:
    """rows(keys.., surface, value) and terms(term) to every (keys.., surface, term) that occurs.

    ``keys`` identify a row.
    """
    most = max(few, bound)
    if terms.count() > most:
        # An estimate will do, since every plan finds the same.
        if _not_blank(terms).agg(F.approx_count_distinct("term")).first()[0] > 1.1 * most:
            return _by_parts(rows, keys, terms, case_sensitive, hot)
        terms = _written(usable(terms), "terms")  # they are read several times
    literal = literal_hits(terms, case_sensitive, few)
    if literal is not None:
        # The outer form keeps the optimiser from evaluating the array again as a filter.
        every = rows.select(*keys, "surface", F.explode_outer(literal).alias("term"))
        return every.where("term is not null")
    shared = broadcast_terms(terms, case_sensitive, bound)
    if shared is not None:
        return _by_automaton(rows, keys, shared)
    return _by_parts(rows, keys, terms, case_sensitive, hot)


def broadcast_terms(terms: DataFrame, case_sensitive: bool = False, bound: int = AUTOMATON_TERMS):
    """The usable terms as a broadcast for :func:`matcher_of`, or None where they are more than the bounds."""
    wanted = usable(terms)
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n > bound or size > AUTOMATON_BYTES:
        return None
    held = {"terms": sorted(r.term for r in wanted.collect()), "case_sensitive": case_sensitive}
    return terms.sparkSession.sparkContext.broadcast(held)


def _by_automaton(rows: DataFrame, keys: list[str], shared) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(shared.value)
        for batch in slices(batches):
            kinds = [s if s in KINDS else KINDS[-1] for s in batch.column("surface").to_pylist()]
            found = [matcher.found(v, k) if v else [] for v, k in zip(batch.column("value").to_pylist(), kinds)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            terms = pa.array([t for f in found for t in f], pa.string())
            kept = batch.drop_columns(["value"]).take(at)
            yield pa.RecordBatch.from_arrays([*kept.columns, terms], [*kept.schema.names, "term"])

    held = rows.select(*keys, "surface", "value")
    schema = held.drop("value").schema.add("term", "string")
    return held.mapInArrow(search, schema)


def literal_hits(terms: DataFrame, case_sensitive: bool = False, few: int = FEW_TERMS) -> Column | None:
    """For at most ``few`` terms the array of terms in a row's (surface, value); null for more terms."""
    needles = [needle(F.lit(k), F.col("term"), case_sensitive).alias(k) for k in KINDS]
    held = usable(terms).select("term", *needles).limit(few + 1).collect()
    if len(held) > few:
        return None
    fields = ", ".join(f"{c} string" for c in ("term", *KINDS))
    owned = F.from_json(F.lit(json.dumps([r.asDict() for r in held])), f"array<struct<{fields}>>")
    kind = _kind(F.col("surface"))
    searched = F.struct(kind.alias("kind"), hay(kind, F.col("value"), case_sensitive).alias("hay"))

    def found(row: Column, name: str) -> Column:
        return F.filter(owned, lambda t: F.contains(row["hay"], t[name]))

    # One lambda over the searched form, so that it is computed once per row and not once per term.
    hits = F.transform(F.array(searched), lambda row: F.when(row["kind"] == KINDS[0], found(row, KINDS[0]))
                       .when(row["kind"] == KINDS[1], found(row, KINDS[1])).otherwise(found(row, KINDS[2])))
    return F.transform(F.flatten(hits), lambda t: t["term"])


def _owned_anchors(needles: DataFrame) -> DataFrame:
    """One anchor per (term, kind): short needles whole, long ones the minimiser that the fewest terms share."""
    short = _short(needles).select("kind", "term", "needle", grams.short_anchors(F.col("needle")).alias("anchor"))
    return short.unionByName(_long_anchors(needles))


def _short(needles: DataFrame) -> DataFrame:
    return needles.where((F.length("needle") < LONG_NEEDLE) & (F.length("needle") > 0))


def _long_anchors(needles: DataFrame) -> DataFrame:
    long = needles.where(F.length("needle") >= LONG_NEEDLE)
    every = long.select("kind", "term", "needle", F.explode(grams.needle_anchors(F.col("needle"))).alias("anchor"))
    shared = every.groupBy("kind", "anchor").agg(F.count(F.lit(1)).alias("share"))
    picked = every.join(shared, ["kind", "anchor"]).groupBy("kind", "term", "needle").agg(
        F.min(F.struct("share", "anchor")).alias("best"))
    return picked.select("kind", "term", "needle", F.col("best.anchor").alias("anchor"))


def _class() -> Column:
    return F.when(F.length("needle") >= LONG_NEEDLE, LONG).otherwise(F.length("needle"))


def _classes(owned: DataFrame) -> list[int]:
    return sorted(r.c for r in owned.select(_class().alias("c")).distinct().collect())


def anchor_filter(owned: DataFrame) -> np.ndarray:
    """A Bloom filter of the owned anchors as 64-bit words, of bounded size, put together by the tasks word by word."""
    size = 1 << 16
    while size < min(BLOOM_BITS * owned.count(), MOST_BLOOM_BITS):
        size *= 2
    places = [F.col("anchor").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("anchor", 32).bitwiseAND(F.lit(size - 1))]
    bits = owned.select(F.explode(F.array(*places)).alias("bit"))
    bit = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(size // 64, dtype=np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def _by_parts(rows: DataFrame, keys: list[str], terms: DataFrame, case_sensitive: bool, hot: int) -> DataFrame:
    id_ = [*keys, "surface"]
    kind = _kind(F.col("surface"))
    given = rows.select(*id_, kind.alias("kind"), "value").where(F.expr(" and ".join(f"`{c}` is not null" for c in [*id_, "value"])))
    sizes = {r.kind: r.size for r in given.groupBy("kind").agg(F.sum(F.octet_length("value").cast("long")).alias("size")).collect()}  # at most three
    needles = _not_blank(terms).select("term", F.explode(F.array(*[F.lit(k) for k in sizes] or [F.lit("")])).alias("kind"))
    needles = needles.withColumn("needle", needle(F.col("kind"), F.col("term"), case_sensitive))
    lengths = needles.groupBy("kind", _class().alias("cls")).agg(F.count("*").alias("n")).collect()  # at most twelve a kind
    classes = {k: sorted(r.cls for r in lengths if r.kind == k) for k in sizes}
    n, asked = sum(r.n for r in lengths), sum(size * len(classes[k]) for k, size in sizes.items())

    bloom, often = None, None
    if asked > BLOOM_GAIN * n and BLOOM_BITS * n <= MOST_BLOOM_BITS:
        owned = _written(_owned_anchors(needles), "anchors")
        bloom = anchor_filter(owned)
    elif any(r.cls == LONG for r in lengths):
        owned = _written(_short(needles).withColumn("anchor", F.lit(None).cast("long")).unionByName(_long_anchors(needles)), "anchors")
    else:
        owned = needles.withColumn("anchor", F.lit(None).cast("long"))  # hashed where they are packed
    if any(r.cls == LONG for r in lengths):
        # At most one for every ``hot`` terms.
        found = owned.where("anchor is not null").groupBy("kind", "anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).collect()
        often = {k: np.unique(np.array([r.anchor for r in found if r.kind == k], np.int64).view(np.uint64)) for k in sizes}
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // PART_TERMS), -(-asked // PART_ANCHORS), min(cores, -(-n // LEAST_TERMS)), 1)

    counts = F.coalesce(*[F.when(F.col("kind") == k, F.lit(size // BLOCK_BYTES + 1)) for k, size in sizes.items()], F.lit(1).cast("long"))
    blocks = given.select(*id_, "kind", hay(F.col("kind"), F.col("value"), case_sensitive).alias("hay"), F.pmod(F.xxhash64(*id_), counts).alias("block"))
    # A block has one kind; so has a part.
    wanted = blocks.select("kind", "block", "hay").groupBy("kind", "block").applyInArrow(_asking(classes, bloom, often, parts), "kind string, part long, block long, payload binary")
    different = F.when(F.col("needle") != F.col("term"), F.col("needle"))
    dealt = owned.select("kind", "term", different.alias("needle"), "anchor").mapInArrow(_dealing(often, parts), "kind string, part long, payload binary")
    found = dealt.groupBy("kind", "part").cogroup(wanted.groupBy("kind", "part")).applyInArrow(_meet, "kind string, block long, payload binary")
    schema = rows.select(*id_).schema.add("term", "string")
    return blocks.groupBy("kind", "block").cogroup(found.groupBy("kind", "block")).applyInArrow(_searching(id_), schema)


def _parts_of(anchors: np.ndarray, hot: np.ndarray | None, parts: int, salt: np.ndarray | int) -> np.ndarray:
    """The part of each anchor, whose upper half is looked up there; the terms of a hot one lie in several."""
    low = anchors & np.uint64(0xFFFFFFFF)
    if hot is not None and len(hot):
        low = low + np.where(np.isin(anchors, hot), salt, 0).astype(np.uint64)
    return (low % np.uint64(parts)).astype(np.int64)


def _asking(classes: dict, bloom: np.ndarray | None, often: dict | None, parts: int) -> Callable[[pa.Table], pa.Table]:
    def ask(block: pa.Table) -> pa.Table:
        kind, number = block["kind"][0].as_py(), block["block"][0].as_py()
        codes, ends = joined(block["hay"])
        hot, keys, out = often and often[kind], [], []
        for cls in classes[kind]:
            for anchors, _, _ in windows(codes, ends, cls):
                if bloom is not None:
                    anchors = let_pass(anchors.view(np.int64), bloom).view(np.uint64)
                again = anchors[np.isin(anchors, hot)] if hot is not None and len(hot) else anchors[:0]
                for salt, some in [(0, anchors), *((salt, again) for salt in range(1, min(SALTS, parts)) if len(again))]:
                    keys.append(ascending(_parts_of(some, hot, parts, salt).astype(np.uint64) << np.uint64(32) | some >> np.uint64(32)))
        keys = ascending(np.concatenate(keys or [np.empty(0, np.uint64)]))
        for place, first, last in stretches(keys >> np.uint64(32)):
            out.append({"kind": kind, "part": place, "block": number, "payload": pack_numbers(keys[first:last].astype(np.uint32))})
        return pa.Table.from_pylist(out, pa.schema([("kind", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())]))

    return ask


def _anchors(held: pa.Table) -> np.ndarray:
    """The anchors of packed terms: those that were chosen for them, or else the hashes of their needles."""
    chosen, out = pc.is_valid(held["anchor"]).to_numpy(), np.zeros(len(held), np.uint64)
    out[chosen] = held["anchor"].drop_null().to_numpy().astype(np.int64).view(np.uint64)
    if not chosen.all():
        out[~chosen] = whole_hashes(_needles(held).filter(pa.array(~chosen)))
    return out


def _needles(held: pa.Table) -> pa.StringArray:
    return pc.coalesce(held["needle"], held["term"]).combine_chunks()


def _dealing(often: dict | None, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("payload", pa.binary())])

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        out, every = [], pa.Table.from_batches(held)
        for kind in pc.unique(every["kind"]).to_pylist():
            terms = every.filter(pc.equal(every["kind"], kind)).drop_columns(["kind"])
            hot = often and often[kind]
            # The rows of one term lie in one part.
            salt = whole_hashes(terms["term"].combine_chunks()) % np.uint64(min(SALTS, parts)) if hot is not None and len(hot) else 0
            out += [{"kind": kind, "part": p, "payload": x} for p, x in by_part(terms, _parts_of(_anchors(terms), hot, parts, salt))]
        return pa.RecordBatch.from_pylist(out, schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in slices(batches):
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n > PACK_TERMS or size > 32 * PACK_TERMS:
                yield flush(held)
                held, n, size = [], 0, 0
        if n:
            yield flush(held)

    return deal


def _meet(terms: pa.Table, asked: pa.Table) -> pa.Table:
    """Of one part: for each block the terms whose anchors it asked for."""
    out = []
    if len(terms) and len(asked):
        held = once(pa.concat_tables(unpack(terms["payload"])).combine_chunks()).combine_chunks()
        upper = (_anchors(held) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(upper, kind="stable")
        upper = upper[order]
        for block, payload in zip(asked["block"].to_pylist(), asked["payload"]):
            wanted = unpack_numbers(payload.as_py())
            _, at = spans(np.searchsorted(upper, wanted, "left"), np.searchsorted(upper, wanted, "right"))
            if len(at):
                out.append({"kind": asked["kind"][0].as_py(), "block": block, "payload": pack(held.take(np.sort(order[at])))})
    return pa.Table.from_pylist(out, pa.schema([("kind", pa.string()), ("block", pa.int64()), ("payload", pa.binary())]))


def _searching(id_: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(block: pa.Table, found: pa.Table) -> pa.Table:
        rows = block.select(id_)
        none = rows.slice(0, 0).append_column("term", pa.array([], pa.string()))
        if not (len(block) and len(found)):
            return none
        held = pa.concat_tables(unpack(found["payload"])).combine_chunks()
        row, term, times = _occurrences(block["hay"], held, _same(rows))
        row, term = np.repeat(row, times), np.repeat(term, times)
        out = [rows.take(row[i : i + ROWS]).append_column("term", held["term"].take(term[i : i + ROWS])) for i in range(0, len(row), ROWS)]
        return pa.concat_tables([t.combine_chunks() for t in out]) if out else none

    return search


def _same(rows: pa.Table) -> np.ndarray:
    """For each row the first one with the same keys."""
    first: dict[tuple, int] = {}
    return np.array([first.setdefault(key, i) for i, key in enumerate(zip(*(c.to_pylist() for c in rows.columns)))], np.int64)


def _occurrences(texts: pa.ChunkedArray, held: pa.Table, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the terms that occur in the texts. Texts with the same keys count as one that holds the anchors and
    the terms of each, and a term counts there as often as anchors meet terms."""
    needles, m = _needles(held), len(held)
    lengths, (codes, ends) = pc.utf8_length(needles).to_numpy(zero_copy_only=False), joined(texts)
    sure, maybe, plain = [], [], None
    for cls in np.unique(np.where(lengths >= LONG_NEEDLE, LONG, lengths)).tolist():
        mine = np.flatnonzero(lengths >= LONG_NEEDLE if cls == LONG else lengths == cls)
        anchors = _anchors(held.take(mine))
        order = np.argsort(anchors, kind="stable")
        anchors, mine = anchors[order], mine[order]
        letters = None if cls == LONG else as_rows(needles.take(pa.array(mine)), cls)
        pairs = []
        for given, starts, text in windows(codes, ends, cls):
            first = np.searchsorted(anchors, given, "left")
            known = np.flatnonzero(anchors[np.minimum(first, len(anchors) - 1)] == given)
            which, at = spans(first[known], np.searchsorted(anchors, given[known], "right"))
            which = known[which]
            if letters is not None:
                equal = np.ones(len(at), bool)
                for k in range(cls):
                    equal &= codes[starts[which] + k] == letters[at, k]
                which, at = which[equal], at[equal]
            pairs.append(ascending(text[which] * m + mine[at]))
        pairs = ascending(np.concatenate(pairs or [np.empty(0, np.int64)]))
        maybe.append(pairs)
        if cls == LONG:
            plain = plain or texts.to_pylist()
            pairs = pairs[[needles[t].as_py() in plain[i] for i, t in zip((pairs // m).tolist(), (pairs % m).tolist())]] if len(pairs) else pairs
        sure.append(pairs)
    sure, maybe = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (sure, maybe))
    alone = np.array_equal(same, np.arange(len(same)))
    if alone:
        return sure // m, sure % m, np.ones(len(sure), np.int64)
    holding, held_by = np.unique(same[sure // m] * m + sure % m, return_counts=True)
    asking, asked_by = np.unique(same[maybe // m] * m + maybe % m, return_counts=True)
    return holding // m, holding % m, held_by * asked_by[np.searchsorted(asking, holding)]


def _written(df: DataFrame, label: str) -> DataFrame:
    """Written and read back; what was shuffled for it goes. Sorted strings are stored as what differs from the one before."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**{"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def removal_pattern(term: Column, case_sensitive: bool = False) -> Column:
    """A pattern that finds the term in any of the searched views, also across a line break or hyphenation."""
    breaks = r"(?:-\n)*"
    chars = F.filter(F.split(squeeze(term), "", -1), lambda c: c != "")
    parts = F.transform(chars, lambda c: F.when(c == " ", F.lit(r"\s+(?:-\n|\s)*")).otherwise(escape_regex(c)))
    return F.concat(F.lit("" if case_sensitive else "(?iu)"), F.array_join(parts, breaks))

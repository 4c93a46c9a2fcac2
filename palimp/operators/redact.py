"""Removal of terms and regions from pages and surfaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp import model
from palimp.functions.matching import Matcher, matcher_of, slices
from palimp.operators.terms import FEW_TERMS, broadcast_terms, literal_hits, removal_pattern, term_hits
from palimp.session import ship_by_value

ship_by_value(__name__)


def page_surfaces(doc_pages: DataFrame) -> DataFrame:
    """Pages of plain text as rows of the ``page_text`` surface."""
    return doc_pages.select("doc_id", "page_no", F.lit("page_text").alias("surface"), F.col("text").alias("value"))


def page_hits(doc_pages: DataFrame, terms: DataFrame, **kw) -> DataFrame:
    return term_hits(page_surfaces(doc_pages), ["doc_id", "page_no"], terms, **kw).drop("surface")


def redact_terms(doc_pages: DataFrame, terms: DataFrame, case_sensitive: bool = False, pages: list[int] | None = None, **kw) -> DataFrame:
    """Replace every occurrence by a mark; ``hits`` counts occurrences in the original text.

    Longer terms go first, so a short one cannot break them up.
    """
    in_scope = F.lit(True) if pages is None else F.col("page_no").isin(pages)
    literal = literal_hits(terms, case_sensitive, kw.get("few", FEW_TERMS))
    none = F.array().cast("array<string>")
    if literal is None:
        return _redact_many(doc_pages, terms, case_sensitive, in_scope, **kw)
    # Few terms: found and removed inside each row, nothing is shuffled.
    found = page_surfaces(doc_pages).select("doc_id", "page_no", F.col("value").alias("original"), F.when(in_scope, literal).otherwise(none).alias("found"))
    longest_first = F.array_sort(F.transform(F.coalesce("found", none), lambda t: F.struct((-F.length(t)).alias("o"), t.alias("term"))))
    todo = F.transform(longest_first, lambda t: removal_pattern(t["term"], case_sensitive))
    staged = found.select("doc_id", "page_no", "original", todo.alias("todo"))
    text = F.aggregate("todo", F.col("original"), lambda acc, p: F.regexp_replace(acc, p, F.lit(model.REDACTION_MARK)))
    count = F.aggregate("todo", F.lit(0).cast("bigint"), lambda acc, p: acc + F.regexp_count(F.col("original"), p))
    return staged.select("doc_id", "page_no", text.alias("text"), count.alias("hits"))


def _with_matcher(doc_pages: DataFrame, terms: DataFrame, case_sensitive: bool, in_scope: Column, **kw):
    """Pages with their scope, and a function to the matcher of a batch's rows: one of all terms where they can be broadcast,
    else each page's own, of the terms that the join found on it."""
    shared = broadcast_terms(terms, case_sensitive, **{k: v for k, v in kw.items() if k == "bound"})
    rows = doc_pages.withColumn("scope", F.coalesce(in_scope, F.lit(False)))
    if shared is None:
        hits = page_hits(doc_pages.where(in_scope), terms, case_sensitive=case_sensitive, **kw)
        # A page's own distinct terms: bounded by the length of that page.
        per_page = hits.groupBy("doc_id", "page_no").agg(F.collect_list("term").alias("found"))
        rows = rows.join(per_page, ["doc_id", "page_no"], "left")

    def matchers(batch: pa.RecordBatch) -> list[Matcher]:
        if shared is not None:
            return [matcher_of(shared.value)] * batch.num_rows
        return [Matcher(found or [], case_sensitive) for found in batch.column("found").to_pylist()]

    return rows, matchers


def _redact_many(doc_pages: DataFrame, terms: DataFrame, case_sensitive: bool, in_scope: Column, **kw) -> DataFrame:
    """Removal by an automaton."""
    rows, matchers = _with_matcher(doc_pages.select("doc_id", "page_no", "text"), terms, case_sensitive, in_scope, **kw)
    mark = model.REDACTION_MARK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts = [], []
            for text, scope, matcher in zip(batch.column("text").to_pylist(), batch.column("scope").to_pylist(), matchers(batch)):
                spans, n = matcher.chosen(text, "page_text") if text and scope else ([], 0)
                texts.append(without(text, spans, mark) if spans else text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("page_no"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "page_no", "text", "hits"])

    kinds = dict(doc_pages.dtypes)
    return rows.mapInArrow(cut, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, text string, hits bigint")


MOVED = "array<struct<s: bigint, e: bigint, new_s: bigint, new_e: bigint>>"


def blank_and_cut(text: str, regions: list[tuple[int, int]], matcher: Matcher, mark: str) -> tuple[str, int, list[dict[str, int]]]:
    """The text with its regions blank and then its terms cut; the occurrences cut; and where each region lies in the result.

    A region keeps its length, also where a term runs over it.
    """
    blank = np.zeros(len(text) + 1, dtype=bool)
    for start, end in regions:
        blank[start:end] = True
    chars = [" " if b else c for c, b in zip(text, blank)]
    spans, n = matcher.chosen("".join(chars), "page_text")
    for start, end in spans:
        outside = [i for i in range(start, end) if not blank[i]]
        for i in outside:
            chars[i] = ""
        if outside:
            chars[outside[0]] = mark
    place = np.concatenate([[0], np.cumsum([len(c) for c in chars], dtype=np.int64)])
    moved = [{"s": s, "e": e, "new_s": int(place[s]), "new_e": int(place[e])} for s, e in regions]
    return "".join(chars), n, moved


def redact_terms_and_regions(doc_pages: DataFrame, terms: DataFrame, regions: DataFrame, case_sensitive: bool = False, **kw) -> DataFrame:
    """(doc_id, page_no, text, hits, moved): regions(doc_id, page_no, s, e) blanked, terms cut from what is left, and where each
    valid region of the page lies in the written text. Invalid or empty regions are skipped here; their check fails."""
    grouped = regions.where("s is not null and e is not null").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    joined = doc_pages.select("doc_id", "page_no", "text").join(grouped, ["doc_id", "page_no"], "left")
    length = F.length("text")
    joined = joined.withColumn("spans", F.filter(F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")), lambda r: valid_region(r["s"], r["e"], length)))
    rows, matchers = _with_matcher(joined, terms, case_sensitive, F.lit(True), **kw)
    mark = model.REDACTION_MARK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = []
            for text, spans, matcher in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), matchers(batch)):
                done.append((text, 0, []) if text is None else blank_and_cut(text, [(r["s"], r["e"]) for r in spans], matcher, mark))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("s", "e", "new_s", "new_e")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("page_no"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([d[2] for d in done], kind)], ["doc_id", "page_no", "text", "hits", "moved"])

    kinds = dict(doc_pages.dtypes)
    return rows.mapInArrow(cut, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, text string, hits bigint, moved {MOVED}")


def moved_regions(regions: DataFrame, redacted: DataFrame) -> DataFrame:
    """Regions as they lie in the written pages; those that were skipped keep their numbers."""
    moved = redacted.select("doc_id", "page_no", F.inline("moved"))
    return regions.join(moved, ["doc_id", "page_no", "s", "e"], "left").select(
        "doc_id", "page_no", F.coalesce("new_s", "s").alias("s"), F.coalesce("new_e", "e").alias("e"))


def without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with a mark for each of the sorted spans."""
    pieces, at = [], 0
    for start, end in spans:
        pieces += [text[at:start], mark]
        at = end
    return "".join(pieces) + text[at:]


def _hit_rows(surfaces: DataFrame, terms: DataFrame, **kw) -> DataFrame:
    return term_hits(surfaces, ["doc_id", "pos"], terms, **kw).select("doc_id", "pos").distinct()


def scrub_surfaces(surfaces: DataFrame, terms: DataFrame, **kw) -> DataFrame:
    """Whole-value removal outside page content. ``hit`` tells which rows matched, ``kept`` which stay.

    One matching info or metadata field drops all of that kind in the document; a bookmark keeps a mark,
    a form field loses its value, and annotations, links and embedded names go.
    """
    scope = surfaces.where(~F.col("surface").isin("page_text", "raw_content"))
    hit = _hit_rows(scope, terms, **kw).withColumn("hit", F.lit(True))
    marked = scope.join(hit, ["doc_id", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    wholesale = F.col("surface").isin("docinfo", "xmp")
    dropped = marked.where(wholesale & F.col("hit")).select("doc_id", "surface").distinct().withColumn("whole", F.lit(True))
    s = F.col("surface")
    return (
        marked.join(dropped, ["doc_id", "surface"], "left")
        .withColumn("kept", F.coalesce(~F.col("whole"), ~F.col("hit") | s.isin("bookmarks", "form_fields")))
        .withColumn("value", F.when(F.col("hit") & (s == "bookmarks"), model.SCRUB_MARK)
                    .when(F.col("hit") & (s == "form_fields"), "").otherwise(F.col("value")))
        .drop("whole")
    )


def removal_counts(scrubbed: DataFrame) -> DataFrame:
    """Removed values per document and surface; a metadata packet counts once."""
    n = F.count(F.lit(1))
    return scrubbed.where("hit").groupBy("doc_id", "surface").agg(
        F.when(F.col("surface") == "xmp", F.lit(1)).otherwise(n).cast("bigint").alias("removed"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """Per document and surface: hits and distinct pages."""
    return hits.groupBy("doc_id", "surface").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("page_no").alias("pages"))


def valid_region(start: Column, end: Column, length: Column) -> Column:
    return F.coalesce((start >= 0) & (end <= length) & (start < end), F.lit(False))


def redact_spans(doc_pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Blank regions(doc_id, page_no, s, e) of a page; invalid or empty ones are skipped, offsets stay."""
    grouped = regions.where("s is not null and e is not null").groupBy("doc_id", "page_no").agg(
        F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    joined = doc_pages.join(grouped, ["doc_id", "page_no"], "left")
    length = F.length("text")
    todo = F.filter(F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")), lambda r: valid_region(r["s"], r["e"], length))

    def blank(acc: Column, r: Column) -> Column:
        size = (r["e"] - r["s"]).cast("int")
        return F.concat(F.substring(acc, F.lit(1), r["s"].cast("int")), F.repeat(F.lit(" "), size),
                        F.substring(acc, (r["e"] + 1).cast("int"), length))

    return joined.select("doc_id", "page_no", F.aggregate(todo, F.col("text"), blank).alias("text"), F.size(todo).cast("bigint").alias("regions"))


def touched_spans(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Spans(doc_id, page_no, s, e, ..) that overlap a region; the page is the join key, so pairs stay within a page."""
    a, b = spans.alias("a"), regions.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_no") == F.col("b.page_no"))
    return a.join(b, same & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e")), "left_semi")


def suppress_pages(doc_pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Drop the whole text of target pages (doc_id, page_no)."""
    t = targets.select("doc_id", "page_no").distinct().withColumn("_t", F.lit(True))
    return doc_pages.join(t, ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no", F.when(F.col("_t"), "").otherwise(F.col("text")).alias("text"))

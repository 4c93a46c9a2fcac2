"""Redaction of web pages over all their surfaces, and their release only with proof.

A page is read into parts. The text that a reader sees is laid out as one string beside a map of intervals back to the markup,
so that a hit in the text, also one that runs over tags, is cut out of the page. Values outside the text go whole: one hit in
a document's information or metadata drops all of that kind, a heading keeps a mark, a form field loses its value, and
annotations, links and embedded parts go. What is proved is the written page, of which all surfaces are derived anew.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp import model
from palimp.functions.markup import Part, edited, parts
from palimp.functions.matching import Matcher, matcher_of, slices
from palimp.operators.terms import broadcast_terms, term_hits
from palimp.operators.verify import stage, verified_docs, verify_surfaces
from palimp.session import ship_by_value
from palimp.sources.surfaces import surfaces_from_html

ship_by_value(__name__)

SCRUBBED = [s for s in model.SURFACES if s != "raw_content"]
_HEADINGS = {f"h{i}" for i in range(1, 7)}
_NOTES, _TARGETS = {"title", "alt", "aria-label"}, {"href", "src"}


class Layout:
    """The visible text of a page and where it stands in the markup: text parts in order, a space for all other parts."""

    def __init__(self, page: str, found: list[Part]):
        visible = lambda p: p.kind == "text" or p.kind == "raw" and p.name not in ("script", "style")
        pieces = [page[p.start : p.end] if visible(p) else " " for p in found]
        self.text = "".join(pieces)
        self.starts = [0, *accumulate(map(len, pieces))]  # where each part begins in the text
        self.origin = [p.start if visible(p) else -1 for p in found]

    def cuts(self, start: int, end: int, mark: str) -> list[tuple[int, int, str]]:
        """Edits of the markup that take a span out of the text and leave the tags within it."""
        edits, i = [], bisect_right(self.starts, start) - 1
        while i < len(self.origin) and self.starts[i] < end:
            first, last = max(start, self.starts[i]), min(end, self.starts[i + 1])
            if self.origin[i] >= 0 and first < last:
                shift = self.origin[i] - self.starts[i]
                edits.append((first + shift, last + shift, "" if edits else mark))
            i += 1
        return edits


def redact_page(page: str, url: str, matcher: Matcher) -> tuple[str, str, Counter]:
    """The page and its address without the matcher's terms, and how many values or occurrences went from each surface."""
    found, edits, counts = list(parts(page)), [], Counter()
    hit = lambda value: bool(value) and bool(matcher.found(value, "other"))
    info: list[tuple[bool, tuple[int, int, str] | None]] = [(hit(url), None)]  # hit or not, and the edit that drops it
    packets: list[tuple[bool, tuple[int, int, str]]] = []
    linked, heading = None, None

    def scrub(surface: str, edit: tuple[int, int, str]) -> None:
        counts[surface] += 1
        edits.append(edit)

    for at, p in enumerate(found):
        inside = page[p.start : p.end]
        if p.kind == "comment" and hit(inside.removeprefix("<!--").removesuffix("-->")):
            scrub("annotations", (p.start, p.end, ""))
        elif p.kind == "raw" and p.name == "title":
            info.append((hit(inside), (p.start, p.end, "")))
        elif p.kind == "raw" and p.name == "textarea" and hit(inside):
            scrub("form_fields", (p.start, p.end, ""))
        elif p.kind == "raw" and p.name == "script" and linked:
            packets[-1] = (hit(inside), (linked.start, p.end, ""))
        elif p.kind == "close":
            if p.name == "script" and linked:
                packets[-1] = (packets[-1][0], (linked.start, p.end, ""))
                linked = None
            elif p.name in _HEADINGS and heading:
                words = " ".join(page[q.start : q.end] for q in found[heading[1] : at] if q.kind == "text")
                if hit(" ".join(words.split())):
                    scrub("bookmarks", (heading[0].end, p.start, model.SCRUB_MARK))
                heading = None
        elif p.kind == "open":
            values = {a.name: a for a in reversed(p.attributes)}  # the first of a name counts
            raw = lambda a: page[a.value_start : a.end] if a.value_start >= 0 else ""
            matched = lambda name: name in values and (hit(values[name].value) or hit(raw(values[name])))
            if p.name in _HEADINGS and not heading:
                heading = (p, at)
            if p.name == "script" and "application/ld+json" in inside.lower():
                linked = p
                packets.append((False, (p.start, p.end, "")))
            if p.name == "html" and "lang" in values:
                info.append((matched("lang"), (values["lang"].start, values["lang"].end, "")))
            if p.name == "meta" and "name" in values:
                info.append((matched("content"), (p.start, p.end, "")))
            if p.name == "meta" and "property" in values:
                packets.append((matched("content"), (p.start, p.end, "")))
            if p.name == "input" and matched("value"):
                scrub("form_fields", (values["value"].value_start, values["value"].end, '""'))
            if (p.name == "embed" and matched("src")) or (p.name == "object" and matched("data")):
                counts["embedded_files"] += 1
                edits.append((p.start, p.end, ""))
            for name, surface in [*((n, "annotations") for n in _NOTES), *((n, "links") for n in _TARGETS), ("download", "embedded_files")]:
                if matched(name):
                    scrub(surface, (values[name].start, values[name].end, ""))
                    counts["embedded_files"] += surface == "links" and values[name].value.lower().startswith("data:")
    for surface, held in (("docinfo", info), ("xmp", packets)):
        if any(was_hit for was_hit, _ in held):
            counts[surface] += 1 if surface == "xmp" else sum(was_hit for was_hit, _ in held)
            edits += [edit for _, edit in held if edit]
            url = "" if surface == "docinfo" else url
    layout = Layout(page, found)
    spans, counts["page_text"] = matcher.chosen(layout.text, "page_text")
    for start, end in spans:
        edits += layout.cuts(start, end, model.REDACTION_MARK)
    return edited(page, edits), url, counts


def redact_pages(pages: DataFrame, terms: DataFrame, case_sensitive: bool = False, **kw) -> DataFrame:
    """pages(page_id, url, html) to (page_id, url, html, and a count for each scrubbed surface).

    Up to a bound of the terms' number and bytes one automaton of all of them runs over each page where it lies; beyond it the
    terms of a page are those that the anchor join found on its surfaces. A page without html stays null.
    """
    shared = broadcast_terms(terms, case_sensitive, **{k: v for k, v in kw.items() if k == "bound"})
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html")
    if shared is None:
        surfaces = surfaces_from_html(pages)
        hits = term_hits(surfaces, ["doc_id", "pos"], terms, case_sensitive=case_sensitive, few=0, **kw)
        # A page's own distinct terms: bounded by the length of that page.
        own = hits.groupBy(F.col("doc_id").alias("page_id")).agg(F.collect_set("term").alias("found"))
        rows = rows.join(own, "page_id", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything = matcher_of(shared.value) if shared else None
        for batch in slices(batches):
            own = batch.column("found").to_pylist() if shared is None else [None] * batch.num_rows
            done = []
            for html, url, found in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), own):
                done.append((None, url, Counter()) if html is None else redact_page(html, url, everything or Matcher(found or [], case_sensitive)))
            counts = [pa.array([c[s] for _, _, c in done], pa.int64()) for s in SCRUBBED]
            texts = [pa.array([d[i] for d in done], pa.string()) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *texts, *counts], ["page_id", "url", "html", *SCRUBBED])

    return rows.mapInArrow(rewrite, f"page_id {dict(rows.dtypes)['page_id']}, url string, html string, " + ", ".join(f"{s} bigint" for s in SCRUBBED))


def release_pages(pages: DataFrame, terms: DataFrame, case_sensitive: bool = False, **kw) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Redact, write, verify the nine surfaces of the written pages, then split: (released, quarantined, report, checks).

    The proof is case-insensitive whatever the removal was. A page that cannot be read is quarantined.
    """
    written = stage(redact_pages(pages, terms, case_sensitive, **kw), "web")
    docs = pages.select(F.col("page_id").alias("doc_id"))
    checks = stage(verify_surfaces(surfaces_from_html(written), docs, terms, **kw), "web-checks")
    removed = written.select(F.col("page_id").alias("doc_id"), sum(F.col(s) for s in SCRUBBED).alias("hits"))
    report = verified_docs(docs, checks).join(removed, "doc_id", "left").select(
        "doc_id", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), "verified",
        F.when(~F.col("verified"), "quarantined").when(F.coalesce("hits", F.lit(0)) == 0, "no_match").otherwise("released").alias("status"))
    report = stage(report, "web-report")
    split = lambda status: written.join(report.where(F.col("status") == status).withColumnRenamed("doc_id", "page_id"), "page_id", "left_semi")
    return split("released"), split("quarantined"), report, checks

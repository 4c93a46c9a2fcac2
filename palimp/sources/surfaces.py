"""Text documents to pages, web pages to named surfaces. Both are narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions import patterns as P
from palimp.functions.text import attr_value, find_all, first_match, matched_value, squeeze
from palimp.session import per_session


def page_array(text: Column, lines_per_page: int) -> Column:
    """Array of page texts; lines stay in order."""
    lines = F.split(text, "\n", -1)
    count = F.ceil(F.size(lines) / lines_per_page).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.array_join(F.slice(lines, i * lines_per_page + 1, F.lit(lines_per_page)), "\n"),
    )


def paginate(documents: DataFrame, lines_per_page: int = 10, *carry: str) -> DataFrame:
    """doc_pages(doc_id, page_no, text), page numbers from 1."""
    return (
        documents.where(F.col("text").isNotNull())
        .select("doc_id", *carry, F.posexplode_outer(page_array(F.col("text"), lines_per_page)).alias("pos", "page_text"))
        .select("doc_id", (F.col("pos") + 1).cast("bigint").alias("page_no"), F.col("page_text").alias("text"), *carry)
    )


def page_count(text: Column, lines_per_page: int = 10) -> Column:
    return F.ceil(F.size(F.split(text, "\n", -1)) / lines_per_page).cast("bigint")


def visible_text(html: Column) -> Column:
    for p in (P.SCRIPT, P.STYLE, P.COMMENT, P.TAG):
        html = F.regexp_replace(html, p, " ")
    return squeeze(html)


def strip_tags(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, P.TAG, " "))


def _row(surface: str, page: int | None, field: Column, seq: Column, value: Column) -> Column:
    return F.struct(
        F.lit(page).cast("bigint").alias("page_no"),
        F.lit(surface).alias("surface"),
        field.alias("field"),
        seq.cast("bigint").alias("seq"),
        value.alias("value"),
    )


def _rows(surface: str, page: int | None, found: Column, field, value) -> Column:
    return F.transform(found, lambda m, i: _row(surface, page, field(m), i, value(m)))


def _attr_rows(surface: str, page: int | None, html: Column, names: str) -> Column:
    pattern = P.attribute(names)
    return _rows(
        surface, page, find_all(html, pattern),
        lambda m: F.lower(first_match(m, pattern, 1)),
        lambda m: matched_value(m, pattern),
    )


def scripts(html: Column, ld_json: bool) -> Column:
    """Whole script elements, either the linked-data ones or all others."""
    head = lambda m: first_match(m, P.SCRIPT, 1).rlike(P.LD_JSON)
    return F.filter(find_all(html, P.SCRIPT), (lambda m: head(m)) if ld_json else (lambda m: ~head(m)))


def named_meta(html: Column) -> Column:
    return F.filter(find_all(html, P.META), lambda m: attr_value(m, "name") != "")


def property_meta(html: Column) -> Column:
    return F.filter(find_all(html, P.META), lambda m: attr_value(m, "property") != "")


def embedded_names(html: Column) -> Column:
    """(field, value) of embedded parts: embed, object, download and data URIs."""
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    download = P.attribute("download")
    return F.concat(
        F.transform(find_all(html, P.EMBED), lambda m: pair("embed", attr_value(m, "src"))),
        F.transform(find_all(html, P.OBJECT), lambda m: pair("object", attr_value(m, "data"))),
        F.transform(find_all(html, download), lambda m: pair("download", matched_value(m, download))),
        F.transform(find_all(html, P.DATA_URI, 1), lambda m: pair("data", m)),
    )


@per_session
def surface_array(html_name: str = "html", url_name: str = "url") -> Column:
    html, url = F.col(html_name), F.col(url_name)
    const = lambda name: (lambda m: F.lit(name))
    one = lambda surface, page, field, value: F.array(_row(surface, page, F.lit(field), F.lit(0), value))
    lang = find_all(html, P.HTML_TAG)
    return F.concat(
        one("page_text", 1, "text", visible_text(html)),
        one("raw_content", 1, "html", html),
        _attr_rows("annotations", 1, html, "title|alt|aria-label"),
        _rows("annotations", 1, find_all(html, P.COMMENT, 1), const("comment"), lambda m: m),
        _rows("form_fields", 1, find_all(html, P.INPUT), lambda m: attr_value(m, "name"), lambda m: attr_value(m, "value")),
        _rows("form_fields", 1, find_all(html, P.TEXTAREA), const("textarea"), lambda m: first_match(m, P.TEXTAREA, 2)),
        _attr_rows("links", 1, html, "href|src"),
        _rows("docinfo", None, find_all(html, P.TITLE, 1), const("title"), lambda m: m),
        _rows("docinfo", None, lang, const("lang"), lambda m: attr_value(m, "lang")),
        _rows("docinfo", None, named_meta(html), lambda m: F.lower(attr_value(m, "name")), lambda m: attr_value(m, "content")),
        one("docinfo", None, "url", F.coalesce(url, F.lit(""))),
        _rows("xmp", None, scripts(html, True), const("ld+json"), lambda m: first_match(m, P.SCRIPT, 2)),
        _rows("xmp", None, property_meta(html), lambda m: F.lower(attr_value(m, "property")), lambda m: attr_value(m, "content")),
        _rows("bookmarks", None, find_all(html, P.HEADING),
              lambda m: F.concat(F.lit("h"), first_match(m, P.HEADING, 1)),
              lambda m: strip_tags(first_match(m, P.HEADING, 2))),
        F.transform(embedded_names(html), lambda e, i: _row("embedded_files", None, e["field"], i, e["value"])),
    )


def surfaces_from_html(pages: DataFrame) -> DataFrame:
    """surfaces(doc_id, pos, page_no, surface, field, seq, value).

    ``page_no`` is null for document-level surfaces, ``pos`` identifies a surface within its document
    and ``seq`` counts within one kind. The outer form keeps the optimiser from copying the array
    expression into a filter at the scan.
    """
    return (
        pages.where(F.col("html").isNotNull())
        .select(F.col("page_id").alias("doc_id"), F.posexplode_outer(surface_array()).alias("pos", "s"))
        .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "s.*")
    )

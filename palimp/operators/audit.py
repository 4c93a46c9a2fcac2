"""Privacy and security findings of web pages.

Every scanner is a column over one page, so a whole audit is one narrow pass: findings become an
array per page, and roll-ups over that array need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp import model
from palimp.functions import patterns as P
from palimp.functions.matching import slices
from palimp.functions.text import attr_value, domain_of, find_all, first_match
from palimp.session import per_session, ship_by_value
from palimp.sources.surfaces import embedded_names, named_meta, property_meta, scripts, strip_tags

ship_by_value(__name__)


def _no_items() -> Column:
    return F.array().cast("array<string>")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(model.UNKNOWN_RANK)
    for name, value in model.SEVERITY_RANK.items():
        rank = F.when(severity == name, F.lit(value)).otherwise(rank)
    return rank.cast("bigint")


def _finding(fid: str, count: Column, items: Column | None = None, severity: Column | None = None) -> Column:
    category, default, title = model.FINDINGS[fid]
    return F.struct(
        F.lit(fid).alias("id"),
        F.lit(category).alias("category"),
        (severity if severity is not None else F.lit(default)).alias("severity"),
        F.lit(title).alias("title"),
        F.coalesce(count.cast("bigint"), F.lit(0).cast("bigint")).alias("count"),
        (F.coalesce(items, _no_items()) if items is not None else _no_items()).alias("items"),
    )


def link_targets(html: Column) -> Column:
    """Non-blank anchor targets in page order."""
    return F.filter(F.transform(find_all(html, P.ANCHOR), lambda m: F.btrim(attr_value(m, "href"))), lambda u: u != "")


def resolve(uri: Column, url: Column) -> Column:
    """An absolute target stays; a relative one gets the page's scheme and host."""
    base = first_match(url, r"(?i)^(https?://[^ \t\r\n/?#]+)", 1)
    scheme = first_match(url, r"(?i)^(https?:)", 1)
    return (
        F.when(uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), uri)
        .when(uri.startswith("//"), F.concat(scheme, uri))
        .when(uri.startswith("/"), F.concat(base, uri))
        .otherwise(F.concat(base, F.lit("/"), uri))
    )


def _prefixed(label: str, values: Column, size: int = 80) -> Column:
    """Distinct values, then the part of each that is shown."""
    return F.transform(F.array_distinct(values), lambda v: F.concat(F.lit(label), F.substring(v, 1, size)))


@per_session
def _scan_columns() -> list[Column]:
    html, url = F.col("html"), F.col("url")
    host = first_match(url, r"(?i)^(https?://[^ \t\r\n/]+)", 1)
    titles = F.filter(F.transform(find_all(html, P.TITLE, 1), strip_tags), lambda v: v != "")
    metas = F.filter(named_meta(html), lambda m: F.btrim(attr_value(m, "content")) != "")
    return [
        F.col("page_id").alias("doc_id"),
        "url",
        "html",
        link_targets(html).alias("links"),
        F.concat(
            F.transform(titles, lambda v: F.concat(F.lit("Title: "), v)),
            F.transform(metas, lambda m: F.concat(
                attr_value(m, "name"), F.lit(": "), F.btrim(attr_value(m, "content")))),
        ).alias("info"),
        (F.size(scripts(html, True)) + F.size(property_meta(html))).alias("xmp"),
        F.transform(scripts(html, False), lambda m: F.btrim(first_match(m, P.SCRIPT, 2))).alias("code"),
        find_all(html, P.HANDLER, 1).alias("handlers"),
        find_all(html, P.META_REFRESH).alias("refresh"),
        F.filter(
            F.transform(find_all(html, P.IFRAME), lambda m: resolve(F.btrim(attr_value(m, "src")), url)),
            lambda u: u.rlike(r"(?i)^https?://") & (domain_of(u) != F.lower(host)),
        ).alias("frames"),
        F.filter(
            F.transform(find_all(html, P.FORM), lambda m: F.btrim(attr_value(m, "action"))), lambda v: v != ""
        ).alias("forms"),
        embedded_names(html).alias("parts"),
        F.size(find_all(html, P.FIELD)).alias("fields"),
        F.size(find_all(html, P.HIDDEN_BLOCK)).alias("layers"),
        html.rlike(P.HIDDEN_STYLE).cast("bigint").alias("invisible"),
    ]


def with_scans(pages: DataFrame) -> DataFrame:
    """Raw material of the scanners. Each stage is its own projection, so no pattern runs twice."""
    # Only web targets are links; script targets have their own finding.
    return pages.select(*_scan_columns()).withColumns({
        "js_links": F.filter("links", lambda u: u.rlike(P.JAVASCRIPT_URL)),
        "launch": F.filter("links", lambda u: u.rlike(P.LAUNCH_URL) & ~u.rlike(P.JAVASCRIPT_URL)),
        "web": F.transform(F.filter("links", lambda u: ~u.rlike(P.JAVASCRIPT_URL)), lambda u: resolve(u, F.col("url"))),
    })


@per_session
def finding_array() -> Column:
    """Findings from the columns of :func:`with_scans`."""
    c = F.col
    domains = F.array_distinct(F.transform("web", domain_of))
    plain = F.exists("web", lambda u: u.rlike(r"(?i)^http://"))
    scanned = F.array(
        _finding("meta.docinfo", F.size("info"), F.array_distinct("info")),
        _finding("meta.xmp", F.least(c("xmp"), F.lit(1))),
        _finding("scripts.js", F.size("code") + F.size("js_links"), 
            F.concat(_prefixed("script: ", c("code")), _prefixed("link: ", c("js_links")))),
        _finding("actions.launch", F.size("launch"), _prefixed("launch: ", c("launch"))),
        _finding("actions.autorun", F.size("handlers") + F.size("refresh"), F.array_distinct(F.concat(
            F.transform("handlers", lambda v: F.lower(v)), F.transform("refresh", lambda m: F.lit("refresh"))))),
        _finding("actions.remote", F.size("frames"), _prefixed("frame: ", c("frames"))),
        _finding("forms.submit", F.size("forms"), _prefixed("action: ", c("forms"))),
        _finding("links.uri", F.size("web"), domains, F.when(plain, F.lit("medium")).otherwise(F.lit("low"))),
        _finding("files.embedded", F.size("parts"), F.transform(
            F.array_distinct("parts"), lambda e: F.concat(e["field"], F.lit(": "), F.substring(e["value"], 1, 80)))),
        _finding("forms.acro", c("fields")),
        _finding("content.ocg", c("layers")),
        _finding("content.invisible_text", c("invisible")),
    )
    return F.filter(scanned, lambda f: f["count"] > 0)


def audit_pages(pages: DataFrame) -> DataFrame:
    """One row per page with ``findings ARRAY<STRUCT>`` in scanner order."""
    found = with_scans(pages).select("doc_id", F.col("html").isNull().alias("locked"), finding_array().alias("found"))
    clean = F.array(_finding("clean", F.lit(0)))
    locked = F.array(_finding("encryption.locked", F.lit(1)))
    return found.select("doc_id", F.when(F.col("locked"), locked)
                        .when(F.size("found") == 0, clean).otherwise(F.col("found")).alias("findings"))


def explode_findings(audited: DataFrame) -> DataFrame:
    """findings(doc_id, seq, id, category, severity, title, count, items).

    The array is never empty. The outer form keeps the optimiser from copying the whole scanner
    expression into a ``size(findings) > 0`` filter at the scan.
    """
    return audited.select("doc_id", F.posexplode_outer("findings").alias("pos", "f")).select(
        "doc_id", F.col("pos").cast("bigint").alias("seq"), "f.*")


#: Characters of a scanner's error that are kept.
ERROR_CHARS = 100
_FINDING = "struct<id: string, category: string, severity: string, title: string, count: bigint, items: array<string>>"


def audit_with_scanners(pages: DataFrame, scanners: dict[str, Callable[[str, str], list[dict]]]) -> DataFrame:
    """(doc_id, findings, errors): the audit together with a caller's scanners, each isolated.

    A scanner takes html and url and gives findings as dictionaries with id, category, severity, title, count and items. One
    that raises, or gives something else, loses its own findings of that page only; ``errors`` names it with its message.
    A page that has a finding of a scanner is not ``clean``. Pages without html are locked and not scanned.
    """
    fields = [("id", pa.string()), ("category", pa.string()), ("severity", pa.string()), ("title", pa.string()), ("count", pa.int64()), ("items", pa.list_(pa.string()))]
    found_type, error_type = pa.list_(pa.struct(fields)), pa.list_(pa.struct([("scanner", pa.string()), ("error", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, errors = [], []
            for html, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist()):
                mine, wrong = [], []
                for name, scanner in scanners.items() if html is not None else ():
                    try:
                        given = [{k: f[k] for k, _ in fields} for f in scanner(html, url)]
                        pa.array([given], found_type)
                        mine += given
                    except Exception as exc:
                        wrong.append({"scanner": name, "error": (str(exc) or type(exc).__name__)[:ERROR_CHARS]})
                found.append(mine)
                errors.append(wrong)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, found_type), pa.array(errors, error_type)], ["doc_id", "more", "errors"])

    kind = dict(pages.dtypes)["page_id"]
    audited = audit_pages(pages.select("page_id", "url", "html")).select("doc_id", "findings")
    extra = pages.select(F.col("page_id").alias("doc_id"), "html", "url").mapInArrow(
        scan, f"doc_id {kind}, more array<{_FINDING}>, errors array<struct<scanner: string, error: string>>")
    both = audited.join(extra, "doc_id")
    plain = F.when(F.size("more") > 0, F.filter("findings", lambda f: f["id"] != "clean")).otherwise(F.col("findings"))
    return both.select("doc_id", F.concat(plain.cast(f"array<{_FINDING}>"), "more").alias("findings"), "errors")


def dead_letters(audited: DataFrame) -> DataFrame:
    """(doc_id, scanner, error) of the scanners that failed, for a sink of their own."""
    return audited.select("doc_id", F.inline("errors"))


def severity_count_columns(findings: Column) -> list[Column]:
    def count(severity: str) -> Column:
        return F.size(F.filter(findings, lambda f: f["severity"] == severity)).cast("bigint").alias(severity)
    return [count(s) for s in model.SEVERITY_RANK]


def worst_severity(findings: Column) -> Column:
    """Worst severity of a findings array, ``info`` for an empty one."""
    worst = F.array_min(F.transform(findings, lambda f: F.struct(severity_rank(f["severity"]).alias("r"), f["severity"].alias("s"))))
    return F.coalesce(worst["s"], F.lit("info"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """The same counts for findings held as rows; partial aggregation keeps a hot document cheap."""
    return findings.groupBy("doc_id").agg(*[
        F.count_if(F.col("severity") == s).cast("bigint").alias(s) for s in model.SEVERITY_RANK])


def overall_risk(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Worst severity per document from finding rows; documents without any are ``info``."""
    worst = findings.groupBy("doc_id").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("worst"))
    return documents.join(worst, "doc_id", "left").select("doc_id", F.coalesce("worst", F.lit("info")).alias("risk"))


def with_clean(documents: DataFrame, scanner_outputs: list[DataFrame]) -> DataFrame:
    """Union of scanner rows, plus one ``clean`` row for each document that has none."""
    union = reduce(lambda a, b: a.unionByName(b), scanner_outputs)
    clean = documents.select("doc_id").join(union.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", _finding("clean", F.lit(0)).alias("f")).select("doc_id", "f.*")
    return union.unionByName(clean)


def scanner_rows(pages: DataFrame, ids: list[str]) -> DataFrame:
    """Finding rows of chosen scanners."""
    rows = explode_findings(audit_pages(pages))
    return rows.where(F.col("id").isin(ids)).drop("seq")


def ranked(findings: DataFrame) -> DataFrame:
    """Stable order of a document's findings, worst first; at most one row per finding id and document."""
    w = Window.partitionBy("doc_id").orderBy(severity_rank(F.col("severity")), "seq")
    return findings.withColumn("position", F.row_number().over(w).cast("bigint"))


def top_items(findings: DataFrame, limit: int = model.MAX_FINDING_ITEMS) -> DataFrame:
    """The first items of each finding as rows."""
    return findings.select("doc_id", "id", F.posexplode(F.slice("items", 1, limit)).alias("pos", "item")).select(
        "doc_id", "id", (F.col("pos") + 1).cast("bigint").alias("position"), "item")


def rollup_items(hits: DataFrame) -> DataFrame:
    """hits(doc_id, id, seq, item) to one row per finding: count and distinct items in first-seen order."""
    per_item = hits.groupBy("doc_id", "id", "item").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    first_seen = F.array_sort(F.collect_list(F.struct("seq", "item")))
    return per_item.groupBy("doc_id", "id").agg(
        F.sum("n").cast("bigint").alias("count"), F.transform(first_seen, lambda s: s["item"]).alias("items"))


def audit_report(audited: DataFrame) -> DataFrame:
    """Nested camelCase report per document."""
    f = F.col("findings")
    counts = F.struct(*severity_count_columns(f))
    return audited.select("doc_id", F.to_json(F.struct(
        F.col("doc_id").alias("docId"), worst_severity(f).alias("overallRisk"), counts.alias("counts"), f.alias("findings"),
    )).alias("report"))

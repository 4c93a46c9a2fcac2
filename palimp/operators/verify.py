"""Proof of redaction and sanitising: checks with evidence, failing where anything is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp import model
from palimp.functions.text import squeeze
from palimp.operators.redact import moved_regions, page_hits, redact_terms, redact_terms_and_regions, suppress_pages
from palimp.operators.terms import term_hits
from palimp.session import scratch_path


def evidence_from_hits(hits: DataFrame) -> DataFrame:
    """hits(doc_id, page_no, surface, field, term) to evidence rows; equal lines of two readers collapse."""
    page = F.when(F.col("page_no").isNull(), "document").otherwise(F.concat(F.lit("page "), F.col("page_no").cast("string")))
    line = F.concat(F.lit("'"), "term", F.lit("' in "), "field", F.lit(" on "), page)
    return hits.select("doc_id", F.concat(F.lit("redaction."), "surface").alias("check_id"), "page_no", line.alias("line")).distinct()


def checks(docs: DataFrame, check_ids: list[str], evidence: DataFrame) -> DataFrame:
    """Every document gets every check; a check passes when it has no evidence.

    Evidence of one check is bounded by the document's own content.
    """
    wanted = docs.select("doc_id", F.explode(F.array(*[F.lit(c) for c in check_ids])).alias("check_id"))
    found = evidence.groupBy("doc_id", "check_id").agg(
        F.sort_array(F.collect_set("line")).alias("evidence"), F.sort_array(F.collect_set("page_no")).alias("pages"),
        F.bool_or(F.col("page_no").isNull()).alias("is_document_level"))
    j = wanted.join(found, ["doc_id", "check_id"], "left")
    return j.select(
        "doc_id", "check_id", F.col("evidence").isNull().alias("passed"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        F.coalesce("pages", F.array().cast("array<bigint>")).alias("pages"),
        F.coalesce("is_document_level", F.lit(False)).alias("is_document_level"))


def verified_docs(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Verified means that at least one check ran and all passed."""
    per_doc = results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ran"), F.bool_and("passed").alias("ok"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("ran", F.lit(0)).alias("checks_run"), F.coalesce(F.col("ok") & (F.col("ran") > 0), F.lit(False)).alias("verified"))


def suppression_targets(results: DataFrame) -> DataFrame:
    """Pages to suppress per document; null if nothing failed or a failure cannot be placed on a page."""
    failed = ~F.col("passed")
    agg = results.groupBy("doc_id").agg(
        F.bool_or(failed).alias("any"), F.bool_or(failed & (F.col("is_document_level") | (F.size("pages") == 0))).alias("stuck"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(failed, F.col("pages")))))).alias("p"))
    return agg.select("doc_id", F.when(F.col("any") & ~F.col("stuck"), F.col("p")).alias("pages"))


def fallback_evidence(page_hits_: DataFrame, doc_hits: DataFrame) -> DataFrame:
    """A document-level hit is reported only for terms no page hit has located."""
    located = page_hits_.select("doc_id", "term").distinct()
    return page_hits_.unionByName(doc_hits.join(located, ["doc_id", "term"], "left_anti"))


def region_checks(regions: DataFrame, doc_pages: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Each region must hold no text; what cannot be checked fails."""
    j = (regions.join(page_counts, "doc_id", "left").join(doc_pages, ["doc_id", "page_no"], "left"))
    s, e = F.col("s"), F.col("e")
    found = squeeze(F.substring("text", (s + 1).cast("int"), (e - s).cast("int")))
    status = (F.when(F.col("page_no").isNull() | s.isNull() | e.isNull(), "malformed")
              .when(F.col("n_pages").isNull() | (F.col("page_no") < 1) | (F.col("page_no") > F.col("n_pages")), "out_of_range")
              .when((s < 0) | (e > F.coalesce(F.length("text"), e)) | (s >= e), "invalid")
              .when(F.col("text").isNull(), "unreadable")
              .when(found != "", "text_found").otherwise("clean"))
    return j.select("doc_id", "page_no", "s", "e", status.alias("status")
                    , F.when(status == "text_found", F.substring(found, 1, 60)).otherwise("").alias("preview")
                    , (status == "clean").alias("passed"))


def region_results(checked: DataFrame) -> DataFrame:
    """Rows of :func:`region_checks` as one ``redaction.region`` check per document that has a region."""
    failed = ~F.col("passed")
    line = F.concat_ws(" ", F.lit("region"), F.coalesce(F.col("s").cast("string"), F.lit("?")), F.lit("to"), F.coalesce(F.col("e").cast("string"), F.lit("?")), F.lit("is"), "status")
    return checked.groupBy("doc_id").agg(
        F.bool_and("passed").alias("passed"), F.sort_array(F.collect_set(F.when(failed, line))).alias("evidence"),
        F.sort_array(F.collect_set(F.when(failed, F.col("page_no")))).alias("pages"), F.bool_or(failed & F.col("page_no").isNull()).alias("is_document_level"),
    ).select("doc_id", F.lit("redaction.region").alias("check_id"), "passed", "evidence", "pages", "is_document_level")


def dual_reader_hits(surfaces: DataFrame, terms: DataFrame, **kw) -> DataFrame:
    """Hits of two independent readers of one page, the visible text and the raw content, reported once."""
    both = surfaces.where(F.col("surface").isin("page_text", "raw_content"))
    return term_hits(both, ["doc_id", "page_no"], terms, **kw).select("doc_id", "page_no", "term").distinct()


def unreadable(docs: DataFrame, read: DataFrame) -> DataFrame:
    """A failed ``redaction.readable`` for each document that has no row in read(doc_id, ok) or one that is not ok."""
    seen = read.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"))
    return docs.select("doc_id").join(seen, "doc_id", "left").where(~F.coalesce("ok", F.lit(False))).select(
        "doc_id", F.lit("redaction.readable").alias("check_id"), F.lit(False).alias("passed"), F.array(F.lit("cannot be read")).alias("evidence"),
        F.array().cast("array<bigint>").alias("pages"), F.lit(True).alias("is_document_level"))


def verify_pages(doc_pages: DataFrame, docs: DataFrame, terms: DataFrame, **kw) -> DataFrame:
    """Checks of the page text of written output. A document without pages, or with a page without text, fails."""
    hits = page_hits(doc_pages, terms, **kw).select("doc_id", "page_no", F.lit("page_text").alias("surface"), F.lit("text").alias("field"), "term")
    read = doc_pages.select("doc_id", F.col("text").isNotNull().alias("ok"))
    return checks(docs, ["redaction.page_text"], evidence_from_hits(hits)).unionByName(unreadable(docs, read))


def verify_surfaces(surfaces: DataFrame, docs: DataFrame, terms: DataFrame, **kw) -> DataFrame:
    """The nine surface checks of written output. A document of which no surface could be read fails."""
    keyed = surfaces.select("doc_id", "pos", "page_no", "surface", "field", "value")
    hits = term_hits(keyed, ["doc_id", "pos", "page_no", "field"], terms, **kw)
    read = surfaces.select("doc_id", ((F.col("surface") != "raw_content") | F.col("value").isNotNull()).alias("ok"))
    return checks(docs, ["redaction." + s for s in model.SURFACES], evidence_from_hits(hits)).unionByName(unreadable(docs, read))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: verification must see what was written, not the plan."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def fail_closed_release(doc_pages: DataFrame, docs: DataFrame, terms: DataFrame, pages: list[int] | None = None,
                        suppress: bool = False, regions: DataFrame | None = None, fold_proof: bool = False, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Redact, write, verify the written pages, then split: (released pages, quarantined pages, report).

    With ``fold_proof`` the proof is case-insensitive even where the removal was told to keep to the case.

    With ``suppress`` the pages that failed lose their whole text and are verified once more. With ``regions`` these are blanked
    as well, and where they lie in the written pages must hold no text; the region checks count like those of the terms.
    """
    proof = {k: v for k, v in kw.items() if k != "case_sensitive" or not fold_proof}
    if regions is None:
        staged = stage(redact_terms(doc_pages, terms, pages=pages, **kw), "staged")
        results = verify_pages(staged, docs, terms, **proof)
    else:
        staged = stage(redact_terms_and_regions(doc_pages, terms, regions, **kw), "staged")
        n_pages = staged.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))
        checked = region_checks(moved_regions(regions, staged), staged.select("doc_id", "page_no", "text"), n_pages)
        results = verify_pages(staged, docs, terms, **proof).unionByName(region_results(checked))
    hits = staged.groupBy("doc_id").agg(F.sum("hits").alias("hits"))
    if suppress:
        targets = suppression_targets(results).select("doc_id", F.explode("pages").alias("page_no"))
        cleared = suppress_pages(staged.select("doc_id", "page_no", "text"), targets)
        staged = stage(cleared, "suppressed")
        results = verify_pages(staged, docs, terms, **proof)
    failed = results.where(~F.col("passed")).groupBy("doc_id").agg(F.sort_array(F.collect_set("check_id")).alias("failed"))
    report = verified_docs(docs, results).join(hits, "doc_id", "left").join(failed, "doc_id", "left").select(
        "doc_id", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), "verified",
        F.when(~F.col("verified"), "quarantined").when(F.coalesce("hits", F.lit(0)) == 0, "no_match").otherwise("released").alias("status"),
        F.coalesce("failed", F.array().cast("array<string>")).alias("failed"))
    report = stage(report, "report")
    text = staged.select("doc_id", "page_no", "text")
    released = text.join(report.where("status = 'released'"), "doc_id", "left_semi")
    quarantined = text.join(report.where("status = 'quarantined'"), "doc_id", "left_semi")
    return released, quarantined, report


def promise_checks(docs: DataFrame, findings: DataFrame, options: dict[str, bool]) -> DataFrame:
    """For each enabled switch its findings must be gone; a document that cannot be read fails outright."""
    promised = [(o, f) for o, (_, fs) in model.SANITIZE_SWITCHES.items() if options[o] for f in fs]
    locked = findings.where("id = 'encryption.locked'").select("doc_id").distinct()
    readable = docs.select("doc_id").join(locked, "doc_id", "left_anti")
    wanted = readable.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(o).alias("option"), F.lit(f).alias("id")) for o, f in promised])).alias("p")).select("doc_id", "p.*")
    present = findings.select("doc_id", "id", F.col("items").alias("evidence"))
    done = wanted.join(present, ["doc_id", "id"], "left").select(
        "doc_id", F.concat(F.lit("sanitization."), "option", F.lit("."), "id").alias("check_id"), F.col("evidence").isNull().alias("passed"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    unreadable = locked.select("doc_id", F.lit("sanitization.readable").alias("check_id"), F.lit(False).alias("passed"),
                               F.array(F.lit("cannot be read")).alias("evidence"))
    return done.unionByName(unreadable)


def decoded(html: Column) -> Column:
    """The page with character references to ASCII, and to the marks that part a scheme, as plain characters."""
    refs = F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});?"), F.lit(0)))
    digits = lambda r: F.regexp_extract(r, "(?i)&#x?([0-9a-f]+)", 1)
    code = lambda r: F.when(F.lower(F.substring(r, 3, 1)) == "x", F.conv(digits(r), 16, 10)).otherwise(digits(r)).cast("bigint")
    ascii_ = F.filter(F.transform(refs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("ref"), code(r).alias("code"))), lambda r: r["code"] < 128)
    plain = F.aggregate(F.array_sort(ascii_), html, lambda acc, r: F.replace(acc, r["ref"], F.char(r["code"])))
    for name, char in (("colon", ":"), ("tab", " "), ("newline", " "), ("sol", "/")):
        plain = F.regexp_replace(plain, f"(?i)&{name};", char)
    return plain


_B = r"[\x00-\x20]*"
_JS = _B.join("javascript") + _B + ":"
_SHOWN = "alt|title|content|value|placeholder|label|aria-label"  # shown, not followed
#: Loose signs of what a sanitised page must not hold, looked for in the decoded page. They share nothing with the removal.
ACTIVE_SIGNS = {
    "scripts.js": [r"(?i)<script(?![^>]*application/ld\+json)[^>]{0,40}", rf"(?i)<[a-z][^<]*[\s/\"'](?!(?:{_SHOWN})\s*=)[a-z:_-]+\s*=[\s\"']*{_JS}"],
    "actions.launch": [rf"(?i)<[a-z][^<]*[\s/\"']href\s*=[\s\"']*{_B}file:"],
    "actions.autorun": [r"(?i)<[a-z][^<]*[\s/\"'](on[a-z]+)\s*=", r"(?i)<meta[^>]*http-equiv\s*=[\s\"']*refresh"],
    "forms.submit": [r"(?i)<form[^<]*[\s/\"']action\s*=", r"(?i)<[a-z][^<]*[\s/\"']formaction\s*="],
    "files.embedded": [r"(?i)<(?:embed|object)[\s/>]", r"(?i)<[a-z][^<]*[\s/\"']download\s*=", rf"(?i)<[a-z][^<]*[\s/\"'](?:href|src|data)\s*=[\s\"']*{_B}data:"],
    "links.uri": [r"(?i)<a[\s/][^>]*href\s*="],
}


def active_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, id, items): the loose signs of each finding in pages(page_id, html)."""
    page = pages.select(F.col("page_id").alias("doc_id"), decoded(F.col("html")).alias("page"))
    signs = [F.struct(F.lit(fid).alias("id"), F.filter(F.array(*[F.regexp_extract("page", p, 0) for p in ps]), lambda m: m != "").alias("items"))
             for fid, ps in ACTIVE_SIGNS.items()]
    return page.select("doc_id", F.inline(F.array(*signs))).where(F.size("items") > 0)


def sanitization_findings(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the audit together with the loose signs, one row per (doc_id, id)."""
    both = findings.select("doc_id", "id", "items").unionByName(active_evidence(pages))
    return both.groupBy("doc_id", "id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def residual_findings(findings: DataFrame, options: dict[str, bool]) -> DataFrame:
    """Findings outside the promised set, ``clean`` excepted."""
    promised = [f for o, (_, fs) in model.SANITIZE_SWITCHES.items() if options[o] for f in fs]
    return findings.where(~F.col("id").isin([*promised, "clean"]))

"""Audit of web pages: findings, roll-ups and rankings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from palimp import model
from palimp.functions import patterns as P
from palimp.functions.text import attr_value, domain_of, find_all, first_match
from palimp.operators import audit
from palimp.plans import base
from palimp.plans.base import FINDINGS, RANK, attr, lit, query
from palimp.sources.surfaces import strip_tags, surfaces_from_html
from palimp.session import ship_by_value
from palimp.sources.tables import table

_COUNTS = ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in ("high", "medium", "low", "info"))
_RISK = "case min(" + RANK + ") when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'info' end"

ship_by_value(__name__)


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _joined(items):
    return F.array_join(items, " | ")


@query("audit_overview", f"with {FINDINGS} select doc_id, {_RISK} as risk, {_COUNTS} from findings group by doc_id")
def audit_overview(spark, sf_dir):
    f = F.col("findings")
    return audit.audit_pages(_pages(spark, sf_dir)).select(
        "doc_id", audit.worst_severity(f).alias("risk"), *audit.severity_count_columns(f))


@query("audit_documents", f"with {FINDINGS} select doc_id, seq, id, category, severity, title, count, array_to_string(items, ' | ') as items from findings")
def audit_documents(spark, sf_dir):
    return audit.explode_findings(audit.audit_pages(_pages(spark, sf_dir))).withColumn("items", _joined("items"))


@query("severity_counts", f"with {FINDINGS} select doc_id, {_COUNTS} from findings group by doc_id")
def severity_counts(spark, sf_dir):
    return audit.severity_counts(audit.explode_findings(audit.audit_pages(_pages(spark, sf_dir))))


@query("overall_risk", f"with {FINDINGS} select doc_id, {_RISK} as risk from findings group by doc_id")
def overall_risk(spark, sf_dir):
    f = F.col("findings")
    return audit.audit_pages(_pages(spark, sf_dir)).select("doc_id", audit.worst_severity(f).alias("risk"))


@query("finding_rollup", f"""with {base.SURFACES}, hits as (
 select doc_id, concat('link.', field) as id, seq, value as item from surfaces where surface = 'links' and value <> ''),
 per_item as (select doc_id, id, item, min(seq) as seq, count(*) as n from hits group by all)
 select doc_id, id, cast(sum(n) as bigint) as count, string_agg(item, ' | ' order by seq, item) as items from per_item group by doc_id, id""")
def finding_rollup(spark, sf_dir):
    s = surfaces_from_html(_pages(spark, sf_dir)).where("surface = 'links' and value <> ''")
    hits = s.select("doc_id", F.concat(F.lit("link."), "field").alias("id"), "seq", F.col("value").alias("item"))
    return audit.rollup_items(hits).withColumn("items", _joined("items"))


@query("link_domains", f"""with {FINDINGS} select doc_id, severity, count, array_to_string(items, ' | ') as domains,
 cast(len(items) as bigint) as n_domains from findings where id = 'links.uri'""")
def link_domains(spark, sf_dir):
    rows = audit.scanner_rows(_pages(spark, sf_dir), ["links.uri"])
    return rows.select("doc_id", "severity", "count", _joined("items").alias("domains"), F.size("items").cast("bigint").alias("n_domains"))


@query("hidden_text_pages", f"""select page_id as doc_id, cast(regexp_matches(html, {lit(P.HIDDEN_STYLE)}) as bigint) as pages, cast(len(regexp_extract_all(html, {lit(P.HIDDEN_STYLE)})) as bigint) as hits
 from pages where html is not null""")
def hidden_text_pages(spark, sf_dir):
    """Per document, the pages with hidden text, one at most for a web page, and how often it is hidden."""
    hits = F.regexp_count("html", F.lit(P.HIDDEN_STYLE)).cast("bigint")
    return _pages(spark, sf_dir).where("html is not null").select(F.col("page_id").alias("doc_id"), (hits > 0).cast("bigint").alias("pages"), hits.alias("hits"))


@query("findings_ranked", f"with {FINDINGS} select doc_id, id, severity, row_number() over (partition by doc_id order by {RANK}, seq) as position from findings")
def findings_ranked(spark, sf_dir):
    return audit.ranked(audit.explode_findings(audit.audit_pages(_pages(spark, sf_dir)))).select("doc_id", "id", "severity", "position")


@query("top_items", f"""with {FINDINGS} select doc_id, id, cast(i as bigint) as position, items[i] as item
 from (select doc_id, id, items, unnest(range(1, least(len(items), 50) + 1)) as i from findings)""")
def top_items(spark, sf_dir):
    return audit.top_items(audit.explode_findings(audit.audit_pages(_pages(spark, sf_dir))))


@query("union_findings", f"""with {FINDINGS}, picked as (select doc_id, id, severity, count from findings where id <> 'clean')
 select * from picked union all select page_id, 'clean', 'info', 0 from pages where page_id not in (select doc_id from picked)""")
def union_findings(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rows = audit.scanner_rows(pages, [i for i in model.FINDINGS if i != "clean"])
    outputs = [rows.where("id = 'links.uri'"), rows.where("id <> 'links.uri'")]
    docs = pages.select(F.col("page_id").alias("doc_id"))
    return audit.with_clean(docs, outputs).select("doc_id", "id", "severity", "count")


@query("audit_report_json", f"""with {FINDINGS}, per_doc as (
 select doc_id, {_RISK} as risk, {_COUNTS},
  list({{'id': id, 'category': category, 'severity': severity, 'title': title, 'count': count, 'items': items}} order by seq) as fs
 from findings group by doc_id)
 select doc_id, cast(len(fs) as bigint) as n, risk, (select string_agg(concat(f.id, '=', f.count), ',') from (select unnest(fs) as f)) as listed from per_doc""")
def audit_report_json(spark, sf_dir):
    report = audit.audit_report(audit.audit_pages(_pages(spark, sf_dir)))
    schema = "docId bigint, overallRisk string, findings array<struct<id string, count bigint>>"
    r = report.select("doc_id", F.from_json("report", schema).alias("r"))
    listed = F.array_join(F.transform("r.findings", lambda f: F.concat(f["id"], F.lit("="), f["count"].cast("string"))), ",")
    return r.select("doc_id", F.size("r.findings").cast("bigint").alias("n"), F.col("r.overallRisk").alias("risk"), listed.alias("listed"))


_FIELDS = ["title", "author", "subject", "keywords", "creator", "producer"]


def metadata_columns(html):
    """Six named fields; a missing one is ''."""
    metas = find_all(html, P.META)

    def named(name):
        hit = F.filter(metas, lambda m: F.lower(attr_value(m, "name")) == name)
        return F.coalesce(attr_value(F.get(hit, F.lit(0)), "content"), F.lit("")).alias(name)

    return [strip_tags(first_match(html, P.TITLE, 1)).alias("title"), *[named(n) for n in _FIELDS[1:]]]


_METAS = f"regexp_extract_all(html, {lit(P.META)})"
def _named_meta(name):
    return f"list_filter({_METAS}, lambda m: lower({attr('m', 'name')}) = {lit(name)})[1]"


META_SQL = "select page_id as doc_id, " + base.strip_tags(f"regexp_extract(html, {lit(P.TITLE)}, 1)") + " as title, " + ", ".join(
    f"coalesce({attr(_named_meta(n), 'content')}, '') as {n}"
    for n in _FIELDS[1:]) + " from pages"


@query("doc_metadata", META_SQL)
def doc_metadata(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), *metadata_columns(F.col("html")))


@query("domain_of", f"select page_id as doc_id, {base.domain_of('url')} as domain, {base.domain_of('html')} as head from pages")
def domain(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), domain_of(F.col("url")).alias("domain"), domain_of(F.col("html")).alias("head"))


def ad_slot(html, url):
    """A caller's scanner: the slot of a page's advertisement. Slots of odd number make it fail."""
    found = re.search("<!-- ad ([0-9]+) -->", html)
    if found is None:
        raise LookupError("no slot")
    if int(found[1]) % 2:
        raise ValueError(f"slot {found[1]} is reserved")
    return [{"id": "page.ad", "category": "content", "severity": "info", "title": "Advertisement", "count": 1, "items": [found[1]]}]


def path_words(html, url):
    """A caller's scanner that gives nothing for a page whose address has no path."""
    words = [w for w in url.split("/")[3:] if w]
    return [{"id": "page.path", "category": "content", "severity": "info", "title": "Path", "count": len(words), "items": words}] if words else []


_SLOT = "regexp_extract(html, '<!-- ad ([0-9]+) -->', 1)"


@query("audit_isolated_scanners", f"""with {FINDINGS}, pathed as (select page_id, len(list_filter(string_split(url, '/')[4:], lambda w: w <> '')) > 0 as pathed, {_SLOT} as slot, html from pages),
 ids as (select doc_id, id from findings where id <> 'clean' union all select page_id, 'page.path' from pathed where pathed and html is not null
  union all select page_id, 'page.ad' from pathed where slot <> '' and cast(slot as bigint) % 2 = 0)
 select page_id as doc_id, coalesce((select string_agg(id, ',' order by id) from ids where ids.doc_id = page_id), 'clean') as ids,
  case when slot = '' then 'ad_slot: no slot' when cast(slot as bigint) % 2 = 1 then concat('ad_slot: slot ', slot, ' is reserved') else '' end as errors from pathed""")
def audit_isolated_scanners(spark, sf_dir):
    """The audit with two scanners of a caller, one of which raises on many pages."""
    out = audit.audit_with_scanners(table(spark, sf_dir, "pages"), {"ad_slot": ad_slot, "path_words": path_words})
    ids = F.array_join(F.sort_array(F.transform("findings", lambda f: f["id"])), ",")
    return out.select("doc_id", ids.alias("ids"), F.array_join(F.transform("errors", lambda e: F.concat(e["scanner"], F.lit(": "), e["error"])), "; ").alias("errors"))

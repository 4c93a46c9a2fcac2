"""Redaction and its proof over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp import model
from palimp.functions import patterns as P
from palimp.functions.text import find_all
from palimp.operators import audit, redact, verify, web
from palimp.operators.terms import distinct_pieces, term_hits
from palimp.plans.base import DOC_PAGES, FINDINGS, ORACLES, SURFACES, lit, query
from palimp.plans.page_queries import doc_pages, docs, sized
from palimp.sources.surfaces import surfaces_from_html
from palimp.sources.tables import table

# Searched words besides the addresses found in the documents.
FIXED_TERMS = ["the", "token", "License"]
_TERMS = (f"terms as (select distinct unnest(regexp_extract_all(text, '{P.EMAIL}')) as term from documents union select unnest({FIXED_TERMS}))")
_ALPHA = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def terms(spark, sf_dir):
    """Addresses in the documents and fixed words, written once so that no later job scans for them again."""
    # The cheap test spares most texts the pattern.
    texts = docs(spark, sf_dir).where(F.contains("text", F.lit("@")))
    found = texts.select(F.explode_outer(find_all(F.col("text"), P.EMAIL)).alias("term")).where("term is not null")
    fixed = spark.createDataFrame([(t,) for t in FIXED_TERMS], "term string")
    return verify.stage(found.unionByName(fixed).distinct(), "terms")


def surfaces(spark, sf_dir):
    return surfaces_from_html(table(spark, sf_dir, "pages"))


def doc_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id")


def page_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))


_SQ = "trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"
_PAGE_HITS = f"""{DOC_PAGES}, {_TERMS}, page_hits as (select doc_id, page_no, term from doc_pages join terms on contains(lower({_SQ}), lower(term)))"""
_SURFACE_HITS = f"""{SURFACES}, {_TERMS}, surface_hits as (select doc_id, page_no, surface, field, seq, term from surfaces join terms on
 case when surface = 'raw_content' then contains(translate(value, {_ALPHA}), translate(term, {_ALPHA})) else contains(lower(value), lower(term)) end)"""


@query("term_surface_match", f"""with {_SURFACE_HITS}, {DOC_PAGES} select 'pages' as corpus, doc_id, page_no, surface, field, seq, term from surface_hits where surface <> 'raw_content'
 union all select 'documents', doc_id, page_no, 'page_text', 'text', 0, term from doc_pages join terms on contains(lower({_SQ}), lower(term))""")
def term_surface_match(spark, sf_dir, **kw):
    t = terms(spark, sf_dir)
    web = surfaces(spark, sf_dir).where("surface <> 'raw_content'")
    a = term_hits(web, ["doc_id", "pos", "page_no", "field", "seq"], t, **kw).drop("pos").withColumn("corpus", F.lit("pages"))
    plain = redact.page_surfaces(doc_pages(spark, sf_dir)).withColumn("field", F.lit("text")).withColumn("seq", F.lit(0).cast("bigint"))
    b = term_hits(plain, ["doc_id", "page_no", "field", "seq"], t, **kw).withColumn("corpus", F.lit("documents"))
    return a.unionByName(b).select("corpus", "doc_id", "page_no", "surface", "field", "seq", "term")


@query("raw_content_match", f"""with {_TERMS} select page_id as doc_id, term from pages join terms on contains(translate(html, {_ALPHA}), translate(term, {_ALPHA}))""")
def raw_content_match(spark, sf_dir, **kw):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("raw_content").alias("surface"), F.col("html").alias("value"))
    return term_hits(rows, ["doc_id"], terms(spark, sf_dir), **kw).select("doc_id", "term")


_ESC = "concat('(?i)', regexp_replace(term, '([.+*?^$|(){}\\[\\]\\\\])', '\\\\\\1', 'g'))"
# Counted on the original, replaced longest first.
_REDACTED = f"""{_PAGE_HITS}, todo as (select doc_id, page_no, list({_ESC} order by length(term) desc, term) as ps from page_hits group by doc_id, page_no),
 redacted as (select p.doc_id, p.page_no, p.text as original, case when ps is null then p.text else list_reduce(ps, lambda acc, x: regexp_replace(acc, x, '█', 'g'), p.text) end as text,
  case when ps is null then 0 else list_sum(list_transform(ps, lambda x: len(regexp_extract_all(p.text, x)))) end as hits from doc_pages p left join todo t on p.doc_id = t.doc_id and p.page_no = t.page_no)"""
_ALL_PAGES = _REDACTED
# Terms still found on the written pages.
_LEFT = f"{_ALL_PAGES}, still as (select doc_id, page_no, term from redacted join terms on contains(lower({_SQ}), lower(term)))"
_CHECKS = f"""{_LEFT}, checks as (select d.doc_id, 'redaction.page_text' as check_id, count(s.term) = 0 as passed,
  string_agg(concat('''', term, ''' in text on page ', page_no), ' | ' order by concat('''', term, ''' in text on page ', page_no)) filter (term is not null) as evidence, list_sort(list(distinct page_no) filter (page_no is not null)) as pages from documents d left join still s on d.doc_id = s.doc_id group by d.doc_id)"""


@query("redact_terms", f"with {_ALL_PAGES} select doc_id, page_no, text, cast(hits as bigint) as hits from redacted")
def redact_terms(spark, sf_dir, **kw):
    return redact.redact_terms(doc_pages(spark, sf_dir), terms(spark, sf_dir), **kw)


@query("surface_hit_counts", f"""with {_SURFACE_HITS} select doc_id, surface, count(*) as hits, count(distinct page_no) as pages from surface_hits group by doc_id, surface""")
def surface_hit_counts(spark, sf_dir):
    hits = term_hits(surfaces(spark, sf_dir), ["doc_id", "pos", "page_no"], terms(spark, sf_dir))
    return redact.hit_counts(hits)


_SCRUB = f"""{_SURFACE_HITS}, hit_rows as (select distinct doc_id, surface, field, seq from surface_hits where surface not in ('page_text', 'raw_content')),
 marked as (select s.*, h.doc_id is not null as hit, exists (select 1 from hit_rows w where w.doc_id = s.doc_id and w.surface = s.surface) as any_hit from surfaces s left join hit_rows h
  on s.doc_id = h.doc_id and s.surface = h.surface and s.field = h.field and s.seq = h.seq where s.surface not in ('page_text', 'raw_content'))"""


@query("scrub_surfaces", f"""with {_SCRUB} select doc_id, surface, field, seq, case when hit and surface = 'bookmarks' then '[redacted]' when hit and surface = 'form_fields' then '' else value end as value
 from marked where case when surface in ('docinfo', 'xmp') then not any_hit else not hit or surface in ('bookmarks', 'form_fields') end""")
def scrub_surfaces(spark, sf_dir):
    return redact.scrub_surfaces(surfaces(spark, sf_dir), terms(spark, sf_dir)).where("kept").select("doc_id", "surface", "field", "seq", "value")


@query("scrub_counts", f"with {_SCRUB} select doc_id, surface, case when surface = 'xmp' then 1 else count(*) end as removed from marked where hit group by doc_id, surface")
def scrub_counts(spark, sf_dir):
    return redact.removal_counts(redact.scrub_surfaces(surfaces(spark, sf_dir), terms(spark, sf_dir)))


# Phrases: every tenth-length piece of the documents, hundreds of thousands of terms already on small tables.
PHRASE = 10


def phrases(spark, sf_dir):
    """The distinct pieces of ten characters that begin at every fourth character of the documents, in small letters."""
    return distinct_pieces(docs(spark, sf_dir).select(F.lower("text").alias("text")), PHRASE, 4)


_PHRASES = f"""pieces as (select distinct substr(t, i, {PHRASE}) as term from (select lower(text) as t, unnest(range(1, length(text) - {PHRASE} + 2, 4)) as i from documents)),
 phrases as (select term from pieces where not regexp_matches(term, '^[ \\t\\r\\n]|[ \\t\\r\\n]$|[ \\t\\r\\n][ \\t\\r\\n]|\u00df')),
 windows as (select distinct conv_id, turn, substr(t, i, {PHRASE}) as term from (select conv_id, turn, t, unnest(range(1, length(t) - {PHRASE} + 2)) as i from (select conv_id, turn, replace(lower(text), '\u00df', 'ss') as t from conversations)))"""


@query("phrase_match", f"with {_PHRASES} select conv_id, turn, cast(count(*) as bigint) as phrases, md5(string_agg(term, chr(10) order by term)) as terms_hash from windows join phrases using (term) group by conv_id, turn")
def phrase_match(spark, sf_dir, **kw):
    """Which of the documents' phrases each message holds: very many terms, found as substrings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("message").alias("surface"), F.col("text").alias("value"))
    hits = term_hits(rows, ["conv_id", "turn"], phrases(spark, sf_dir), **kw)
    # The phrases of one message, bounded by its length.
    return hits.groupBy("conv_id", "turn").agg(F.count("*").alias("phrases"), F.md5(F.array_join(F.sort_array(F.collect_list("term")), "\n")).alias("terms_hash"))


# --- regions --------------------------------------------------------------------------------------

# Two regions per document: valid, malformed, out of range, inverted and overlapping ones all occur.
_REGIONS = """regions as (select doc_id, cast(doc_id % 3 + 1 as bigint) as page_no, case when doc_id % 11 <> 0 then cast(doc_id % 60 - 5 as bigint) end as s, cast(doc_id % 60 - 5 + (doc_id % 7) * 10 - 5 as bigint) as e from documents
 union all select doc_id, 1, cast(doc_id % 40 as bigint), cast(doc_id % 40 + 25 as bigint) from documents)"""


def regions(spark, sf_dir):
    d = docs(spark, sf_dir)
    i = F.col("doc_id")
    start = i % 60 - 5
    first = d.select("doc_id", (i % 3 + 1).alias("page_no"), F.when(i % 11 != 0, start).alias("s"), (start + (i % 7) * 10 - 5).alias("e"))
    second = d.select("doc_id", F.lit(1).cast("bigint").alias("page_no"), (i % 40).alias("s"), (i % 40 + 25).alias("e"))
    return first.unionByName(second)


_REGION_CHECK = """case when r.s is null then 'malformed' when r.page_no > c.n then 'out_of_range' when r.s < 0 or r.e > length(p.text) or r.s >= r.e then 'invalid'
  when trim(regexp_replace(substr(p.text, r.s + 1, r.e - r.s), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) <> '' then 'text_found' else 'clean' end"""


def _region_sql(pages):
    return f"""counts as (select doc_id, max(page_no) as n from doc_pages group by doc_id), checked as (select r.doc_id, r.page_no, r.s, r.e, {_REGION_CHECK} as status,
  substr(trim(regexp_replace(substr(p.text, r.s + 1, r.e - r.s), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')), 1, 60) as found from regions r join counts c on r.doc_id = c.doc_id left join {pages} p on r.doc_id = p.doc_id and r.page_no = p.page_no)
 select doc_id, page_no, s, e, status, case when status = 'text_found' then found else '' end as preview, status = 'clean' as passed from checked"""


@query("region_checks", f"with {DOC_PAGES}, {_REGIONS}, {_region_sql('doc_pages')}")
def region_checks(spark, sf_dir):
    return verify.region_checks(regions(spark, sf_dir), doc_pages(spark, sf_dir), sized(spark, sf_dir))


_BLANKED = f"""{DOC_PAGES}, {_REGIONS}, valid as (select p.doc_id, p.page_no, list(distinct {{'s': s, 'e': e}}) as spans from doc_pages p join regions r on p.doc_id = r.doc_id and p.page_no = r.page_no
  where s >= 0 and e <= length(text) and s < e group by all),
 blanked as (select p.doc_id, p.page_no, case when spans is null then p.text else list_reduce(spans, lambda acc, r: concat(substr(acc, 1, r.s), repeat(' ', r.e - r.s), substr(acc, r.e + 1)), p.text) end as text, coalesce(len(spans), 0) as regions
  from doc_pages p left join valid v on p.doc_id = v.doc_id and p.page_no = v.page_no)"""
_BLANKED = _BLANKED.replace("list_reduce(spans, lambda acc, r: concat(substr(acc, 1, r.s), repeat(' ', r.e - r.s), substr(acc, r.e + 1)), p.text)",
                            "array_to_string(list_transform(range(1, length(p.text) + 1), lambda i: case when len(list_filter(spans, lambda r: i > r.s and i <= r.e)) > 0 then ' ' else substr(p.text, i, 1) end), '')")


@query("redact_spans", f"with {_BLANKED} select doc_id, page_no, text, regions from blanked")
def redact_spans(spark, sf_dir):
    return redact.redact_spans(doc_pages(spark, sf_dir), regions(spark, sf_dir))


@query("span_overlap", f"""with {DOC_PAGES}, {_REGIONS}, lines as (select doc_id, page_no, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from doc_pages),
 spans as (select doc_id, page_no, i, coalesce(sum(length(line) + 1) over (partition by doc_id, page_no order by i rows between unbounded preceding and 1 preceding), 0) as s, length(line) as n from lines)
 select doc_id, page_no, cast(i as bigint) as line_no, cast(s as bigint) as s, cast(s + n as bigint) as e from spans a where exists (select 1 from regions b where a.doc_id = b.doc_id and a.page_no = b.page_no and a.s < b.e and b.s < a.s + a.n)""")
def span_overlap(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    start = lambda i: F.aggregate(F.slice("lines", F.lit(1), i), F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x) + 1)
    spans = F.transform("lines", lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), start(i).alias("s"), (start(i) + F.length(x)).alias("e")))
    rows = doc_pages(spark, sf_dir).select("doc_id", "page_no", lines.alias("lines")).select("doc_id", "page_no", F.inline(spans))
    return redact.touched_spans(rows, regions(spark, sf_dir)).select("doc_id", "page_no", "line_no", "s", "e")


# --- proof ----------------------------------------------------------------------------------------

# Removal that keeps to the case of the terms, so that the proof, which does not, finds what it left.
_CASED_LEFT = _LEFT.replace("concat('(?i)', ", "concat('', ")
_CASED = _CHECKS.replace(_LEFT, _CASED_LEFT)


def _staged(spark, sf_dir, pages, case_sensitive=False):
    """Documents as written after redaction; where only some pages are redacted, the others still leak."""
    t = terms(spark, sf_dir)
    staged = verify.stage(redact.redact_terms(doc_pages(spark, sf_dir), t, case_sensitive, pages), "redacted")
    return staged, t


def _results(spark, sf_dir, pages, case_sensitive=False):
    staged, t = _staged(spark, sf_dir, pages, case_sensitive)
    return verify.verify_pages(staged, doc_ids(spark, sf_dir), t)


def _flat(df):
    return df.withColumn("evidence", F.array_join("evidence", " | "))


@query("verify_redaction", f"with {_CHECKS} select doc_id, check_id, passed, coalesce(evidence, '') as evidence, coalesce(array_to_string(pages, ','), '') as pages from checks")
def verify_redaction(spark, sf_dir, pages=None):
    return _flat(_results(spark, sf_dir, pages)).select("doc_id", "check_id", "passed", "evidence", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("check_evidence", f"""with {_SURFACE_HITS}, e as (select distinct doc_id, concat('redaction.', surface) as check_id, page_no,
  concat('''', term, ''' in ', field, ' on ', case when page_no is null then 'document' else concat('page ', page_no) end) as line from surface_hits),
 wanted as (select page_id as doc_id, concat('redaction.', s) as check_id from pages, unnest({model.SURFACES}) as u(s))
 select w.doc_id, w.check_id, count(line) = 0 as passed, coalesce(string_agg(line, ' | ' order by line), '') as evidence, count(line) > 0 and bool_or(line is not null and page_no is null) as is_document_level
 from wanted w left join e on w.doc_id = e.doc_id and w.check_id = e.check_id group by w.doc_id, w.check_id
 union all select page_id, 'redaction.readable', false, 'cannot be read', true from pages where html is null""")
def check_evidence(spark, sf_dir):
    out = verify.verify_surfaces(surfaces(spark, sf_dir), page_ids(spark, sf_dir), terms(spark, sf_dir))
    return _flat(out).select("doc_id", "check_id", "passed", "evidence", "is_document_level")


@query("verified_docs", f"with {_CHECKS} select doc_id, count(*) as checks_run, bool_and(passed) as verified from checks group by doc_id")
def verified_docs(spark, sf_dir, pages=None):
    return verify.verified_docs(doc_ids(spark, sf_dir), _results(spark, sf_dir, pages))


@query("failed_pages", f"with {_CASED} select doc_id, check_id, array_to_string(pages, ',') as pages from checks where not passed")
def failed_pages(spark, sf_dir, pages=None):
    r = _results(spark, sf_dir, pages, case_sensitive=True).where("not passed")
    return r.select("doc_id", "check_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("suppression_targets", f"""with {_CASED}, {SURFACES}, web as (select distinct doc_id, page_no from surfaces join terms on case when surface = 'raw_content' then contains(translate(value, {_ALPHA}), translate(term, {_ALPHA})) else contains(lower(value), lower(term)) end)
 select 'documents' as corpus, doc_id, case when not passed then array_to_string(pages, ',') end as pages from checks
 union all select 'pages', page_id, case when count(w.doc_id) = 0 or bool_or(w.page_no is null) then null else string_agg(distinct page_no::varchar, ',') end from pages left join web w on page_id = w.doc_id group by page_id""")
def suppression_targets(spark, sf_dir, pages=None):
    staged, t = _staged(spark, sf_dir, pages, case_sensitive=True)
    plain = verify.suppression_targets(verify.verify_pages(staged, doc_ids(spark, sf_dir), t)).withColumn("corpus", F.lit("documents"))
    web = verify.suppression_targets(verify.verify_surfaces(surfaces(spark, sf_dir), page_ids(spark, sf_dir), t)).withColumn("corpus", F.lit("pages"))
    return plain.unionByName(web).select("corpus", "doc_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("fallback_evidence", f"""with {_SURFACE_HITS}, p as (select distinct doc_id, term from surface_hits where surface in ('annotations', 'links')),
 d as (select distinct doc_id, term from surface_hits where surface = 'bookmarks')
 select doc_id, term, 'page' as level from p union all select doc_id, term, 'document' from d where not exists (select 1 from p where p.doc_id = d.doc_id and p.term = d.term)""")
def fallback_evidence(spark, sf_dir):
    s = surfaces(spark, sf_dir).where("surface in ('annotations', 'links', 'bookmarks')")
    hits = term_hits(s, ["doc_id", "pos"], terms(spark, sf_dir))
    level = F.when(F.col("surface") == "bookmarks", "document").otherwise("page")
    rows = hits.select("doc_id", "term", level.alias("level")).distinct()
    return verify.fallback_evidence(rows.where("level = 'page'"), rows.where("level = 'document'"))


@query("dual_reader_union", f"""with {_SURFACE_HITS} select distinct doc_id, cast(page_no as bigint) as page_no, term from surface_hits where surface in ('page_text', 'raw_content')""")
def dual_reader_union(spark, sf_dir):
    return verify.dual_reader_hits(surfaces(spark, sf_dir), terms(spark, sf_dir))


_RELEASE = f"""{_LEFT}, h as (select doc_id, cast(sum(hits) as bigint) as hits from redacted group by doc_id),
 report as (select h.doc_id, hits, count(s.term) = 0 as verified, case when count(s.term) > 0 then 'quarantined' when hits = 0 then 'no_match' else 'released' end as status from h left join still s on h.doc_id = s.doc_id group by h.doc_id, hits)"""


@query("fail_closed_release", f"""with {_RELEASE} select r.doc_id, r.hits, status, page_no, text from report r join redacted p on r.doc_id = p.doc_id where status <> 'no_match'
 union all select doc_id, hits, status, null, null from report where status = 'no_match'""")
def fail_closed_release(spark, sf_dir, pages=None):
    released, quarantined, report = verify.fail_closed_release(doc_pages(spark, sf_dir), doc_ids(spark, sf_dir), terms(spark, sf_dir), pages=pages)
    text = released.unionByName(quarantined)
    none = F.lit(None)
    empty = report.where("status = 'no_match'").select(
        "doc_id", "hits", "status", none.cast("bigint").alias("page_no"), none.cast("string").alias("text"))
    return text.join(report.select("doc_id", "hits", "status"), "doc_id").select("doc_id", "hits", "status", "page_no", "text").unionByName(empty)


def _suppressed(left):
    return f"""with {left}, h as (select doc_id, cast(sum(hits) as bigint) as hits from redacted group by doc_id), bad as (select distinct doc_id, page_no from still)
 select p.doc_id, p.page_no, case when b.doc_id is null then p.text else '' end as text, 'released' as status
 from redacted p join h on p.doc_id = h.doc_id left join bad b on p.doc_id = b.doc_id and p.page_no = b.page_no where h.hits > 0"""


@query("suppress_pages", _suppressed(_CASED_LEFT))
def suppress_pages(spark, sf_dir, pages=None, case_sensitive=True):
    released, _, _ = verify.fail_closed_release(doc_pages(spark, sf_dir), doc_ids(spark, sf_dir), terms(spark, sf_dir), pages=pages, suppress=True, case_sensitive=case_sensitive, fold_proof=True)
    return released.withColumn("status", F.lit("released"))


@query("suppress_pages_all_pages", _suppressed(_LEFT))
def suppress_pages_all_pages(spark, sf_dir):
    """The whole removal, in capitals and small letters, before pages on which a term is left lose their text."""
    return suppress_pages(spark, sf_dir, case_sensitive=False)


for _fn in (verify_redaction, verified_docs, failed_pages, suppression_targets, fail_closed_release):
    # Names of an earlier round for the whole job, which the plain names now do.
    query(f"{_fn.__name__}_all_pages", ORACLES[_fn.__name__])(_fn)


_CUT = f"""{_BLANKED}, {_TERMS}, cut_todo as (select doc_id, page_no, list({_ESC} order by length(term) desc, term) as ps from blanked join terms on contains(lower({_SQ}), lower(term)) group by doc_id, page_no),
 cut as (select p.doc_id, p.page_no, case when ps is null then p.text else list_reduce(ps, lambda acc, x: regexp_replace(acc, x, '█', 'g'), p.text) end as text,
  case when ps is null then 0 else list_sum(list_transform(ps, lambda x: len(regexp_extract_all(p.text, x)))) end as hits from blanked p left join cut_todo t on p.doc_id = t.doc_id and p.page_no = t.page_no)"""


@query("release_with_regions", f"""with {_CUT}, counts as (select doc_id, max(page_no) as n from doc_pages group by doc_id),
 bad as (select distinct r.doc_id as bad_id from regions r join counts c on r.doc_id = c.doc_id left join blanked p on r.doc_id = p.doc_id and r.page_no = p.page_no where {_REGION_CHECK} <> 'clean'),
 still as (select distinct doc_id as still_id from cut join terms on contains(lower({_SQ}), lower(term)))
 select doc_id, cast(sum(hits) as bigint) as hits, case when bad_id is not null or still_id is not null then 'quarantined' when sum(hits) = 0 then 'no_match' else 'released' end as status,
  concat_ws(',', case when still_id is not null then 'redaction.page_text' end, case when bad_id is not null then 'redaction.region' end) as failed,
  md5(string_agg(text, chr(12) order by page_no)) as text_hash from cut left join bad on bad_id = doc_id left join still on still_id = doc_id group by doc_id, bad_id, still_id""")
def release_with_regions(spark, sf_dir):
    """Documents with regions and terms removed; both are proved on the written pages, in one report."""
    pages = doc_pages(spark, sf_dir)
    released, quarantined, report = verify.fail_closed_release(pages, doc_ids(spark, sf_dir), terms(spark, sf_dir), regions=regions(spark, sf_dir))
    kept = report.where("status = 'no_match'").select("doc_id")
    # What has no hit is not rewritten, but its regions are.
    blanked = redact.redact_spans(pages.join(kept, "doc_id", "left_semi"), regions(spark, sf_dir)).drop("regions")
    text = released.unionByName(quarantined).unionByName(blanked)
    # The pages of one document.
    whole = text.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    hashes = whole.select("doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "\f")).alias("text_hash"))
    return report.join(hashes, "doc_id", "left").select("doc_id", "hits", "status", F.array_join("failed", ",").alias("failed"), "text_hash")


# --- web pages ------------------------------------------------------------------------------------

_HIT = lambda x: f"len(list_filter(ts, lambda q: contains(lower({x}), q))) > 0"
_PARTS = r"(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<!--.*?-->|<title[^>]*>.*?</title[^>]*>|<h[1-6][^>]*>.*?</h[1-6]>|<[^>]*>|[^<]+|<"
_STRIPPED = "trim(regexp_replace(t, '<[^>]*>', ' ', 'g'))"
# Parts of a page one by one; no term of these queries holds a blank, so none runs over a tag.
_WEB = f"""{_SURFACE_HITS}, ts as (select list(lower(term)) as ts, list({_ESC} order by length(term) desc, term) as ps from terms),
 rows_hit as (select distinct doc_id, surface, field, seq from surface_hits where surface not in ('page_text', 'raw_content')),
 info as (select distinct doc_id as info_id from rows_hit where surface = 'docinfo'),
 parts as (select page_id, url, info_id is not null as info, unnest(regexp_extract_all(html, {lit(_PARTS)})) as t, generate_subscripts(regexp_extract_all(html, {lit(_PARTS)}), 1) as i
  from pages left join info on info_id = page_id),
 cut as (select page_id, url, info, i, case when regexp_matches(t, '(?i)^<(script|style)') then t when starts_with(t, '<!--') then case when {_HIT("t")} then '' else t end
   when regexp_matches(t, '(?i)^<title') then case when info then regexp_replace(t, '(?is)^(<title[^>]*>).*(</title[^>]*>)$', '\\1\\2') else t end
   when regexp_matches(t, '(?i)^<h[1-6]') then case when {_HIT(_STRIPPED)} then regexp_replace(t, '(?is)^(<h[1-6][^>]*>).*(</h[1-6]>)$', '\\1[redacted]\\2') else t end
   when regexp_matches(t, '(?is)^<a .*href="') and {_HIT("regexp_extract(t, 'href=.([^\x22]*)', 1)")} then regexp_replace(t, ' href="[^"]*"', '')
   when regexp_matches(t, '(?i)^<html') and info then regexp_replace(t, ' lang="[^"]*"', '') when starts_with(t, '<') and t <> '<' then t
   else list_reduce(ps, lambda acc, x: regexp_replace(acc, x, '█', 'g'), t) end as c,
  case when regexp_matches(t, '(?i)^<(script|style|!--)') then 0 else list_sum(list_transform(ps, lambda x: len(regexp_extract_all(regexp_replace(t, '<[^>]*>', ' ', 'g'), x)))) end as n
  from parts cross join ts),
 written as (select page_id, case when bool_or(info) then '' else coalesce(any_value(url), '') end as url, string_agg(c, '' order by i) as html, cast(sum(n) as bigint) as page_text from cut group by page_id),
 removed as (select doc_id as removed_id, count(*) filter (surface = 'docinfo') as docinfo, count(*) filter (surface = 'bookmarks') as bookmarks, count(*) filter (surface = 'links') as links,
  count(*) filter (surface in ('annotations', 'form_fields', 'embedded_files')) + max(case when surface = 'xmp' then 1 else 0 end) as others from rows_hit group by doc_id)"""


@query("redact_web_pages", f"""with {_WEB} select page_id as doc_id, url, md5(html) as html_hash, page_text, coalesce(docinfo, 0) as docinfo, coalesce(bookmarks, 0) as bookmarks, coalesce(links, 0) as links, coalesce(others, 0) as others
 from written left join removed on removed_id = page_id""")
def redact_web_pages(spark, sf_dir):
    out = web.redact_pages(table(spark, sf_dir, "pages"), terms(spark, sf_dir))
    others = F.col("annotations") + F.col("form_fields") + F.col("embedded_files") + F.col("xmp")
    return out.select(F.col("page_id").alias("doc_id"), "url", F.md5(F.col("html")).alias("html_hash"), "page_text", "docinfo", "bookmarks", "links", others.alias("others"))


_WRITTEN_SURFACES = SURFACES.replace("surfaces as (", "seen as (", 1).replace("from pages", "from written")


@query("release_web_pages", f"""with {_WEB}, {_WRITTEN_SURFACES}, left_over as (select distinct doc_id, surface from seen join terms on
  case when surface = 'raw_content' then contains(translate(value, {_ALPHA}), translate(term, {_ALPHA})) else contains(lower(value), lower(term)) end),
 bad as (select doc_id as bad_id, string_agg(surface, ',' order by surface) as failed from left_over group by doc_id)
 select page_id as doc_id, cast(page_text + coalesce(docinfo + bookmarks + links + others, 0) as bigint) as hits,
  case when failed is not null then 'quarantined' when page_text + coalesce(docinfo + bookmarks + links + others, 0) = 0 then 'no_match' else 'released' end as status, coalesce(failed, '') as failed, md5(html) as html_hash
 from written left join removed on removed_id = page_id left join bad on bad_id = page_id""")
def release_web_pages(spark, sf_dir):
    """Status and failed surfaces of every page, with the written page that it is about."""
    pages = table(spark, sf_dir, "pages")
    released, quarantined, report, checks = web.release_pages(pages, terms(spark, sf_dir))
    failed = checks.where("not passed").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(F.replace("check_id", F.lit("redaction."), F.lit("")))), ",").alias("failed"))
    html = released.unionByName(quarantined).select(F.col("page_id").alias("doc_id"), F.md5(F.col("html")).alias("html_hash"))
    same = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.md5(F.col("html")).alias("as_it_was"))
    rows = report.join(failed, "doc_id", "left").join(html, "doc_id", "left").join(same, "doc_id", "left")
    return rows.select("doc_id", "hits", "status", F.coalesce("failed", F.lit("")).alias("failed"), F.coalesce("html_hash", "as_it_was").alias("html_hash"))


_DEFAULTS = {o: d for o, (d, _) in model.SANITIZE_SWITCHES.items()}
_EVERYTHING = {o: True for o in model.SANITIZE_SWITCHES}
_PROMISED = ", ".join(f"('{o}', '{f}')" for o, (_, fs) in model.SANITIZE_SWITCHES.items() for f in fs)
_PROMISED_DEFAULT = ", ".join(f"'{f}'" for o, (d, fs) in model.SANITIZE_SWITCHES.items() if d for f in fs)


@query("promise_checks", f"""with {FINDINGS}, promised(opt, id) as (values {_PROMISED})
 select page_id as doc_id, concat('sanitization.', opt, '.', p.id) as check_id, f.id is null as passed, coalesce(array_to_string(items, ' | '), '') as evidence
 from pages cross join promised p left join findings f on f.doc_id = page_id and f.id = p.id where html is not null
 union all select page_id, 'sanitization.readable', false, 'cannot be read' from pages where html is null""")
def promise_checks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    findings = audit.explode_findings(audit.audit_pages(pages))
    return _flat(verify.promise_checks(page_ids(spark, sf_dir), findings, _EVERYTHING))


@query("residual_findings", f"with {FINDINGS} select doc_id, id, severity, count from findings where id not in ({_PROMISED_DEFAULT}, 'clean')")
def residual_findings(spark, sf_dir):
    findings = audit.explode_findings(audit.audit_pages(table(spark, sf_dir, "pages")))
    return verify.residual_findings(findings, _DEFAULTS).select("doc_id", "id", "severity", "count")

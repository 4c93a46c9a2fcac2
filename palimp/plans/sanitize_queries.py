"""Sanitising, chains, lookups and column protection."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp import model
from palimp.functions import patterns as P
from palimp.operators import audit, lookup, protect, sanitize, verify
from palimp.plans.base import SURFACES, lit, query
from palimp.plans.page_queries import docs
from palimp.plans.redact_queries import page_ids, surfaces
from palimp.sources import tables
from palimp.sources.tables import table

EVERYTHING = {o: True for o in model.SANITIZE_SWITCHES}


def _sanitize_sql():
    """The steps as nested subqueries, each counting on the html before it."""
    sql = "select page_id as doc_id, html from pages"
    names = {s: [] for s in sanitize.STEPS}
    keep = sanitize._OPEN, sanitize._MID, sanitize._CLOSE
    for i, (switch, kind, pattern, replacement) in enumerate(sanitize.enabled_steps(EVERYTHING)):
        html = "html"
        if kind == "script":
            html = f"regexp_replace(html, {lit(sanitize.LD_SCRIPT)}, {lit(keep[0] + chr(92) + '1' + keep[1] + chr(92) + '2' + keep[2])}, 'g')"
        out = f"regexp_replace({html}, {lit(pattern)}, {lit(replacement.replace('$', chr(92)))}, 'g')"
        if kind == "script":
            back = f"{keep[0]}([^{keep[1]}]*){keep[1]}([^{keep[2]}]*){keep[2]}"
            out = f"regexp_replace({out}, {lit(back)}, '<script\\1>\\2</script>', 'g')"
        count = "" if kind == "silent" else f", len(regexp_extract_all({html}, {lit(pattern)})) as n{i}"
        if kind != "silent":
            names[switch].append(f"n{i}")
        sql = f"select * exclude (html), {out} as html{count} from ({sql})"
    totals = ", ".join(f"cast({' + '.join(ns)} as bigint) as {s}" for s, ns in names.items())
    total = " + ".join(n for ns in names.values() for n in ns)
    return f"select doc_id, md5(html) as html_hash, {totals}, cast({total} as bigint) as total from ({sql})"


@query("sanitize_documents", _sanitize_sql())
def sanitize_documents(spark, sf_dir):
    out = sanitize.sanitize_documents(table(spark, sf_dir, "pages"), EVERYTHING)
    return out.select("doc_id", F.md5(F.col("html")).alias("html_hash"), *[F.col("removed")[s].alias(s) for s in sanitize.STEPS], "total")


@query("sanitize_proof", f"""select page_id as doc_id, cast(8 as bigint) as checks, cast(0 as bigint) as failed from pages where html is not null""")
def sanitize_proof(spark, sf_dir):
    """Promises checked on the written output with every switch on, by the audit and by signs that removal does not use."""
    pages = table(spark, sf_dir, "pages")
    clean = sanitize.sanitize_documents(pages, EVERYTHING).select(F.col("doc_id").alias("page_id"), "html")
    written = verify.stage(clean.join(pages.select("page_id", "url"), "page_id"), "sanitized")
    findings = verify.sanitization_findings(written, audit.explode_findings(audit.audit_pages(written)))
    checks = verify.promise_checks(page_ids(spark, sf_dir), findings, EVERYTHING)
    return checks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))


_PART = """case when surface = 'annotations' and field = 'comment' then 'always' when surface = 'form_fields' and coalesce(value, '') = '' then 'always' when surface = 'embedded_files' and field = 'data' then 'always'
 when surface = 'annotations' and field in ('alt', 'aria-label') then 'strip' when (surface = 'docinfo' and field <> 'url') or surface = 'xmp' then 'strip' else 'keep' end"""
_FLAGS = ", ".join(f"('{p[0]}', {str(p[6]).lower()})" for p in model.PRESETS)


@query("structure_cleanup", f"""with {SURFACES}, parts as (select doc_id, {_PART} as part, length(value) as chars from surfaces), presets(preset, strip) as (values {_FLAGS})
 select doc_id, preset, count(*) filter (not (part = 'always' or (part = 'strip' and strip))) as kept, count(*) filter (part = 'always' or (part = 'strip' and strip)) as dropped,
 cast(coalesce(sum(chars) filter (part = 'always' or (part = 'strip' and strip)), 0) as bigint) as dropped_chars from parts cross join presets group by doc_id, preset""")
def structure_cleanup(spark, sf_dir):
    return sanitize.structure_cleanup(surfaces(spark, sf_dir))


def _chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    edges = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node_id"), (F.col("turn") + 1).alias("next_id"), F.col("role").alias("kind"))
    return edges, edges.where("node_id = 0").select("doc_id", "node_id", "kind")


@query("chain_walk", """with recursive nodes as (select conv_id as doc_id, turn as node_id, min(role) as kind from conversations group by all),
 walk as (select doc_id, node_id, cast(0 as bigint) as depth, kind as path, kind from nodes where node_id = 0
  union all select w.doc_id, n.node_id, w.depth + 1, concat(w.path, ' > ', n.kind), n.kind from walk w join nodes n on n.doc_id = w.doc_id and n.node_id = w.node_id + 1)
 select doc_id, node_id, depth, path from walk""")
def chain_walk(spark, sf_dir):
    edges, heads = _chain(spark, sf_dir)
    return sanitize.chain_walk(edges, heads).select("doc_id", "node_id", "depth", "path")


@query("excise_chain", """with recursive nodes as (select conv_id as doc_id, turn as node_id, min(role) as kind from conversations group by all),
 walk as (select doc_id, node_id, kind from nodes where node_id = 0 union all select w.doc_id, n.node_id, n.kind from walk w join nodes n on n.doc_id = w.doc_id and n.node_id = w.node_id + 1),
 alive as (select doc_id, node_id from walk where kind <> 'system' union all select distinct doc_id, -1 from walk),
 links as (select doc_id, node_id, lead(node_id) over (partition by doc_id order by node_id) as next_id from alive),
 drops as (select doc_id, count(*) as dropped from walk where kind = 'system' group by doc_id)
 select l.doc_id, l.node_id, l.next_id, coalesce(dropped, 0) as dropped from links l left join drops d on l.doc_id = d.doc_id where next_id is not null""")
def excise_chain(spark, sf_dir):
    edges, heads = _chain(spark, sf_dir)
    links, drops = sanitize.excise_chain(edges, heads, ["system"])
    per_doc = drops.groupBy("doc_id").agg(F.sum("dropped").cast("bigint").alias("dropped"))
    return links.join(per_doc, "doc_id", "left").select("doc_id", "node_id", "next_id", F.coalesce("dropped", F.lit(0)).cast("bigint").alias("dropped"))


# Event types stand in for trigger and action codes; two of them are unknown codes.
EVENT_CODES = {"click": ("D", "URI"), "view": ("O", "Named"), "purchase": ("V", "SubmitForm"), "signup": ("Zz", "Other"), "error": ("", "JavaScript")}


def _case(index, values=None):
    table_ = values or {}
    def text(code):
        return table_.get(code, {0: "fires automatically" if code == "" else f"fires on the {code} event", 1: "runs an action"}[index])
    return "case event_type " + " ".join(f"when '{e}' then {lit(text(codes[index]))}" for e, codes in EVENT_CODES.items()) + " end"


@query("code_lookup", f"select event_id, event_type, {_case(0, model.TRIGGERS)} as fires, {_case(1, model.ACTION_VERBS)} as does from events")
def code_lookup(spark, sf_dir):
    def code(index):
        c = F.lit(None).cast("string")
        for e, codes in EVENT_CODES.items():
            c = F.when(F.col("event_type") == e, codes[index]).otherwise(c)
        return c
    return lookup.describe_codes(table(spark, sf_dir, "events"), code(0), code(1)).select("event_id", "event_type", "fires", "does")


# Paths of actions, one for each type of event.
_PATHS = {"click": ("Page 1 /AA /D", "URI"), "view": ("Page 2 /AA /O /Next", "Named"), "purchase": ("Field /AA /V", "SubmitForm"), "signup": ("Link /A", "Other"), "error": ("Catalog /OpenAction", "JavaScript")}
_WORDING = {"click": "fires on mouse-down in the field; opens a URL", "view": "fires when the page is opened; runs a named viewer command",
            "purchase": "fires when the field is validated; submits form data over the network", "signup": "fires automatically; runs an action",
            "error": "fires as soon as the document is opened; runs embedded JavaScript"}


@query("autorun_wording", "select event_id, case event_type " + " ".join(f"when '{e}' then {lit(_PATHS[e][0] + ' \u2014 ' + w)}" for e, w in _WORDING.items()) + " end as description from events")
def autorun_wording(spark, sf_dir):
    pick = lambda i: F.coalesce(*[F.when(F.col("event_type") == e, F.lit(p[i])) for e, p in _PATHS.items()])
    return lookup.describe_autorun(table(spark, sf_dir, "events"), pick(0), pick(1)).select("event_id", "description")


_ROUTES = f"routes as ({tables.ROUTES_SQL.format(nation='nation')})"


@query("hub_routes", f"""with {_ROUTES}, through as (select distinct a.src, b.dst from routes a join routes b on a.dst = 0 and b.src = 0 where a.src <> b.dst)
 select src, dst, 'direct' as via from routes union all select src, dst, 'hub' from through t where not exists (select 1 from routes r where r.src = t.src and r.dst = t.dst)""")
def hub_routes(spark, sf_dir):
    return lookup.hub_routes(tables.routes(spark, sf_dir), 0)


@query("hub_reach", f"""with {_ROUTES} select cast(n_nationkey as bigint) as code, n_nationkey = 0 or exists (select 1 from routes where src = 0 and dst = n_nationkey) as to_ok,
 n_nationkey = 0 or exists (select 1 from routes where dst = 0 and src = n_nationkey) as from_ok from nation""")
def hub_reach(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("code"))
    return lookup.hub_reach(codes, tables.routes(spark, sf_dir), 0)


@query("protect_columns", """select doc_id, concat('{"cipher":"aes-256-gcm","version":3,"key":"k1","name":"', source, '"}') as header, cast(strlen(text) + 28 as bigint) as payload_bytes, cast(60 as bigint) as wrapped_bytes, md5(text) as text_hash
 from documents where text is not null""")
def protect_columns(spark, sf_dir):
    """What is clear of every sealed document, and what it opens to."""
    keys = protect.key_table(spark, "k1", "k2")
    sealed = protect.protect_columns(docs(spark, sf_dir).select("doc_id", "source", "text").where("text is not null"), "text", F.col("source"), keys, "k1")
    size = lambda c: F.octet_length(c).cast("bigint").alias(f"{c}_bytes")
    sealed = sealed.select("doc_id", "header", "wrapped", "payload", size("payload"), size("wrapped"))
    return protect.unprotect_columns(sealed, "text", keys).select("doc_id", "header", "payload_bytes", "wrapped_bytes", F.md5(F.col("text")).alias("text_hash"))


@query("unprotect_columns", """select doc_id, case doc_id % 3 when 0 then 'ok' else 'wrong key or altered' end as status, case doc_id % 3 when 0 then md5(text) end as text_hash from documents""")
def unprotect_columns(spark, sf_dir):
    """A third of the rows keeps its header, a third has it altered, a third names another key."""
    keys = protect.key_table(spark, "k1", "k2")
    sealed = protect.protect_columns(docs(spark, sf_dir).select("doc_id", "source", "text"), "text", F.col("source"), keys, "k1")
    i, head = F.col("doc_id") % 3, F.col("header")
    altered = sealed.withColumn("header", F.when(i == 1, F.replace(head, F.lit("src"), F.lit("other"))).when(i == 2, F.replace(head, F.lit('"k1"'), F.lit('"k2"'))).otherwise(head))
    return protect.unprotect_columns(altered, "text", keys).select("doc_id", "status", F.md5(F.col("text")).alias("text_hash"))


@query("rotate_keys", "select doc_id, 'ok' as status, md5(text) as text_hash from documents")
def rotate_keys(spark, sf_dir):
    """Documents sealed under one key, wrapped anew under another, and opened with that one alone."""
    keys = protect.key_table(spark, "k1", "k2")
    sealed = protect.protect_columns(docs(spark, sf_dir).select("doc_id", "source", "text"), "text", F.col("source"), keys, "k1")
    turned = protect.rotate_keys(sealed.withColumn("rotated", F.lit("k2")), keys)
    return protect.unprotect_rotated(turned, "text", keys.where("key_id = 'k2'")).select("doc_id", "status", F.md5(F.col("text")).alias("text_hash"))

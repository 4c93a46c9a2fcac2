"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp import model
from palimp.operators import pages
from palimp.plans.base import DOC_PAGES, FINDINGS, ORACLES, query
from palimp.plans.page_queries import doc_pages, docs, sized
from palimp.plans.redact_queries import terms, _RELEASE
from palimp.session import scratch_path
from palimp.sources import payloads
from palimp.sources.sinks import write_split
from palimp.sources.surfaces import paginate
from palimp.streaming import streams

_KINDS = list(model.MAGICS)
_MAGIC_SQL = "case doc_id % 6 " + " ".join(f"when {i} then '{model.MAGICS[k]}'" for i, k in enumerate(_KINDS)) + " when 4 then '' end"


@query("scan_payloads", f"""with p as (select doc_id, concat({_MAGIC_SQL}, hex(encode(text))) as h, {_MAGIC_SQL} is null as gone from documents)
 select doc_id, case when gone then 'missing' """ + " ".join(f"when starts_with(h, '{m}') then '{k}'" for k, m in model.MAGICS.items()) + """ else 'unsupported' end as kind,
 case when not gone then cast(length(h) // 2 as bigint) end as length from p""")
def scan_payloads(spark, sf_dir):
    """Documents as payloads under five kinds of heading, and one kind that is missing."""
    i = F.col("doc_id") % 6
    magic = F.when(i == 4, F.lit("").cast("binary"))
    for k, name in enumerate(_KINDS):
        magic = F.when(i == k, F.unhex(F.lit(model.MAGICS[name]))).otherwise(magic)
    content = F.concat(magic, F.encode("text", "utf-8"))
    rows = docs(spark, sf_dir).select("doc_id", content.alias("content"))
    return rows.select("doc_id", payloads.payload_kind(F.col("content")).alias("kind"), F.octet_length("content").cast("bigint").alias("length"))


_HEAD = r"^\p{Lu}\p{Ll}"


@query("input_gate", f"""select doc_id, case when text is null or text = '' then 'missing' when length(text) > 5000 then 'too large' when not regexp_matches(text, '{_HEAD}') then 'bad magic' else '' end as reason,
 case when text is null or text = '' or length(text) > 5000 or not regexp_matches(text, '{_HEAD}') then 'rejected' else 'accepted' end as status from documents""")
def input_gate(spark, sf_dir):
    reason = payloads.input_gate(F.col("text"), 5000, _HEAD)
    return docs(spark, sf_dir).select("doc_id", reason.alias("reason")).select(
        "doc_id", F.coalesce("reason", F.lit("")).alias("reason"), F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"))


@query("split_sink", f"""with {DOC_PAGES}, g as (select source, doc_id, page_no, (page_no - 1) // 3 * 3 + 1 as s, text from doc_pages), n as (select *, least(s + 2, max(page_no) over (partition by doc_id)) as e from g)
 select source, concat(doc_id, '_', s, '-', e, '.pdf') as out_name, page_no, text from n""")
def split_sink(spark, sf_dir):
    """Pages in groups of three, written under their source, read back."""
    groups = pages.page_groups(sized(spark, sf_dir, "source"), "every_n", 3)
    named = pages.output_names(groups, F.lit("{name}_{start}-{end}"), F.col("doc_id").cast("string"), F.lit(""))
    rows = pages.assign_pages(named, doc_pages(spark, sf_dir, "source"))
    out = scratch_path(spark, "split")
    write_split(rows.select("source", "out_name", "page_no", "text"), out, "source")
    return spark.read.schema("source string, out_name string, page_no bigint, text string").parquet(out)


@query("stream_audit", f"with {FINDINGS} select doc_id, id, severity, count from findings")
def stream_audit(spark, sf_dir):
    stream = streams.audit_stream(streams.landing(spark, sf_dir, "pages"))
    return streams.to_table(stream, "stream-audit").select("doc_id", "id", "severity", "count")


@query("stream_hash_dedup", "select distinct sha256(text) as hash from documents")
def stream_hash_dedup(spark, sf_dir):
    stream = streams.hash_dedup_stream(streams.landing(spark, sf_dir, "documents").select("text")).select("hash")
    return streams.to_table(stream, "stream-dedup")


@query("stream_op_metrics", """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, user_id % 5 as tool, count(*) filter (event_type <> 'error') as done, count(*) filter (event_type = 'error') as failed
 from events group by 1, 2""")
def stream_op_metrics(spark, sf_dir):
    """All hours, also those that a watermark would still hold open."""
    metrics = streams.op_metrics_stream(streams.landing(spark, sf_dir, "events"), late=None)
    written = streams.latest_table(metrics.select(F.col("w.start").alias("start"), "tool", "done", "failed"), "stream-metrics")
    return written.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "tool", "done", "failed")


@query("stream_redact_release", f"""with {_RELEASE} select r.doc_id, r.hits, verified, status, page_no, text from report r join redacted p on r.doc_id = p.doc_id where status <> 'no_match'
 union all select doc_id, hits, verified, status, null, null from report where status = 'no_match'""")
def stream_redact_release(spark, sf_dir, pages=None):
    """The rows of all three sinks."""
    found = terms(spark, sf_dir)
    return streams.redact_release_stream(streams.landing(spark, sf_dir, "documents"), paginate, found, pages=pages)


query("stream_redact_release_all_pages", ORACLES["stream_redact_release"])(stream_redact_release)

"""Languages, literals and translation over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp.operators import lang, verify
from palimp.plans.base import DOC_PAGES, lit, query
from palimp.plans.page_queries import doc_pages, docs
from palimp.sources.tables import table
from palimp.session import ship_by_value

ship_by_value(__name__)

_SP = "'[ \\t\\r\\n\\f\\x0B]+'"


def _grams(text):
    t = f"lower(trim(regexp_replace({text}, {_SP}, ' ', 'g')))"
    return (f"list_concat(list_concat(regexp_extract_all({t}, '(?s).{{3}}'), regexp_extract_all(substr({t}, 2), '(?s).{{3}}')), "
            f"regexp_extract_all(substr({t}, 3), '(?s).{{3}}'))")


_PROFILE = f"""grams as (select lang, unnest({_grams('text')}) as gram from documents), counts as (select lang, gram, count(*) as n from grams group by all),
 profile as (select lang, gram, n, cast(sum(n) over (partition by lang) as bigint) as total from counts),
 logs as (select lang, gram, n, total, cast(round(ln(n / total::double) * 1000000) as bigint) as logp from profile)"""


def _detect(source, keys, out):
    """Oracle of detection: a language's score is the sum over a text's grams, unseen grams count half."""
    k = ", ".join(keys)
    on = " and ".join(f"s.{x} = l.{x}" for x in keys)
    return f"""{out}_g as (select {k}, gram, count(*) as c from (select {k}, unnest({_grams('text')}) as gram from {source}) group by all),
 {out}_floor as (select lang, cast(round(ln(0.5 / max(total)) * 1000000) as bigint) as floor from logs group by lang),
 {out}_s as (select {k}, f.lang, sum(c * coalesce(p.logp, f.floor)) as score from {out}_g g cross join {out}_floor f left join logs p on p.lang = f.lang and p.gram = g.gram group by {k}, f.lang),
 {out}_best as (select {k}, lang from (select *, row_number() over (partition by {k} order by score desc, lang) as rn from {out}_s) where rn = 1),
 {out} as (select {', '.join('l.' + x for x in keys)}, case when length(regexp_replace(l.text, '\\P{{L}}', '', 'g')) >= 3 then s.lang end as lang from {source} l left join {out}_best s on {on})"""


def profile(spark, sf_dir):
    return verify.stage(lang.train_profile(docs(spark, sf_dir).select("lang", "text")), "profile")


@query("train_language_profile", f"with {_PROFILE} select lang, gram, n, logp from logs")
def train_language_profile(spark, sf_dir):
    return lang.train_profile(docs(spark, sf_dir).select("lang", "text")).select("lang", "gram", "n", "logp")


@query("detect_language", f"with {_PROFILE}, {_detect('documents', ['doc_id'], 'found')} select doc_id, lang from found")
def detect_language(spark, sf_dir):
    return lang.detect_language(docs(spark, sf_dir).select("doc_id", "text"), ["doc_id"], profile(spark, sf_dir))


@query("document_language", f"with {_PROFILE}, {DOC_PAGES}, {_detect('doc_pages', ['doc_id', 'page_no'], 'found')} select doc_id, arg_min(lang, page_no) filter (lang is not null) as lang from found group by doc_id")
def document_language(spark, sf_dir):
    found = lang.detect_language(doc_pages(spark, sf_dir), ["doc_id", "page_no"], profile(spark, sf_dir))
    return lang.document_language(found, "doc_id", "page_no")


_TURNS = "turns as (select conv_id, turn, text from conversations)"


@query("carry_forward_language", f"""with {_PROFILE}, {_TURNS}, {_detect('turns', ['conv_id', 'turn'], 'found')},
 first as (select conv_id, min(turn) as first_turn, arg_min(lang, turn) as lang from found where lang is not null group by conv_id)
 select f.conv_id, f.turn, f.lang, case when f.turn >= i.first_turn then i.lang end as effective from found f left join first i on f.conv_id = i.conv_id""")
def carry_forward_language(spark, sf_dir):
    """Turns too short to be detected on their own take the language of the first that was."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = lang.detect_language(turns, ["conv_id", "turn"], profile(spark, sf_dir))
    return lang.carry_forward(found, "conv_id", "turn").select("conv_id", "turn", "lang", "effective")


_LINES = "lines as (select doc_id, lang, cast(i - 1 as bigint) as line_no, line from (select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"


def lines(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "text")).where("text is not null")
    return rows.withColumn("line_no", F.col("line_no").cast("bigint"))


_SEP = lit(lang.SEPARATOR)
_PARTS = f"""{_LINES}, parts as (select doc_id, lang, line_no, cast(i - 1 as bigint) as seq, part, coalesce(seps[i], '') as sep from (select doc_id, lang, line_no, regexp_extract_all(line, {_SEP}) as seps,
 unnest(string_split_regex(line, {_SEP})) as part, generate_subscripts(string_split_regex(line, {_SEP}), 1) as i from lines))"""


@query("split_fragments", f"with {_PARTS} select doc_id, line_no, seq, part, sep from parts")
def split_fragments(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode_outer(lang.fragments(F.col("text"))).alias("seq", "f"))
    return rows.select("doc_id", "line_no", F.col("seq").cast("bigint").alias("seq"), "f.part", "f.sep")


# RE2 word boundaries know ASCII only: other letters are searched as '_', which keeps positions and boundaries.
def _spans_of(text, pattern):
    p = lit(pattern)
    return (f"select id, cast(sum(length(piece) + length(m)) over (partition by id order by i) as bigint) - length(m) as s, length(m) as n from "
            f"(select id, i, pieces[i] as piece, found[i] as m from (select id, string_split_regex(flat, {p}) as pieces, regexp_extract_all(flat, {p}) as found, "
            f"unnest(range(1, len(regexp_extract_all(flat, {p})) + 1)) as i from {text}))")


# Greedy choice: spans in (start, longest first) order; a span is taken when it starts at or after the last taken end.
def _chosen(text):
    spans = " union all ".join(_spans_of(text, p) for p in lang.LITERALS)
    return f"""spans as (select distinct id, s, s + n as e from ({spans})),
 numbered as (select id, s, e, row_number() over (partition by id order by s, e desc) as k from spans),
 greedy as (select id, s, e, k, e as last, true as taken from numbered where k = 1
  union all select n.id, n.s, n.e, n.k, case when n.s >= g.last then n.e else g.last end, n.s >= g.last from greedy g join numbered n on n.id = g.id and n.k = g.k + 1),
 chosen as (select id, s, e from greedy where taken)"""


_TEXTS = r"texts as (select concat(doc_id, ':', line_no, ':', seq) as id, part, regexp_replace(part, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g') as flat from parts where part <> '')"
_LITERALS = f"{_PARTS}, {_TEXTS}, {_chosen('texts')}"


def spanned(spark, sf_dir):
    rows = split_fragments(spark, sf_dir).where("part <> ''")
    return rows.withColumn("spans", lang.literal_spans(F.col("part")))


@query("literal_spans", f"with recursive {_LITERALS} select c.id, cast(s as bigint) as s, cast(e as bigint) as e, substr(part, s + 1, e - s) as literal from chosen c join texts t on c.id = t.id")
def literal_spans(spark, sf_dir):
    rows = spanned(spark, sf_dir).select(F.concat_ws(":", "doc_id", "line_no", "seq").alias("id"), "part", F.explode_outer("spans").alias("r")).where("r is not null")
    return rows.select("id", F.col("r.s").cast("bigint").alias("s"), F.col("r.e").cast("bigint").alias("e"), lang.cut(F.col("part"), F.col("r.s"), F.col("r.e")).alias("literal"))


# Masked parts: numbers counted from the last literal, between marks. No text of the tables holds a private-use character.
_MASKED = f"""{_LITERALS}, places as (select id, s, e, count(*) over (partition by id) - row_number() over (partition by id order by s) as number, lag(e, 1, 0) over (partition by id order by s) as before from chosen),
 masked as (select t.id, any_value(part) as part, concat(string_agg(concat(substr(part, before + 1, s - before), chr({lang.PRIVATE[0]}), number, chr({lang.PRIVATE[0]})), '' order by s), any_value(substr(part, final + 1))) as masked,
  string_agg(substr(part, s + 1, e - s), chr(31) order by s desc) as saved from texts t join places p on p.id = t.id join (select id, max(e) as final from chosen group by id) z on z.id = t.id group by t.id)"""


@query("mask_literals", f"with recursive {_MASKED} select id, part, masked, saved from masked")
def mask_literals(spark, sf_dir):
    rows = spanned(spark, sf_dir).where(F.size("spans") > 0).withColumn("m", lang.mask(F.col("part"), F.col("spans")))
    return rows.select(F.concat_ws(":", "doc_id", "line_no", "seq").alias("id"), "part", "m.masked", F.array_join("m.saved", "\x1f").alias("saved"))


@query("restore_literals", f"with {_PARTS} select doc_id, line_no, seq, part as restored from parts where part <> ''")
def restore_literals(spark, sf_dir):
    rows = spanned(spark, sf_dir).withColumn("m", lang.mask(F.col("part"), F.col("spans")))
    return rows.select("doc_id", "line_no", "seq", lang.restore(F.col("m.masked"), F.col("m.saved"), F.col("m.mark")).alias("restored"))


def marking_model(texts):
    """Stands in for a translation model: marks what it was given."""
    return ["[T]" + t for t in texts]


def failing_model(texts):
    """Fails on long texts."""
    if any(len(t) > 200 for t in texts):
        raise ValueError("text is longer than 200 characters")
    return marking_model(texts)


# What the models are asked: parts with a letter outside of their literals, in lines of another language.
_ASKED = f"""{_MASKED}, gaps as (select id, s, e, lag(e, 1, 0) over (partition by id order by s) as before, max(e) over (partition by id) as final from chosen),
 rest as (select t.id, case when count(g.id) = 0 then any_value(part) else concat(string_agg(substr(part, before + 1, s - before), '' order by s), any_value(substr(part, final + 1))) end as residual from texts t left join gaps g on g.id = t.id group by t.id),
 asked as (select p.*, coalesce(m.masked, p.part) as sent, p.lang <> 'en' and p.part <> '' and coalesce(regexp_matches(residual, '\\p{{L}}'), false) as asked
  from parts p left join rest r on r.id = concat(p.doc_id, ':', p.line_no, ':', p.seq) left join masked m on m.id = concat(p.doc_id, ':', p.line_no, ':', p.seq))"""
_WHOLE = "case when l.lang = 'en' or trim(l.line) = '' then l.line else o.text end as translated"


@query("translate_lines", f"""with recursive {_ASKED}
 select l.doc_id, l.line_no, {_WHOLE} from lines l join (select doc_id, line_no, string_agg(concat(case when asked then '[T]' else '' end, part, sep), '' order by seq) as text from asked group by doc_id, line_no) o
 on l.doc_id = o.doc_id and l.line_no = o.line_no""")
def translate_lines(spark, sf_dir):
    return lang.translate_lines(lines(spark, sf_dir), marking_model, "en").select("doc_id", "line_no", "translated")


@query("translate_keep_on_error", f"""with recursive {_ASKED}
 select l.doc_id, l.line_no, {_WHOLE}, case when l.lang <> 'en' and trim(l.line) <> '' then o.error end as error from lines l join (select doc_id, line_no,
  string_agg(concat(case when asked and length(sent) <= 200 then '[T]' else '' end, part, sep), '' order by seq) as text,
  string_agg('text is longer than 200 characters', '; ') filter (asked and length(sent) > 200) as error from asked group by doc_id, line_no) o on l.doc_id = o.doc_id and l.line_no = o.line_no""")
def translate_keep_on_error(spark, sf_dir):
    return lang.translate_lines(lines(spark, sf_dir), failing_model, "en").select("doc_id", "line_no", "translated", "error")

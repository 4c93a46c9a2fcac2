"""Registration and the SQL fragments that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from palimp import model
from palimp.functions import patterns as P

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def attr(tag: str, names: str) -> str:
    p = lit(P.attribute(names))
    return f"concat(regexp_extract({tag}, {p}, 2), regexp_extract({tag}, {p}, 3), regexp_extract({tag}, {p}, 4))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(P.SPACES)}, ' ', 'g'))"


def strip_tags(x: str) -> str:
    return squeeze(f"regexp_replace({x}, {lit(P.TAG)}, ' ', 'g')")


def domain_of(x: str) -> str:
    t = f"trim({x}, E' \\t\\r\\n')"
    host = f"regexp_extract({t}, '(?i)^(https?://[^ \\t\\r\\n/]+)', 1)"
    return f"case when {host} <> '' then lower({host}) else substr({t}, 1, 80) end"


def resolve(uri: str, url: str) -> str:
    base = f"regexp_extract({url}, '(?i)^(https?://[^ \\t\\r\\n/?#]+)', 1)"
    return (f"case when regexp_matches({uri}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {uri} "
            f"when starts_with({uri}, '//') then concat(regexp_extract({url}, '(?i)^(https?:)', 1), {uri}) "
            f"when starts_with({uri}, '/') then concat({base}, {uri}) else concat({base}, '/', {uri}) end")


def visible_text(x: str) -> str:
    for p in (P.SCRIPT, P.STYLE, P.COMMENT, P.TAG):
        x = f"regexp_replace({x}, {lit(p)}, ' ', 'g')"
    return squeeze(x)


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


DOC_PAGES = """doc_pages as (
 select doc_id, cast(i + 1 as bigint) as page_no, array_to_string(lines[i*10+1:i*10+10], chr(10)) as text, lang, source
 from (select doc_id, lang, source, lines, unnest(range(0, (len(lines) + 9) // 10)) as i
       from (select doc_id, lang, source, string_split(text, chr(10)) as lines from documents)))"""

_LD = f"regexp_matches(regexp_extract(m, {lit(P.SCRIPT)}, 1), {lit(P.LD_JSON)})"


def _each(surface: str, page: str, found: str, field: str, value: str, where: str = "true") -> str:
    """One surface: rows per match, numbered after filtering."""
    return (f"select page_id as doc_id, {page} as page_no, '{surface}' as surface, {field} as field, "
            f"cast(i - 1 as bigint) as seq, {value} as value from (select page_id, unnest(ms) as m, generate_subscripts(ms, 1) as i "
            f"from (select page_id, list_filter({found}, lambda m: {where}) as ms from pages))")


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(html, {lit(pattern)}, {group})"


def _attr_rows(surface: str, names: str) -> str:
    p = lit(P.attribute(names))
    return _each(surface, "1", _all(P.attribute(names)), f"lower(regexp_extract(m, {p}, 1))",
                 f"concat(regexp_extract(m, {p}, 2), regexp_extract(m, {p}, 3), regexp_extract(m, {p}, 4))")


_DOWNLOAD = P.attribute("download")
EMBEDDED_LIST = (
    f"list_concat(list_concat(list_transform({_all(P.EMBED)}, lambda m: {{'field': 'embed', 'value': {attr('m', 'src')}}}), "
    f"list_transform({_all(P.OBJECT)}, lambda m: {{'field': 'object', 'value': {attr('m', 'data')}}})), "
    f"list_concat(list_transform({_all(_DOWNLOAD)}, lambda m: {{'field': 'download', 'value': {attr('m', 'download')}}}), "
    f"list_transform({_all(P.DATA_URI, 1)}, lambda m: {{'field': 'data', 'value': m}})))")

_NULL = "cast(null as bigint)"
_H = lit(P.HEADING)
SURFACES = "surfaces as (" + "\n union all ".join([
    f"select page_id as doc_id, 1 as page_no, 'page_text' as surface, 'text' as field, cast(0 as bigint) as seq, {visible_text('html')} as value from pages",
    "select page_id, 1, 'raw_content', 'html', 0, html from pages",
    _attr_rows("annotations", "title|alt|aria-label"),
    _each("annotations", "1", _all(P.COMMENT, 1), "'comment'", "m"),
    _each("form_fields", "1", _all(P.INPUT), attr("m", "name"), attr("m", "value")),
    _each("form_fields", "1", _all(P.TEXTAREA), "'textarea'", f"regexp_extract(m, {lit(P.TEXTAREA)}, 2)"),
    _attr_rows("links", "href|src"),
    _each("docinfo", _NULL, _all(P.TITLE, 1), "'title'", "m"),
    _each("docinfo", _NULL, _all(P.HTML_TAG), "'lang'", attr("m", "lang")),
    _each("docinfo", _NULL, _all(P.META), f"lower({attr('m', 'name')})", attr("m", "content"), f"{attr('m', 'name')} <> ''"),
    f"select page_id, {_NULL}, 'docinfo', 'url', 0, coalesce(url, '') from pages",
    _each("xmp", _NULL, _all(P.SCRIPT), "'ld+json'", f"regexp_extract(m, {lit(P.SCRIPT)}, 2)", _LD),
    _each("xmp", _NULL, _all(P.META), f"lower({attr('m', 'property')})", attr("m", "content"), f"{attr('m', 'property')} <> ''"),
    _each("bookmarks", _NULL, _all(P.HEADING), f"concat('h', regexp_extract(m, {_H}, 1))", strip_tags(f"regexp_extract(m, {_H}, 2)")),
    f"select page_id, {_NULL}, 'embedded_files', e.field, cast(i - 1 as bigint), e.value from (select page_id, unnest(es) as e, generate_subscripts(es, 1) as i from (select page_id, {EMBEDDED_LIST} as es from pages))",
]) + ")"

_RANK = "case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 when 'info' then 3 else 9 end"
RANK = _RANK


def _prefixed(label: str, values: str) -> str:
    return f"list_transform({distinct_in_order(values)}, lambda v: concat('{label}', substr(v, 1, 80)))"


_SCANS = f"""scans as (
 select *, list_filter(links, lambda u: regexp_matches(u, {lit(P.JAVASCRIPT_URL)})) as js_links,
  list_filter(links, lambda u: regexp_matches(u, {lit(P.LAUNCH_URL)}) and not regexp_matches(u, {lit(P.JAVASCRIPT_URL)})) as launch,
  list_transform(list_filter(links, lambda u: not regexp_matches(u, {lit(P.JAVASCRIPT_URL)})), lambda u: {resolve('u', 'url')}) as web
 from (select page_id as doc_id, url, html,
  list_filter(list_transform({_all(P.ANCHOR)}, lambda m: trim({attr('m', 'href')})), lambda u: u <> '') as links,
  list_concat(
   list_transform(list_filter(list_transform({_all(P.TITLE, 1)}, lambda v: {strip_tags('v')}), lambda v: v <> ''), lambda v: concat('Title: ', v)),
   list_transform(list_filter({_all(P.META)}, lambda m: {attr('m', 'name')} <> '' and trim({attr('m', 'content')}) <> ''),
    lambda m: concat({attr('m', 'name')}, ': ', trim({attr('m', 'content')})))) as info,
  len(list_filter({_all(P.SCRIPT)}, lambda m: {_LD})) + len(list_filter({_all(P.META)}, lambda m: {attr('m', 'property')} <> '')) as xmp,
  list_transform(list_filter({_all(P.SCRIPT)}, lambda m: not {_LD}), lambda m: trim(regexp_extract(m, {lit(P.SCRIPT)}, 2))) as code,
  {_all(P.HANDLER, 1)} as handlers, {_all(P.META_REFRESH)} as refresh,
  list_filter(list_transform({_all(P.IFRAME)}, lambda m: {resolve(f"trim({attr('m', 'src')})", 'url')}),
   lambda u: regexp_matches(u, '(?i)^https?://') and {domain_of('u')} <> lower(regexp_extract(url, '(?i)^(https?://[^ \\t\\r\\n/]+)', 1))) as frames,
  list_filter(list_transform({_all(P.FORM)}, lambda m: trim({attr('m', 'action')})), lambda a: a <> '') as forms,
  {EMBEDDED_LIST} as parts, len({_all(P.FIELD)}) as fields, len({_all(P.HIDDEN_BLOCK)}) as layers,
  regexp_matches(html, {lit(P.HIDDEN_STYLE)}) as invisible
  from pages))"""


def _finding(seq: int, fid: str, count: str, items: str = "cast([] as varchar[])", severity: str | None = None) -> str:
    category, default, title = model.FINDINGS[fid]
    return (f"select doc_id, {seq} as seq, '{fid}' as id, '{category}' as category, {severity or lit(default)} as severity, "
            f"'{title}' as title, cast({count} as bigint) as count, {items} as items from scans where html is not null and {count} > 0")


_DOMAINS = f"list_transform(web, lambda u: {domain_of('u')})"
_PLAIN = "len(list_filter(web, lambda u: regexp_matches(u, '(?i)^http://'))) > 0"
_JS_ITEMS = f"list_concat({_prefixed('script: ', 'code')}, {_prefixed('link: ', 'js_links')})"
_AUTO_ITEMS = "list_concat(list_transform(handlers, lambda v: lower(v)), list_transform(refresh, lambda m: 'refresh'))"
_PART_ITEMS = f"list_transform({distinct_in_order('parts')}, lambda e: concat(e.field, ': ', substr(e.value, 1, 80)))"
_FOUND = "found as (" + "\n union all ".join([
    _finding(0, "meta.docinfo", "len(info)", distinct_in_order("info")),
    _finding(1, "meta.xmp", "least(xmp, 1)"),
    _finding(2, "scripts.js", "len(code) + len(js_links)", _JS_ITEMS),
    _finding(3, "actions.launch", "len(launch)", _prefixed("launch: ", "launch")),
    _finding(4, "actions.autorun", "len(handlers) + len(refresh)", distinct_in_order(_AUTO_ITEMS)),
    _finding(5, "actions.remote", "len(frames)", _prefixed("frame: ", "frames")),
    _finding(6, "forms.submit", "len(forms)", _prefixed("action: ", "forms")),
    _finding(7, "links.uri", "len(web)", distinct_in_order(_DOMAINS), f"case when {_PLAIN} then 'medium' else 'low' end"),
    _finding(8, "files.embedded", "len(parts)", _PART_ITEMS),
    _finding(9, "forms.acro", "fields"),
    _finding(10, "content.ocg", "layers"),
    _finding(11, "content.invisible_text", "cast(invisible as integer)"),
]) + ")"
# findings(doc_id, seq, id, category, severity, title, count, items)
FINDINGS = f"""{_SCANS}, {_FOUND}, findings as (
 select doc_id, cast(row_number() over (partition by doc_id order by seq) - 1 as bigint) as seq, id, category, severity, title, count, items from found
 union all select page_id, 0, 'encryption.locked', 'encryption', 'info', 'Cannot be opened', 1, [] from pages where html is null
 union all select page_id, 0, 'clean', 'content', 'info', 'Nothing found', 0, [] from pages
  where html is not null and page_id not in (select doc_id from found))"""

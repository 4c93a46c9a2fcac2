"""Pages, naming, merging, comparison and text scalars over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.operators import batch, compare, dedup, pages
from palimp.plans import base
from palimp.plans.audit_queries import META_SQL, metadata_columns
from palimp.session import ship_by_value
from palimp.plans.base import DOC_PAGES, SURFACES, query
from palimp.sources.surfaces import page_count, paginate, surfaces_from_html
from palimp.sources.tables import table

_STR = F.lit

ship_by_value(__name__)


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def doc_pages(spark, sf_dir, *carry):
    return paginate(docs(spark, sf_dir), 10, *carry)


def sized(spark, sf_dir, *cols):
    """doc_id, n_pages and other columns, without carrying the text."""
    return docs(spark, sf_dir).select("doc_id", page_count(F.col("text")).alias("n_pages"), *cols)


_SIZED = "sized as (select doc_id, cast((len(string_split(text, chr(10))) + 9) // 10 as bigint) as n_pages, lang, source, text, n_chars from documents)"
_SPECS = ["1", "1-2, 1", " 2 , 1-1,", "0-1", "2-1", "x", "", "1-9"]
_SPEC_SQL = "case doc_id % 8 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SPECS)) + " end"


def spec_column():
    c = F.lit(None).cast("string")
    for i, s in enumerate(_SPECS):
        c = F.when(F.col("doc_id") % 8 == i, F.lit(s)).otherwise(c)
    return c


_PARSED = f"""{_SIZED}, specs as (select doc_id, n_pages, {_SPEC_SQL} as spec from sized),
 parts as (select doc_id, n_pages, i, trim(p) as p from (select doc_id, n_pages, unnest(string_split(spec, ',')) as p, generate_subscripts(string_split(spec, ','), 1) as i from specs) where trim(p) <> ''),
 bounds as (select doc_id, n_pages, i, try_cast(trim(case when strpos(p, '-') > 0 then substr(p, 1, strpos(p, '-') - 1) else p end) as bigint) as s,
  try_cast(trim(case when strpos(p, '-') > 0 then substr(p, strpos(p, '-') + 1) else p end) as bigint) as e from parts),
 verdict as (select doc_id, bool_and(coalesce(s >= 1 and e <= n_pages and s <= e, false)) as ok from bounds group by doc_id)"""


@query("select_page_ranges", f"""with {DOC_PAGES}, {_PARSED}, wanted as (
  select doc_id, row_number() over (partition by doc_id order by i, g) - 1 as pos, g as page_no
  from (select b.doc_id, i, unnest(range(s, e + 1)) as g from bounds b join verdict v on b.doc_id = v.doc_id and ok))
 select w.doc_id, cast(pos as bigint) as pos, cast(w.page_no as bigint) as page_no, length(p.text) as chars, 'ok' as status from wanted w join doc_pages p on w.doc_id = p.doc_id and w.page_no = p.page_no
 union all select s.doc_id, p.page_no - 1, p.page_no, length(p.text), 'ok' from specs s join doc_pages p on s.doc_id = p.doc_id where spec = ''
 union all select doc_id, null, null, null, 'invalid range' from verdict where not ok""")
def select_page_ranges(spark, sf_dir):
    specs = sized(spark, sf_dir).withColumn("spec", spec_column())
    out = pages.select_page_ranges(specs, doc_pages(spark, sf_dir))
    return out.select("doc_id", "pos", "page_no", F.length("text").cast("bigint").alias("chars"), "status")


@query("assign_page_groups", f"""with {_PARSED},
 toc as (select doc_id, g as page, case when g % 4 = 1 then 1 else 2 end as level from (select doc_id, unnest(range(1, n_pages + 1)) as g from sized)),
 groups as (
 select doc_id, 'all' as mode, g as grp, g as s, g as e from (select doc_id, unnest(range(1, n_pages + 1)) as g from sized)
 union all select doc_id, 'every_n', (g + 2) // 3, g, least(g + 2, n_pages) from (select doc_id, n_pages, unnest(range(1, n_pages + 1, 3)) as g from sized)
 union all select b.doc_id, 'ranges', row_number() over (partition by b.doc_id order by i), s, e from bounds b join verdict v on b.doc_id = v.doc_id and ok
 union all select s.doc_id, 'ranges', null, null, null from specs s left join verdict v on s.doc_id = v.doc_id where not coalesce(ok, false)
 union all select t.doc_id, 'chapters', row_number() over (partition by t.doc_id order by page), page, least(page + 3, n_pages) from toc t join sized d on t.doc_id = d.doc_id where level = 1)
 select g.doc_id, mode, cast(grp as bigint) as grp, cast(s as bigint) as start_page, cast(e as bigint) as end_page, cast(e - s + 1 as bigint) as n_pages,
  case when grp is not null then 'ok' when spec = '' then 'no ranges' else 'invalid ranges' end as status from groups g join specs p on g.doc_id = p.doc_id""")
def assign_page_groups(spark, sf_dir):
    d = sized(spark, sf_dir).withColumn("spec", spec_column())
    modes = [pages.page_groups(d, m, 3).withColumn("mode", F.lit(m)) for m in ("all", "every_n", "ranges")]
    every = pages.page_groups(d, "all").select("doc_id", F.col("start").alias("seq"), F.col("start").alias("page"))
    toc = every.withColumn("level", F.when(F.col("page") % 4 == 1, 1).otherwise(2))
    ended = pages.toc_ranges(toc, d.select("doc_id", F.col("n_pages").alias("last_page")), max_level=2).where("level = 1")
    # The chapters of one document.
    found = ended.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("start"), F.col("end_page").alias("end")))).alias("chapters"))
    chapters = pages.page_groups(d.join(found, "doc_id"), "chapters").withColumn("mode", F.lit("chapters"))
    out = modes[0].unionByName(modes[1]).unionByName(modes[2]).unionByName(chapters)
    return out.select("doc_id", "mode", "grp", F.col("start").cast("bigint").alias("start_page"), F.col("end").cast("bigint").alias("end_page"),
                      (F.col("end") - F.col("start") + 1).cast("bigint").alias("n_pages"), "status")


@query("page_operations", f"""with {_SIZED}, p as (select doc_id, unnest(range(1, n_pages + 1)) as page_no from sized),
 turned as (select doc_id, page_no, ((doc_id % 4) * 90 + case when page_no % 2 = 0 then 270 else 0 end) % 360 as rotation from p where page_no % 3 <> 0),
 remaining as (select *, row_number() over (partition by doc_id order by page_no) - 1 as idx from turned),
 orders as (select doc_id, unnest([1, 0, 99, 0]) as idx, unnest([0, 1, 2, 3]) as pos from sized where doc_id % 2 = 0),
 placed as (select r.doc_id, page_no, rotation, o.pos from remaining r join orders o on r.doc_id = o.doc_id and r.idx = o.idx
  union all select doc_id, page_no, rotation, idx from remaining where doc_id % 2 = 1)
 select doc_id, cast(page_no as bigint) as page_no, cast(rotation as bigint) as rotation, row_number() over (partition by doc_id order by pos) as out_page from placed""")
def page_operations(spark, sf_dir):
    d = sized(spark, sf_dir)
    p = d.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_pages")).alias("page_no")).withColumn("rotation", (F.col("doc_id") % 4) * 90)
    rotations = p.where("page_no % 2 = 0").select("doc_id", "page_no", F.lit(-90).alias("degrees"))
    deletes = p.where("page_no % 3 = 0").select("doc_id", "page_no")
    order = F.array(*[F.lit(i).cast("bigint") for i in (1, 0, 99, 0)])
    new_order = d.where("doc_id % 2 = 0").select("doc_id", F.posexplode(order).alias("pos", "idx")).withColumn("pos", F.col("pos").cast("bigint"))
    return pages.page_operations(p, rotations, deletes, new_order)


@query("page_blocks", f"""with {DOC_PAGES}, lines as (select doc_id, page_no, trim(regexp_replace(b, '[ \\t\\r\\n]+', ' ', 'g')) as block, i from
  (select doc_id, page_no, unnest(string_split(text, chr(10))) as b, generate_subscripts(string_split(text, chr(10)), 1) as i from doc_pages)),
 blocks as (select doc_id, page_no, block, row_number() over (partition by doc_id, page_no order by i) as block_no from lines where block <> '')
 select p.doc_id, p.page_no, coalesce(block_no, 1) as block_no, coalesce(block, '[No extractable text on this page]') as block
 from doc_pages p left join blocks b on p.doc_id = b.doc_id and p.page_no = b.page_no""")
def page_blocks(spark, sf_dir):
    return pages.page_blocks(doc_pages(spark, sf_dir))


@query("extract_text", f"""with {DOC_PAGES}, t as (select doc_id, string_agg(concat('--- Page ', page_no, ' ---', chr(10), text, chr(10)), chr(10) order by page_no) as text,
 count(*) as page_count from doc_pages group by doc_id) select doc_id, text, page_count, length(text) as char_count from t""")
def extract_text(spark, sf_dir):
    return pages.extract_row_text(docs(spark, sf_dir))


@query("filter_surfaces", f"""with {SURFACES} select doc_id, surface, field, seq, md5(value) as value_hash, 'forms' as dropped from surfaces where surface <> 'form_fields'
 union all select doc_id, surface, field, seq, md5(value), 'annotations' from surfaces where surface not in ('annotations', 'links')""")
def filter_surfaces(spark, sf_dir):
    s = surfaces_from_html(table(spark, sf_dir, "pages"))
    no_forms = pages.filter_surfaces(s, annotations=False, forms=True).withColumn("dropped", F.lit("forms"))
    no_notes = pages.filter_surfaces(s, annotations=True, forms=False).withColumn("dropped", F.lit("annotations"))
    return no_forms.unionByName(no_notes).select("doc_id", "surface", "field", "seq", F.md5(F.col("value")).alias("value_hash"), "dropped")


@query("letter_gate", """select doc_id, cast(i - 1 as bigint) as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line,
 generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where regexp_matches(line, '\\p{L}')""")
def letter_gate(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(tx.has_letter(F.col("line"))).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


# --- naming and merging ---------------------------------------------------------------------------

@query("disambiguate_names", """with n as (select doc_id, concat(source, '_', lang, '.v1.pdf') as name, row_number() over (partition by source, lang order by doc_id) as rn from documents)
 select doc_id, name, case when rn > 1 then concat(name[:-5], '_', rn, '.pdf') else name end as out_name from n""")
def disambiguate_names(spark, sf_dir, **chunking):
    names = docs(spark, sf_dir).select("doc_id", F.concat_ws("_", "source", "lang").alias("stem")).select(
        "doc_id", F.concat("stem", F.lit(".v1.pdf")).alias("name"))
    return pages.disambiguate(names, "name", "doc_id", profile=docs(spark, sf_dir), **chunking)


@query("merge_renumber", f"""with {DOC_PAGES} select source, doc_id, page_no, row_number() over (partition by source order by doc_id, page_no) as merged_page from doc_pages""")
def merge_renumber(spark, sf_dir, **chunking):
    d = sized(spark, sf_dir, "source")
    return pages.merge_renumber(d, "source", profile=docs(spark, sf_dir), **chunking).select("source", "doc_id", "page_no", "merged_page")


@query("page_offsets", f"""with {_SIZED} select source, doc_id, n_pages, cast(coalesce(sum(n_pages) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) + 1 as start_page from sized""")
def page_offsets(spark, sf_dir, **chunking):
    d = sized(spark, sf_dir, "source")
    return pages.page_offsets(d, "source", profile=docs(spark, sf_dir), **chunking).select(
        "source", "doc_id", "n_pages", (F.col("offset") + 1).alias("start_page"))


@query("merge_documents", """select cast(0 as bigint) as file_idx, doc_id as item_id, cast(0 as bigint) as part, text from documents union all select 1, item_id, 0, text from benchmark
 union all select 2, conv_id, turn, text from conversations""")
def merge_documents(spark, sf_dir):
    zero = F.lit(0).cast("bigint").alias("part")
    return pages.merge_documents([
        docs(spark, sf_dir).select(F.col("doc_id").alias("item_id"), zero, "text"),
        table(spark, sf_dir, "benchmark").select("item_id", zero, "text"),
        table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("part"), "text"),
    ])


_LEVEL = "case role when 'system' then 0 when 'user' then 1 else 2 end"


@query("toc_ranges", f"""with toc as (select conv_id as doc_id, turn as seq, {_LEVEL} as level, turn as page from conversations),
 last as (select doc_id, max(page) as last_page from toc group by doc_id),
 nexts as (select a.doc_id, a.seq, a.level, min(b.page) as next_page from toc a left join toc b on a.doc_id = b.doc_id and b.seq > a.seq and b.level <= a.level group by all)
 select t.doc_id, t.seq, cast(t.level as bigint) as level, t.page, greatest(coalesce(n.next_page - 1, l.last_page), t.page) as end_page
 from toc t join nexts n on t.doc_id = n.doc_id and t.seq = n.seq and t.level = n.level join last l on t.doc_id = l.doc_id""")
def toc_ranges(spark, sf_dir, **chunking):
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).cast("bigint")
    toc = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), level.alias("level"), F.col("turn").alias("page"))
    last = toc.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    return pages.toc_ranges(toc, last, **chunking).select("doc_id", "seq", "level", "page", "end_page")


_HEAD = "string_split(text, chr(10))[1]"
_TITLE_SQL = """case when trim(substr(trim(regexp_replace({x}, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '. _'), 1, 80)) = '' then 'untitled' else substr(trim(regexp_replace({x}, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '. _'), 1, 80) end"""


@query("sanitize_title", f"""select page_id as doc_id, {_TITLE_SQL.format(x='url')} as from_url, {_TITLE_SQL.format(x='html')} as from_html from pages""")
def sanitize_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), tx.sanitize_title(F.col("url")).alias("from_url"),
        tx.sanitize_title(F.col("html")).alias("from_html"))


_TEMPLATES = ["{name}_page_{start}", "{filename}-{start}-{end}", "{title}_{n}", "{name}_{missing}", "{name"]


@query("render_names", f"""with {_SIZED}, g as (select doc_id, source, cast(doc_id % 5 as integer) as k, g as s, least(g + 1, n_pages) as e,
  {_TITLE_SQL.format(x=_HEAD)} as title from (select *, unnest(range(1, n_pages + 1, 2)) as g from sized))
 select doc_id, cast(s as bigint) as start, cast(e as bigint) as "end", concat(case k when 0 then concat(source, '_page_', s) when 1 then concat(source, '-', s, '-', e)
  when 2 then concat(title, '_', s) else concat(source, '_page_', s) end, '.pdf') as out_name from g""")
def render_names(spark, sf_dir):
    head = F.get(F.split("text", "\n", -1), F.lit(0))
    d = sized(spark, sf_dir, "source", tx.sanitize_title(head).alias("title"))
    groups = pages.page_groups(d, "every_n", 2)
    template = F.lit(_TEMPLATES[4])
    for i, t in enumerate(_TEMPLATES[:4]):
        template = F.when(F.col("doc_id") % 5 == i, F.lit(t)).otherwise(template)
    named = groups.join(d.select("doc_id", "source", "title"), "doc_id")
    return pages.output_names(named, template, F.col("source"), F.col("title")).select("doc_id", "start", "end", "out_name")


# --- comparison -----------------------------------------------------------------------------------

_PAIRS = "pairs as (select doc_id as a, lead(doc_id) over (partition by source order by doc_id) as b from documents)"
_DIFFS = f"""{DOC_PAGES}, {_PAIRS},
 sides as (select coalesce(x.pair, y.pair) as pair, coalesce(x.page_no, y.page_no) as page_no, x.text as ta, y.text as tb from
  (select a as pair, page_no, text from doc_pages join pairs on doc_id = a where b is not null) x full join
  (select a as pair, page_no, text from doc_pages join pairs on doc_id = b) y on x.pair = y.pair and x.page_no = y.page_no),
 word_sets as (select *, list_filter(list_distinct(string_split_regex(ta, '[ \\t\\r\\n]+')), lambda w: w <> '') as wa, list_filter(list_distinct(string_split_regex(tb, '[ \\t\\r\\n]+')), lambda w: w <> '') as wb from sides),
 diffs as (select pair, page_no, case when ta is null then 'added_in_b' when tb is null then 'removed_in_b' when ta = tb then 'identical' else 'different' end as status,
  case when ta is null then 'Page only in document B' when tb is null then 'Page only in document A' when ta = tb then '' else
   concat('+', len(list_filter(wb, lambda w: not list_contains(wa, w))), ' words, -', len(list_filter(wa, lambda w: not list_contains(wb, w))), ' words') end as details from word_sets)"""


def _page_diffs(spark, sf_dir, **chunking):
    d = docs(spark, sf_dir)
    pairs = compare.neighbour_pairs(d, "source", **chunking)
    text = d.select("doc_id", "text")
    a = paginate(text.join(pairs.select(F.col("a").alias("doc_id")), "doc_id", "left_semi")).withColumnRenamed("doc_id", "pair")
    b = paginate(text.join(pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("pair")), "doc_id"), 10, "pair").drop("doc_id")
    return compare.compare_pages(a, b)


@query("compare_pages", f"with {_DIFFS} select pair, page_no, status, details from diffs")
def compare_pages(spark, sf_dir, **chunking):
    return _page_diffs(spark, sf_dir, **chunking)


@query("changed_pages", f"""with {_DIFFS} select pair, count(*) filter (status <> 'added_in_b') as pages_a, count(*) filter (status <> 'removed_in_b') as pages_b,
 count(*) filter (status <> 'identical') as changed from diffs group by pair""")
def changed_pages(spark, sf_dir):
    return compare.changed_pages(_page_diffs(spark, sf_dir))


@query("word_set_diff", f"""with {_PAIRS}, t as (select a as pair, x.text as ta, y.text as tb from pairs join documents x on x.doc_id = a join documents y on y.doc_id = b),
 w as (select pair, list_filter(list_distinct(string_split_regex(ta, '[ \\t\\r\\n]+')), lambda w: w <> '') as wa, list_filter(list_distinct(string_split_regex(tb, '[ \\t\\r\\n]+')), lambda w: w <> '') as wb from t)
 select pair, array_to_string(list_sort(list_filter(wb, lambda w: not list_contains(wa, w))), ' ') as added,
  array_to_string(list_sort(list_filter(wa, lambda w: not list_contains(wb, w))), ' ') as removed from w""")
def word_set_diff(spark, sf_dir):
    d = docs(spark, sf_dir)
    pairs = compare.neighbour_pairs(d, "source")
    both = (pairs.join(d.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(d.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").withColumnRenamed("a", "pair"))
    out = compare.word_set_diff(both)
    return out.select("pair", *[F.array_join(F.array_sort(c), " ").alias(c) for c in ("added", "removed")])


@query("compare_metadata", f"""with m as ({META_SQL}), p as (select a.doc_id as pair, a.title as t1, b.title as t2, a.author as a1, b.author as a2, a.subject as s1, b.subject as s2, a.creator as c1, b.creator as c2
  from m a join m b on b.doc_id = a.doc_id + 1)
 select * from (select pair, 'title' as field, t1 as a, t2 as b from p union all select pair, 'author', a1, a2 from p union all select pair, 'subject', s1, s2 from p union all select pair, 'creator', c1, c2 from p) where a <> b""")
def compare_metadata(spark, sf_dir):
    pages_table = table(spark, sf_dir, "pages")
    fields = ["title", "author", "subject", "creator"]
    meta = pages_table.select(F.col("page_id").alias("pair"), *metadata_columns(F.col("html"))).select("pair", *fields)
    ids = pages_table.select(F.col("page_id").alias("pair"))
    # Page n is compared with page n + 1; pages without a partner take no part.
    earlier = meta.withColumn("pair", F.col("pair") - 1).join(ids, "pair", "left_semi")
    first = meta.join(ids.withColumn("pair", F.col("pair") - 1), "pair", "left_semi")
    return compare.compare_metadata(first, earlier, fields)


# --- de-duplication -------------------------------------------------------------------------------

@query("content_hash_dedup", """select doc_id, sha256(text) as hash, min(doc_id) over (partition by sha256(text)) as keeper,
 doc_id = min(doc_id) over (partition by sha256(text)) as kept from documents""")
def content_hash_dedup(spark, sf_dir, **skew):
    return dedup.content_hash_dedup(docs(spark, sf_dir), F.col("text"), **skew)


@query("distinct_objects", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
 h as (select sha256(line) as obj, doc_id, (i - 1) // 10 + 1 as page_no, i, length(line) as bytes from l),
 r as (select *, row_number() over (partition by obj order by doc_id, page_no, i) as rn from h)
 select obj, doc_id, cast(page_no as bigint) as page_no, cast(i as bigint) as line_no, bytes from r where rn = 1""")
def distinct_objects(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "line")).where("line is not null")
    rows = lines.select(
        F.sha2("line", 256).alias("obj"), "doc_id", (F.floor(F.col("i") / 10) + 1).cast("bigint").alias("page_no"),
        (F.col("i") + 1).cast("bigint").alias("line_no"), F.length("line").cast("bigint").alias("bytes"))
    return dedup.distinct_objects(rows, ["obj"], ["doc_id", "page_no", "line_no"], ["bytes"])


@query("first_occurrence", """with l as (select doc_id, unnest(string_split(text, chr(10))) as item, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
 select doc_id, item, cast(min(i) - 1 as bigint) as seq, count(*) as occurrences from l group by doc_id, item""")
def first_occurrence(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("seq", "item")).where("item is not null")
    return dedup.first_occurrence(lines.withColumn("seq", F.col("seq").cast("bigint")), ["doc_id", "item"], "seq")


# --- scalars --------------------------------------------------------------------------------------

def _fmt_sql(n, variant):
    if variant == "engine":
        return f"case when {n} < 1024 then concat({n}, ' B') when {n} < 1048576 then concat(printf('%.1f', {n} / 1024.0::double), ' KB') else concat(printf('%.2f', {n} / 1048576.0::double), ' MB') end"
    return (f"case when {n} < 1024 then concat({n}, ' B') when {n} < 1048576 then concat(printf('%.1f', {n} / 1024.0::double), ' KB') "
            f"when {n} < 1073741824 then concat(printf('%.1f', {n} / 1048576.0::double), ' MB') else concat(printf('%.2f', {n} / 1073741824.0::double), ' GB') end")


@query("fmt_size", f"""select doc_id, {_fmt_sql('n_chars', 'audit')} as size_text, {_fmt_sql('(n_chars * 4099)', 'audit')} as audit_text, {_fmt_sql('(n_chars * 4099)', 'engine')} as engine_text,
 {_fmt_sql('(n_chars * 4194304)', 'audit')} as large_text from documents""")
def fmt_size(spark, sf_dir):
    n = F.col("n_chars")
    return docs(spark, sf_dir).select(
        "doc_id", tx.fmt_size(n).alias("size_text"), tx.fmt_size(n * 4099).alias("audit_text"),
        tx.fmt_size(n * 4099, "engine").alias("engine_text"), tx.fmt_size(n * 4194304).alias("large_text"))


@query("text_views", f"""with {DOC_PAGES} select doc_id, page_no, text as as_is, trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) as normalised,
 trim(regexp_replace(replace(text, concat('-', chr(10)), ''), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) as dehyphenated from doc_pages""")
def text_views(spark, sf_dir):
    views = tx.text_views(F.col("text"))
    return doc_pages(spark, sf_dir).select("doc_id", "page_no", *[c.alias(k) for k, c in views.items()])


# Outcome of shrinking each document: error under 200 characters, skipped when nothing is gained.
_OUTCOME_SQL = """outcomes as (select doc_id, source, n_chars as original_size, length(trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))) as compressed_size,
 case when n_chars < 200 then 'error' when length(trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))) >= n_chars then 'skipped' else 'ok' end as status from documents)"""


def outcomes(spark, sf_dir):
    n, size = F.col("n_chars"), F.length(tx.squeeze(F.col("text"))).cast("bigint")
    base_cols = docs(spark, sf_dir).select("doc_id", "source", n.alias("original_size"), size.alias("compressed_size"))
    status = (F.when(F.col("original_size") < 200, "error")
              .when(F.col("compressed_size") >= F.col("original_size"), "skipped").otherwise("ok"))
    return base_cols.withColumn("status", status)


@query("saved_stats", f"""with {_OUTCOME_SQL} select doc_id, case when status = 'skipped' then 0 else original_size - compressed_size end as saved_bytes,
 round(case when status = 'skipped' or original_size = 0 then 0.0 else (1 - compressed_size / original_size::double) * 100 end, 6) as saved_pct from outcomes""")
def saved_stats(spark, sf_dir):
    o, c, skipped = F.col("original_size"), F.col("compressed_size"), F.col("status") == "skipped"
    return outcomes(spark, sf_dir).select("doc_id", tx.saved_bytes(o, c, skipped).alias("saved_bytes"),
                                          F.round(tx.saved_pct(o, c, skipped), 6).alias("saved_pct"))


@query("batch_summary", f"""with {_OUTCOME_SQL} select count(*) filter (status = 'ok') as ok, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'error') as failed,
 cast(sum(original_size) filter (status <> 'error') as bigint) as total_original, cast(sum(original_size - compressed_size) filter (status = 'ok') as bigint) as total_saved,
 round(100.0::double * (sum(original_size - compressed_size) filter (status = 'ok')) / (sum(original_size) filter (status <> 'error')), 4) as saved_pct from outcomes""")
def batch_summary(spark, sf_dir):
    s = F.col("status")
    return batch.batch_totals(outcomes(spark, sf_dir).withColumn("saved", F.when(s == "ok", F.col("original_size") - F.col("compressed_size"))))


@query("batch_isolation", f"""with {_OUTCOME_SQL} select doc_id, case when status = 'error' then 'error' else 'ok' end as status,
 case when status = 'error' then substr(concat('document ', doc_id, ' of ', source, ' is too small: ', original_size, ' characters, at least 200 are needed to shrink it without losing its layout'), 1, 100) else '' end as message,
 case when status = 'error' then null else compressed_size end as compressed_size from outcomes""")
def batch_isolation(spark, sf_dir):
    """An operation that raises on documents of under 200 characters."""
    rows = outcomes(spark, sf_dir).select("doc_id", "source", "original_size", "compressed_size")
    return batch.isolated(rows, "doc_id", shrunk_size).withColumnRenamed("result", "compressed_size")


def shrunk_size(row):
    if row["original_size"] < 200:
        raise ValueError(f"document {row['doc_id']} of {row['source']} is too small: {row['original_size']} characters, at least 200 are needed to shrink it without losing its layout")
    return row["compressed_size"]


@query("overlay_metadata", """with u as (select doc_id, max(case when toxic = 1 then 'flagged' else '' end) as new_source, max(case when quality = 1 then 'reviewed' else '' end) as new_lang from labels group by doc_id)
 select d.doc_id, case when length(new_source) > 0 then new_source else source end as source, case when length(new_lang) > 0 then new_lang else lang end as lang
 from documents d left join u on d.doc_id = u.doc_id""")
def overlay_metadata(spark, sf_dir):
    updates = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(F.when(F.col("toxic") == 1, "flagged").otherwise("")).alias("new_source"),
        F.max(F.when(F.col("quality") == 1, "reviewed").otherwise("")).alias("new_lang"))
    old = docs(spark, sf_dir).select("doc_id", "source", "lang")
    return batch.overlay(old, updates, ["source", "lang"])

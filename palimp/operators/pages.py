"""Page-level operators: ranges, groups, reordering, merging, tables of contents, naming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp import model
from palimp.functions.text import render_name, squeeze
from palimp.operators import ordered
from palimp.sources.surfaces import page_array


def parse_ranges(spec: Column, max_page: Column) -> Column:
    """'1-3, 5' to an array of (start, end); null when any part is invalid."""
    parts = F.filter(F.transform(F.split(spec, ",", -1), lambda p: F.btrim(p)), lambda p: p != "")

    def number(text: Column) -> Column:
        t = F.btrim(text)
        return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))

    def bounds(p: Column) -> Column:
        dashed = F.instr(p, "-") > 0
        start = F.when(dashed, number(F.regexp_extract(p, r"^([^-]*)-", 1))).otherwise(number(p))
        end = F.when(dashed, number(F.regexp_extract(p, r"^[^-]*-(.*)$", 1))).otherwise(number(p))
        return F.struct(start.alias("start"), end.alias("end"))

    found = F.transform(parts, bounds)
    valid = F.forall(found, lambda r: F.coalesce(
        (r["start"] >= 1) & (r["end"] <= max_page) & (r["start"] <= r["end"]), F.lit(False)))
    return F.when(valid, found)


def select_page_ranges(specs: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """specs(doc_id, n_pages, spec) to pages in the order written, repeats kept. No spec, or an empty one, means all pages; an
    invalid spec gives one error row, and so does one that names no page."""
    every = F.array(F.struct(F.lit(1).cast("bigint").alias("start"), F.col("n_pages").cast("bigint").alias("end")))
    found = F.when(F.coalesce("spec", F.lit("")) == "", every).otherwise(parse_ranges(F.col("spec"), F.col("n_pages")))
    parsed = specs.select("doc_id", found.alias("r"))
    pages = F.flatten(F.transform("r", lambda r: F.sequence(r["start"], r["end"])))
    wanted = parsed.select("doc_id", F.posexplode_outer(pages).alias("pos", "page_no")).where("page_no is not null")
    picked = wanted.join(doc_pages, ["doc_id", "page_no"]).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "page_no", "text", F.lit("ok").alias("status"))
    bad = parsed.where("r is null or size(r) = 0").select(
        "doc_id", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("page_no"),
        F.lit(None).cast("string").alias("text"), F.when(F.col("r").isNull(), "invalid range").otherwise("no page").alias("status"))
    return picked.unionByName(bad)


def page_groups(docs: DataFrame, mode: str, every_n: int = 1) -> DataFrame:
    """docs(doc_id, n_pages[, spec or chapters]) to (doc_id, grp, start, end, status) for mode all, every_n, ranges or chapters.

    ``spec`` is a range string, ``chapters`` an array of (start, end). A document whose ranges or chapters are missing or
    invalid gives one row with null numbers and the reason as its status. Other modes are refused.
    """
    if mode not in ("all", "every_n", "ranges", "chapters") or every_n < 1:
        raise ValueError(f"unknown mode {mode!r} or step {every_n}")
    n = F.col("n_pages")
    if mode == "ranges":
        found, given = parse_ranges(F.col("spec"), n), F.coalesce(F.btrim("spec"), F.lit("")) != ""
    elif mode == "chapters":
        given = F.coalesce(F.size("chapters"), F.lit(0)) > 0
        inside = F.forall("chapters", lambda c: F.coalesce((c["start"] >= 1) & (c["end"] <= n) & (c["start"] <= c["end"]), F.lit(False)))
        found = F.when(inside, F.transform("chapters", lambda c: F.struct(c["start"].cast("bigint").alias("start"), c["end"].cast("bigint").alias("end"))))
    else:
        step, given = 1 if mode == "all" else every_n, F.lit(True)
        found = F.transform(F.sequence(F.lit(1).cast("bigint"), n, F.lit(step).cast("bigint")), lambda s: F.struct(
            s.alias("start"), F.least(s + step - 1, n).alias("end")))
    status = F.when(~given, f"no {mode}").when(found.isNull(), f"invalid {mode}").otherwise("ok")
    rows = docs.select("doc_id", status.alias("status"), F.posexplode_outer(F.when(given, found)).alias("pos", "r"))
    return rows.where("r is not null or status <> 'ok'").select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("grp"), F.col("r.start").alias("start"), F.col("r.end").alias("end"), "status")


def assign_pages(groups: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Pages of each group; a document's groups may overlap. Joined on (doc_id, page_no), not by range. Rows in error have none."""
    wanted = groups.where("start is not null").withColumn("page_no", F.explode(F.sequence("start", "end"))).drop("status")
    return wanted.join(doc_pages, ["doc_id", "page_no"])


def page_operations(doc_pages: DataFrame, rotations: DataFrame, deletes: DataFrame, new_order: DataFrame) -> DataFrame:
    """Rotate by original number, then delete, then reorder by index into what remains.

    doc_pages(doc_id, page_no, rotation), rotations(doc_id, page_no, degrees), deletes(doc_id, page_no),
    new_order(doc_id, pos, idx) with idx from 0; documents without an order keep theirs.
    """
    turned = doc_pages.join(rotations, ["doc_id", "page_no"], "left").withColumn(
        "rotation", F.pmod(F.col("rotation") + F.coalesce("degrees", F.lit(0)), F.lit(360)).cast("bigint")).drop("degrees")
    kept = turned.join(deletes, ["doc_id", "page_no"], "left_anti")
    by_page = Window.partitionBy("doc_id").orderBy("page_no")
    remaining = kept.withColumn("idx", (F.row_number().over(by_page) - 1).cast("bigint"))
    reordered = remaining.join(new_order, ["doc_id", "idx"])
    natural = remaining.join(new_order.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("pos", F.col("idx"))
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    both = reordered.select("doc_id", "page_no", "rotation", "pos").unionByName(natural.select("doc_id", "page_no", "rotation", "pos"))
    return both.withColumn("out_page", F.row_number().over(by_pos).cast("bigint")).drop("pos")


def page_blocks(doc_pages: DataFrame) -> DataFrame:
    """Non-blank lines of each page; a page without any gives one placeholder."""
    blocks = F.filter(F.transform(F.split("text", "\n", -1), squeeze), lambda b: b != "")
    filled = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(F.lit(model.EMPTY_PAGE_TEXT)))
    return doc_pages.select("doc_id", "page_no", F.posexplode_outer(filled).alias("pos", "block")).select(
        "doc_id", "page_no", (F.col("pos") + 1).cast("bigint").alias("block_no"), "block")


def extract_text(doc_pages: DataFrame) -> DataFrame:
    """One text per document with a header before each page. A group is one document's own pages."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(
        F.lit("--- Page "), p["page_no"].cast("string"), F.lit(" ---\n"), p["text"], F.lit("\n"))), "\n")
    return doc_pages.groupBy("doc_id").agg(joined.alias("text"), F.count(F.lit(1)).alias("page_count")).withColumn(
        "char_count", F.length("text").cast("bigint"))


def extract_row_text(documents: DataFrame, lines_per_page: int = 10, spec: Column | None = None) -> DataFrame:
    """:func:`extract_text` from documents(doc_id, text) inside the row, without a shuffle. With ``spec``, a range string, only its
    pages in the order written; an invalid one gives a null text. A null text gives no row."""
    pages = page_array(F.col("text"), lines_per_page)
    n = F.size("pages").cast("bigint")
    every = F.sequence(F.lit(1).cast("bigint"), n)
    wanted = every if spec is None else F.when(F.coalesce(spec, F.lit("")) == "", every).otherwise(
        F.flatten(F.transform(parse_ranges(spec, n), lambda r: F.sequence(r["start"], r["end"]))))
    rows = documents.where(F.col("text").isNotNull()).withColumn("pages", pages).withColumn("wanted", wanted)
    parts = F.transform("wanted", lambda i: F.concat(F.lit("--- Page "), i.cast("string"), F.lit(" ---\n"), F.get("pages", (i - 1).cast("int")), F.lit("\n")))
    return rows.select("doc_id", F.array_join(parts, "\n").alias("text"), F.size("wanted").cast("bigint").alias("page_count")).withColumn(
        "char_count", F.length("text").cast("bigint"))


def merge_documents(inputs: list[DataFrame]) -> DataFrame:
    """Ordered bag union of two or more inputs of equal shape."""
    if len(inputs) < 2:
        raise ValueError("merging needs at least two inputs")
    return reduce(lambda a, b: a.unionByName(b), [
        d.withColumn("file_idx", F.lit(i).cast("bigint")) for i, d in enumerate(inputs)])


def page_offsets(docs: DataFrame, bundle: str, **chunking) -> DataFrame:
    """docs(bundle, doc_id, n_pages): pages before each document in its merged bundle."""
    return ordered.prefix_sum(docs, [bundle], "doc_id", "n_pages", "offset", **chunking)


def merge_renumber(docs: DataFrame, bundle: str, **chunking) -> DataFrame:
    """Every page of a bundle with its number in the merged output: a prefix sum per document, not per page."""
    shifted = page_offsets(docs, bundle, **chunking)
    return shifted.withColumn("page_no", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_pages"))).withColumn(
        "merged_page", F.col("offset") + F.col("page_no"))


def disambiguate(names: DataFrame, name: str, order: str, **chunking) -> DataFrame:
    """The n-th repeat of a file name gets ``_n`` before its extension."""
    counted = ordered.prefix_sum(names.withColumn("_one", F.lit(1).cast("bigint")), [name], order, "_one", "_before", **chunking)
    nth = F.col("_before") + 1
    root = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    ext = F.expr(f"substring({name}, length(regexp_replace({name}, '(.)[.][^.]*$', '$1')) + 1)")
    return counted.withColumn("out_name", F.when(nth > 1, F.concat(root, F.lit("_"), nth.cast("string"), ext)).otherwise(F.col(name))).drop("_one", "_before")


def output_names(groups: DataFrame, template: Column, base_name: Column, title: Column, ext: str = ".pdf") -> DataFrame:
    """Rendered file name per page group."""
    fields = {"name": base_name, "filename": base_name, "start": F.col("start"), "end": F.col("end"), "n": F.col("start"), "title": title}
    default = F.concat(base_name, F.lit("_page_"), F.col("start").cast("string"))
    return groups.withColumn("out_name", F.concat(render_name(template, fields, default), F.lit(ext)))


def toc_ranges(toc: DataFrame, last_pages: DataFrame, max_level: int | None = None, **chunking) -> DataFrame:
    """toc(doc_id, seq, level, page): an entry ends before the next later one of its level or above.

    Entries are first reduced to one row per (doc_id, seq), so that repeated positions stay cheap. The deepest level is
    counted in the table unless it is given; a level beyond a given one is an error.
    """
    deepest = toc.agg(F.max("level")).first()[0] if max_level is None else max_level
    max_level = max(int(deepest or 0), 0)
    toc = toc.withColumn("level", F.when(F.coalesce(F.col("level"), F.lit(0)) <= max_level, F.col("level")).otherwise(
        F.raise_error(F.lit(f"a level is deeper than {max_level}")).cast("bigint")))
    levels = [f"p{k}" for k in range(max_level + 1)]
    positions = toc.groupBy("doc_id", "seq").agg(*[
        F.min(F.when(F.col("level") <= k, F.col("page"))).alias(f"p{k}") for k in range(max_level + 1)])
    nexts = ordered.first_following(positions, ["doc_id"], "seq", levels, "_next", profile=toc, **chunking)
    nexts = nexts.select("doc_id", "seq", F.array(*[F.col(v + "_next") for v in levels]).alias("next_pages"))
    ended = toc.join(nexts, ["doc_id", "seq"]).join(last_pages, "doc_id")
    following = F.get("next_pages", F.greatest(F.col("level"), F.lit(0)).cast("int"))
    return ended.withColumn("end_page", F.greatest(F.coalesce(following - 1, F.col("last_page")), F.col("page"))).drop("next_pages", "last_page")


def filter_surfaces(surfaces: DataFrame, annotations: bool = True, forms: bool = True) -> DataFrame:
    """Drop form fields and all other annotations by two independent flags; other surfaces stay."""
    widget = F.col("surface") == "form_fields"
    annotation = F.col("surface").isin("annotations", "links")
    return surfaces.where(F.when(widget, F.lit(not forms)).when(annotation, F.lit(not annotations)).otherwise(F.lit(True)))

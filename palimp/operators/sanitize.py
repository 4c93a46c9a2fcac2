"""Rule-driven removal of active content, chain walking and structure clean-up."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp import model
from palimp.functions import patterns as P
from palimp.functions.markup import Attribute, Part, edited, parts
from palimp.functions.matching import slices
from palimp.session import checkpointed, ship_by_value

ship_by_value(__name__)

# Not characters: they stand for a linked-data script while other scripts are removed.
_OPEN, _MID, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"
LD_SCRIPT = r"(?is)<script([^>]*application/ld\+json[^>]*)>(.*?)</script[^>]*>"
_EXE = r"[.](?:exe|bat|cmd|msi|scr|ps1|vbs|jar)"
JS_HREF = r"""(?i)[ \t\r\n]href[ \t]*=[ \t]*(?:"[ \t\r\n]*javascript:[^"]*"|'[ \t\r\n]*javascript:[^']*')"""
LAUNCH_HREF = (r"(?i)[ \t\r\n]href[ \t]*=[ \t]*(?:" + rf'"[ \t\r\n]*(?:file:[^"]*|[^"]*{_EXE}(?:[?#][^"]*)?)[ \t\r\n]*"'
               + "|" + rf"'[ \t\r\n]*(?:file:[^']*|[^']*{_EXE}(?:[?#][^']*)?)[ \t\r\n]*')")
FORM_ACTION = r"""(?i)(<form[^>]*?)[ \t\r\n]action[ \t]*=[ \t]*(?:"[^"]*"|'[^']*')"""
DOWNLOAD = P.attribute("download")
LINK_OPEN = r"(?i)<a[ \t\r\n][^>]*href[^>]*>"
LINK_CLOSE = r"(?i)</a[ \t\r\n]*>"
TITLE_TEXT = r"(?is)(<title[^>]*>)[ \t\r\n]*[^< \t\r\n].*?(</title[^>]*>)"
NAMED_META = r"""(?i)<meta[^>]*[ \t\r\n](?:name|property)[ \t]*=[ \t]*["'][^>]*>"""

# switch -> steps of (kind, pattern, replacement); 'script' steps spare linked data.
STEPS = {
    "javascript": [("script", P.SCRIPT, ""), ("plain", JS_HREF, "")],
    "launch_actions": [("plain", LAUNCH_HREF, "")],
    "auto_actions": [("plain", P.HANDLER, ""), ("plain", P.META_REFRESH, "")],
    "embedded_files": [("plain", P.EMBED, ""), ("plain", P.OBJECT, ""), ("plain", DOWNLOAD, ""), ("plain", P.DATA_URI, '""')],
    "submit_actions": [("plain", FORM_ACTION, "$1")],
    "external_links": [("plain", LINK_OPEN, ""), ("silent", LINK_CLOSE, "")],
    "metadata": [("plain", TITLE_TEXT, "$1$2"), ("plain", NAMED_META, ""), ("plain", LD_SCRIPT, "")],
}


def enabled_steps(options: dict[str, bool]) -> list[tuple[str, str, str, str]]:
    """(switch, kind, pattern, replacement) in order. A handler runs script, so *javascript* alone drops it too."""
    steps = [(switch, *step) for switch, todo in STEPS.items() if options[switch] for step in todo]
    if options["javascript"] and not options["auto_actions"]:
        steps.append(("javascript", "plain", P.HANDLER, ""))
    return steps


#: Attributes that show their value as text, so that no scheme in it is followed.
SHOWN = {"alt", "title", "content", "value", "placeholder", "label", "aria-label"}
_EXE_URL = re.compile(rf"{_EXE}(?:[?#].*)?$")


def _attribute_edit(tag: Part, a: Attribute, on: set[str], counts: Counter) -> tuple[int, int, str] | None:
    """What a switch does to an attribute, however its value is quoted or encoded."""
    target = re.sub("[\x00-\x20]+", "", a.value).lower()  # blanks in a scheme are read over
    switch, start, new = None, a.start, ""
    if a.name not in SHOWN and target.startswith(("javascript:", "vbscript:")) and "javascript" in on:
        switch = "javascript"
    elif a.name == "href" and (target.startswith("file:") or _EXE_URL.search(target)) and "launch_actions" in on:
        switch = "launch_actions"
    elif re.fullmatch("on[a-z]+", a.name) and {"auto_actions", "javascript"} & on:
        switch = "auto_actions" if "auto_actions" in on else "javascript"
    elif a.name == "download" and "embedded_files" in on:
        switch = "embedded_files"
    elif a.name not in SHOWN and target.startswith("data:") and "embedded_files" in on:
        switch, start, new = "embedded_files", a.value_start, '""'
    elif (a.name == "formaction" or a.name == "action" and tag.name == "form") and a.value_start >= 0 and "submit_actions" in on:
        switch = "submit_actions"
    elif a.name == "srcdoc" and strictly(a.value, on)[0] != a.value:  # a page within the page
        switch = "javascript" if "javascript" in on else min(on)
    if switch is None:
        return None
    counts[switch] += 1
    return start, a.end, new


def _tag_switch(tag: Part, href: bool, on: set[str]) -> str | None:
    """The switch that drops a whole tag."""
    values = {a.name: a.value.strip().lower() for a in reversed(tag.attributes)}  # the first of a name counts
    if tag.name == "meta" and values.get("http-equiv") == "refresh" and "auto_actions" in on:
        return "auto_actions"
    if tag.name in ("embed", "object") and "embedded_files" in on:
        return "embedded_files"
    if tag.name == "a" and href and "external_links" in on:
        return "external_links"
    if tag.name == "meta" and ("name" in values or "property" in values) and "metadata" in on:
        return "metadata"
    return None


def strict_pass(page: str, on: set[str], counts: Counter, inert: bool = False) -> str:
    """One pass over the parts of a page."""
    edits: list[tuple[int, int, str]] = []
    dropping = False  # inside of a script that goes
    for p in parts(page, inert):
        if p.kind == "open" and p.name == "script":
            linked = any("application/ld+json" in a.value.lower() for a in p.attributes)
            switch = "metadata" if linked else "javascript"
            dropping = switch in on
            counts[switch] += dropping
        if p.name == "script" and dropping:
            edits.append((p.start, p.end, ""))
            dropping = p.kind != "close"
        elif p.kind == "open":
            mine = [e for a in p.attributes if (e := _attribute_edit(p, a, on, counts))]
            gone = {start for start, _, new in mine if not new}
            switch = _tag_switch(p, any(a.name == "href" and a.start not in gone for a in p.attributes), on)
            if switch:
                counts[switch] += 1
                mine = [(p.start, p.end, "")]
            edits += mine
        elif p.kind == "close" and p.name == "a" and "external_links" in on:
            edits.append((p.start, p.end, ""))
        elif p.kind == "raw" and p.name == "title" and "metadata" in on and page[p.start : p.end].strip():
            counts["metadata"] += 1
            edits.append((p.start, p.end, ""))
        elif p.kind == "comment" or p.kind == "raw" and p.name != "script":
            inside = strict_pass(page[p.start : p.end], on, counts, inert=True)
            if inside != page[p.start : p.end]:
                edits.append((p.start, p.end, inside))
    return edited(page, edits) if edits else page


def strictly(page: str, on: set[str]) -> tuple[str, Counter]:
    """Passes until nothing changes, as what is left of a removal may close up to new markup."""
    counts: Counter = Counter()
    while True:
        after = strict_pass(page, on, counts)
        if after == page:
            return page, counts
        page = after


def sanitize_documents(pages: DataFrame, options: dict[str, bool]) -> DataFrame:
    """(doc_id, html, removed map, total). The page's parts have the last word, whatever patterns have removed before.

    One projection per step, so each pattern runs on the result before it; then the page is read as browsers read it, with
    unquoted and unclosed values, entities, comments and raw text, and rewritten to a fixed point.
    """
    df = pages.select(F.col("page_id").alias("doc_id"), F.translate("html", _OPEN + _MID + _CLOSE, "").alias("html"))
    counted: dict[str, list[str]] = {s: [] for s in STEPS}
    for i, (switch, kind, pattern, replacement) in enumerate(enabled_steps(options)):
        html, name = F.col("html"), f"n{i}"
        if kind == "script":
            df = df.withColumn("html", F.regexp_replace(html, LD_SCRIPT, f"{_OPEN}$1{_MID}$2{_CLOSE}"))
        carried = [c for c in df.columns if c != "html"]
        replaced = F.regexp_replace(html, pattern, replacement)
        if kind == "silent":
            df = df.select(*carried, replaced.alias("html"))
            continue
        df = df.select(*carried, F.regexp_count(html, F.lit(pattern)).cast("bigint").alias(name), replaced.alias("html"))
        counted[switch].append(name)
        if kind == "script":
            df = df.withColumn("html", F.regexp_replace("html", f"{_OPEN}([^{_MID}]*){_MID}([^{_CLOSE}]*){_CLOSE}", "<script$1>$2</script>"))
    zero, on = F.lit(0).cast("bigint"), {o for o, enabled in options.items() if enabled}
    totals = [reduce(lambda a, b: a + b, [F.coalesce(F.col(n), zero) for n in names], zero).alias(s) for s, names in counted.items()]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [(None, Counter()) if page is None else strictly(page, on) for page in batch.column("html").to_pylist()]
            more = [pa.array([n + c[s] for n, (_, c) in zip(batch.column(s).to_pylist(), done)], pa.int64()) for s in STEPS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([page for page, _ in done], pa.string()), *more], ["doc_id", "html", *STEPS])

    df = df.select("doc_id", "html", *totals)
    df = df.mapInArrow(rewrite, df.schema)
    removed = F.map_from_arrays(F.array(*[F.lit(s) for s in STEPS]), F.array(*STEPS))
    return df.select("doc_id", "html", removed.alias("removed"), reduce(lambda a, b: a + b, [F.col(s) for s in STEPS]).alias("total"))


def chain_walk(edges: DataFrame, heads: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from heads(doc_id, node_id, kind) by edges(doc_id, node_id, next_id, kind), with their depth and the path of kinds.

    Where every node has one successor, as in a chain, steps double: each round joins the table of visited nodes with jumps of
    1, 2, 4.. links and the jumps with themselves, so a chain of n links takes log2(n) rounds. Where nodes branch, one join per
    step. Chains are walked to their end unless ``max_depth`` is given. A node already visited keeps its least depth, so cycles
    end. Every round is checkpointed, and a lost executor does not replay the walk.
    """
    links = checkpointed(edges.select("doc_id", "node_id", "next_id").where("next_id is not null").distinct())
    kinds = checkpointed(edges.groupBy("doc_id", F.col("node_id").alias("next_id")).agg(F.min("kind").alias("next_kind")))
    start = checkpointed(heads.select("doc_id", "node_id", F.lit(0).cast("bigint").alias("depth"), F.col("kind").alias("path"), "kind").distinct())
    if not links.groupBy("doc_id", "node_id").count().where("count > 1").isEmpty():
        return _walk_by_steps(links, kinds, start, max_depth)
    first = F.struct("depth", "path", "kind")
    visited = checkpointed(start.groupBy("doc_id", "node_id").agg(F.min(first).alias("at")).select("doc_id", "node_id", "at.*"))
    jumps = checkpointed(links.join(kinds, ["doc_id", "next_id"]).select("doc_id", "node_id", "next_id", F.concat(F.lit(" > "), "next_kind").alias("label"), "next_kind"))
    known, span = visited.count(), 1
    while max_depth is None or span <= max_depth:
        ahead = visited.join(jumps, ["doc_id", "node_id"]).select(
            "doc_id", F.col("next_id").alias("node_id"), (F.col("depth") + span).alias("depth"), F.concat("path", "label").alias("path"), F.col("next_kind").alias("kind"))
        if max_depth is not None:
            ahead = ahead.where(F.col("depth") <= max_depth)
        visited = checkpointed(visited.unionByName(ahead).groupBy("doc_id", "node_id").agg(F.min(first).alias("at")).select("doc_id", "node_id", "at.*"))
        n = visited.count()
        if n == known:
            break
        onward = jumps.select("doc_id", F.col("node_id").alias("next_id"), F.col("next_id").alias("after"), F.col("label").alias("more"), F.col("next_kind").alias("after_kind"))
        jumps = checkpointed(jumps.join(onward, ["doc_id", "next_id"]).select(
            "doc_id", "node_id", F.col("after").alias("next_id"), F.concat("label", "more").alias("label"), F.col("after_kind").alias("next_kind")))
        known, span = n, 2 * span
    return visited


def _walk_by_steps(links: DataFrame, kinds: DataFrame, start: DataFrame, max_depth: int | None) -> DataFrame:
    frontier = start
    visited = checkpointed(start.select("doc_id", F.col("node_id").alias("next_id")).distinct())
    reached = [frontier]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        stepped = frontier.join(links, ["doc_id", "node_id"]).join(visited, ["doc_id", "next_id"], "left_anti").join(kinds, ["doc_id", "next_id"])
        frontier = checkpointed(stepped.groupBy("doc_id", F.col("next_id").alias("node_id")).agg(
            F.lit(depth).cast("bigint").alias("depth"), F.min(F.concat("path", F.lit(" > "), "next_kind")).alias("path"), F.min("next_kind").alias("kind")))
        if frontier.isEmpty():
            break
        visited = checkpointed(visited.unionByName(frontier.select("doc_id", F.col("node_id").alias("next_id"))))
        reached.append(frontier)
    return reduce(lambda a, b: a.unionByName(b), reached)


ROOT = -1


def excise_chain(edges: DataFrame, heads: DataFrame, flagged: list[str], max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop flagged nodes and hang their surviving tail on the node before them.

    Returns links(doc_id, node_id, next_id), where node -1 stands before the head, and drops by kind.
    """
    walked = checkpointed(chain_walk(edges, heads, max_depth))
    bad = walked.where(F.col("kind").isin(flagged)).select("doc_id", F.col("node_id").alias("next_id")).withColumn("bad", F.lit(True))
    alive = walked.select("doc_id", F.col("node_id").alias("next_id"))
    inside = edges.select("doc_id", "node_id", "next_id").distinct().join(alive, ["doc_id", "next_id"], "left_semi")
    inside = checkpointed(inside.join(walked.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").join(bad, ["doc_id", "next_id"], "left"))
    starts = heads.select("doc_id", F.lit(ROOT).cast("bigint").alias("node_id"), F.col("node_id").alias("next_id")).distinct().join(bad, ["doc_id", "next_id"], "left")
    good_sources = inside.join(bad.select("doc_id", F.col("next_id").alias("node_id")), ["doc_id", "node_id"], "left_anti")
    pending = good_sources.unionByName(starts)
    kept = pending.where("bad is null").select("doc_id", "node_id", "next_id")
    into_bad = checkpointed(pending.where("bad").select("doc_id", "node_id", "next_id"))
    # Where a run of flagged nodes leads: their links, doubled until all end at a node that stays. Runs that go in circles end nowhere.
    onward = inside.join(bad.select("doc_id", F.col("next_id").alias("node_id")), ["doc_id", "node_id"], "left_semi").select(
        "doc_id", F.col("node_id").alias("via"), F.col("next_id").alias("after"), F.coalesce("bad", F.lit(False)).alias("bad"))
    onward = checkpointed(onward)
    n_open, span = onward.where("bad").count(), 1
    while n_open and span <= 2 * n_open:
        further = onward.select("doc_id", F.col("via").alias("after"), F.col("after").alias("last"), F.col("bad").alias("last_bad"))
        moved = onward.where("bad").join(further, ["doc_id", "after"]).select("doc_id", "via", F.col("last").alias("after"), F.col("last_bad").alias("bad"))
        onward = checkpointed(onward.where("not bad").unionByName(moved).distinct())
        if onward.where("bad").isEmpty():
            break
        span *= 2
    led = into_bad.withColumnRenamed("next_id", "via").join(onward.where("not bad"), ["doc_id", "via"]).select("doc_id", "node_id", F.col("after").alias("next_id"))
    links = kept.unionByName(led).distinct()
    drops = walked.where(F.col("kind").isin(flagged)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("dropped"))
    return links, drops


def low_value_part(surface: Column, field: Column, value: Column) -> Column:
    """Class of a surface that clean-up may drop, else null."""
    return (
        F.when((surface == "annotations") & (field == "comment"), "private")
        .when((surface == "form_fields") & (F.coalesce(value, F.lit("")) == ""), "empty_form")
        .when((surface == "embedded_files") & (field == "data"), "thumbnail")
        .when((surface == "annotations") & field.isin("alt", "aria-label"), "accessibility")
        .when(((surface == "docinfo") & (field != "url")) | (surface == "xmp"), "metadata")
    )


# Parts that every preset drops, and those only stripping presets drop.
ALWAYS_DROPPED = ["private", "empty_form", "thumbnail"]
STRIP_DROPPED = ["accessibility", "metadata"]


def structure_cleanup(surfaces: DataFrame) -> DataFrame:
    """Surfaces kept and dropped per document and preset. Aggregated by the two kinds of preset, then spread."""
    part = low_value_part(F.col("surface"), F.col("field"), F.col("value"))
    rows = surfaces.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.length("value").alias("chars"))
    def totals(dropped: list[str], name: str) -> list[Column]:
        d = F.col("part").isin(dropped)
        return [F.count_if(~d).alias(f"kept_{name}"), F.count_if(d).alias(f"dropped_{name}"), F.sum(F.when(d, F.col("chars")).otherwise(0)).cast("bigint").alias(f"chars_{name}")]
    agg = rows.groupBy("doc_id").agg(*totals(ALWAYS_DROPPED, "keep"), *totals(ALWAYS_DROPPED + STRIP_DROPPED, "strip"))
    def of(preset: tuple) -> Column:
        name = "strip" if preset[6] else "keep"
        return F.struct(F.lit(preset[0]).alias("preset"), F.col(f"kept_{name}").alias("kept"), F.col(f"dropped_{name}").alias("dropped"), F.col(f"chars_{name}").alias("dropped_chars"))
    return agg.select("doc_id", F.inline(F.array(*[of(p) for p in model.PRESETS])))

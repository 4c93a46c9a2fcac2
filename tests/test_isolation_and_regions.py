"""Scanners and operations that fail alone, regions proved on written pages, and the terms' automaton."""

import random

import pytest
from pyspark.sql import functions as F

from palimp import model
from palimp.functions.matching import Matcher
from palimp.operators import audit, batch, lookup, pages as page_ops, redact, verify
from palimp.sources.surfaces import paginate


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a.example/x", "<p>plain</p>"), (2, "https://a.example/", "<script>x</script>"), (3, "https://a.example/", None), (4, "https://a.example/", "boom")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_a_failing_scanner_loses_its_own_finding_only(pages):
    def finding(fid, **other):
        return {"id": fid, "category": "content", "severity": "high", "title": "t", "count": 1, "items": ["i"]} | other

    def raises(html, url):
        if html == "boom":
            raise ValueError("b" * 300)
        return [finding("own.a")]

    scanners = {"raises": raises, "wrong": lambda html, url: [{"id": "x"}], "typed": lambda html, url: [finding("own.c", count="many")], "fine": lambda html, url: [finding("own.b")]}
    out = audit.audit_with_scanners(pages, scanners)
    got = {r.doc_id: r for r in out.collect()}
    ids = {i: [f.id for f in r.findings] for i, r in got.items()}
    assert ids == {1: ["own.a", "own.b"], 2: ["scripts.js", "own.a", "own.b"], 3: ["encryption.locked"], 4: ["own.b"]}
    letters = {(r.doc_id, r.scanner): r.error for r in audit.dead_letters(out).collect()}
    assert {k for k in letters if k[0] == 4} == {(4, "raises"), (4, "wrong"), (4, "typed")} and letters[4, "raises"] == "b" * audit.ERROR_CHARS
    assert not any(k[0] == 3 for k in letters) and (1, "raises") not in letters
    plain = audit.audit_with_scanners(pages, {})
    assert {r.doc_id: [f.id for f in r.findings] for r in plain.collect()}[1] == ["clean"]


def test_an_operation_that_raises_costs_its_row(spark):
    rows = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "k bigint, n bigint")
    got = {r.k: (r.status, r.message, r.result) for r in batch.isolated(rows, "k", lambda r: 10 // r["n"]).collect()}
    assert got[1] == ("ok", "", 5) and got[2][:1] == ("error",) and "zero" in got[2][1] and got[3][0] == "error"
    assert batch.isolated(rows.limit(0), "k", lambda r: 1).count() == 0


TEXT = "Ann knows a secret and a long secret here."


def test_regions_move_with_what_is_cut():
    m = Matcher(["secret", "long secret"])
    text, n, moved = redact.blank_and_cut(TEXT, [(0, 3), (38, 41)], m, "█")
    assert text == "    knows a █ and a █ h   ." and n == 3
    assert [(r["new_s"], r["new_e"]) for r in moved] == [(0, 3), (23, 26)]
    assert all(text[r["new_s"] : r["new_e"]].strip() == "" for r in moved)
    text, _, moved = redact.blank_and_cut("top\nhat", [(3, 5)], Matcher(["top hat", "at"]), "█")
    assert text == "top  █" and text[moved[0]["new_s"] : moved[0]["new_e"]] == "  "
    text, _, moved = redact.blank_and_cut("a b c", [(1, 2)], Matcher(["a b"]), "█")  # a term runs over the region
    assert text == "█  c" and text[moved[0]["new_s"] : moved[0]["new_e"]] == " "


def test_regions_and_terms_in_one_report(spark):
    pages = spark.createDataFrame([(i, 1, TEXT) for i in range(6)] + [(6, 1, None), (7, 1, "")], "doc_id bigint, page_no bigint, text string")
    regions = spark.createDataFrame(
        [(0, 1, 0, 3), (1, 1, 0, 99), (2, 2, 0, 1), (3, 1, None, 3), (4, 1, 5, 5), (4, 1, 0, 3), (6, 1, 0, 1)], "doc_id bigint, page_no bigint, s bigint, e bigint")
    terms = spark.createDataFrame([("secret",)], "term string")
    docs = pages.select("doc_id")
    for bound in (1000, 0):
        released, quarantined, report = verify.fail_closed_release(pages, docs, terms, regions=regions, bound=bound)
        status = {r.doc_id: (r.status, list(r.failed)) for r in report.collect()}
        bad = ("quarantined", ["redaction.region"])
        assert status == {0: ("released", []), 1: bad, 2: bad, 3: bad, 4: bad, 5: ("released", []), 6: ("quarantined", ["redaction.readable", "redaction.region"]), 7: ("no_match", [])}
        assert {r.text for r in released.where("doc_id = 0").collect()} == {"    knows a █ and a long █ here."}
        assert quarantined.select("doc_id").distinct().count() == 5
    written = redact.redact_terms_and_regions(pages, terms, regions)
    checked = verify.region_checks(redact.moved_regions(regions, written), written.select("doc_id", "page_no", "text"), written.groupBy("doc_id").agg(F.max("page_no").alias("n_pages")))
    got = {(r.doc_id, r.s): r.status for r in checked.collect()}
    assert got[0, 0] == "clean" and got[1, 0] == "invalid" and got[2, 0] == "out_of_range" and got[3, None] == "malformed" and got[4, 5] == "invalid" and got[6, 0] == "unreadable"
    assert verify.region_checks(regions, pages, written.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))).where("status = 'text_found'").count() == 2


def test_automaton_equals_search_term_by_term():
    rng = random.Random(2)
    letters = ["a", "B", "ß", "é", "É", " ", "\n", "-\n", "ſ"]
    for _ in range(200):
        text = "".join(rng.choice(letters) for _ in range(30))
        terms = ["".join(rng.choice(letters[:6]) for _ in range(rng.randint(1, 3))) for _ in range(6)]
        terms = sorted({t for t in terms if t.strip()})
        squeeze = lambda t: " ".join(t.split())
        fold = lambda t: "".join(c.upper().lower() for c in t)
        views = [fold(squeeze(text)), fold(squeeze(text.replace("-\n", "")))]
        m = Matcher(terms)
        assert m.found(text, "page_text") == [t for t in terms if any(fold(squeeze(t)) in v for v in views)]
        spans, _ = m.chosen(text, "page_text")
        left = redact.without(text, spans, model.REDACTION_MARK)
        assert not m.spans(left, "page_text"), (text, terms, left)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_ranges_and_chapters_in_error_say_so(spark):
    docs = spark.createDataFrame(
        [(1, 5, "2-3, 1", [(1, 2), (3, 5)]), (2, 5, "x-y", [(0, 2)]), (3, 5, "", []), (4, 5, None, None), (5, 5, " , ", [(4, 9)]), (6, 5, "3-9", [(2, None)])],
        "doc_id bigint, n_pages bigint, spec string, chapters array<struct<start: bigint, end: bigint>>")
    got = lambda mode: {(r.doc_id, r.grp, r.start, r.end, r.status) for r in page_ops.page_groups(docs, mode).collect()}
    assert got("ranges") == {(1, 1, 2, 3, "ok"), (1, 2, 1, 1, "ok"), (2, None, None, None, "invalid ranges"), (3, None, None, None, "no ranges"),
                             (4, None, None, None, "no ranges"), (6, None, None, None, "invalid ranges")}
    assert {r for r in got("chapters") if r[0] != 1} == {(2, None, None, None, "invalid chapters"), (3, None, None, None, "no chapters"), (4, None, None, None, "no chapters"),
                                                        (5, None, None, None, "invalid chapters"), (6, None, None, None, "invalid chapters")}
    pages = spark.createDataFrame([(d, p, f"{d}.{p}") for d in range(1, 7) for p in range(1, 6)], "doc_id bigint, page_no bigint, text string")
    picked = page_ops.select_page_ranges(docs.select("doc_id", "n_pages", "spec"), pages).collect()
    assert [r.text for r in sorted(picked, key=lambda r: r.pos or 0) if r.doc_id == 1] == ["1.2", "1.3", "1.1"]
    assert {r.doc_id: r.status for r in picked if r.status != "ok"} == {2: "invalid range", 5: "no page", 6: "invalid range"}
    assert sum(r.doc_id in (3, 4) for r in picked) == 10


def test_text_inside_the_row_equals_text_of_pages(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(23)))), (2, ""), (3, None)], "doc_id bigint, text string")
    rows = {tuple(r) for r in page_ops.extract_row_text(docs).collect()}
    assert rows == {tuple(r) for r in page_ops.extract_text(paginate(docs)).collect()} and len(rows) == 2
    picked = {r.doc_id: r for r in page_ops.extract_row_text(docs, spec=F.lit("3, 1")).collect()}
    assert picked[1].page_count == 2 and picked[1].text.startswith("--- Page 3 ---\n20\n21\n22\n") and picked[2].text is None
    assert "Exchange" not in page_ops.extract_row_text(docs)._jdf.queryExecution().executedPlan().toString()


def test_when_an_action_runs(spark):
    rows = spark.createDataFrame([("Catalog /OpenAction /Next", "URI"), ("Page 1 /AA /WC /Next", "JavaScript"), ("Field /AA /Zz", "?"), ("Field /AA", "Launch"), ("Link /A", "Named")], "w string, a string")
    got = {r.w: r.description.split(" — ")[1] for r in lookup.describe_autorun(rows, F.col("w"), F.col("a")).collect()}
    assert got == {"Catalog /OpenAction /Next": "fires as soon as the document is opened; opens a URL", "Page 1 /AA /WC /Next": "fires just before the document is closed; runs embedded JavaScript",
                   "Field /AA /Zz": "fires on the Zz event; runs an action", "Field /AA": "fires automatically; launches an external program or file",
                   "Link /A": "fires automatically; runs a named viewer command"}

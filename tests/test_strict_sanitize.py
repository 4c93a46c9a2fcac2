"""Active content that quoted patterns do not see, and a proof that does not share code with the removal."""

import pytest
from pyspark.sql import functions as F

from palimp import model
from palimp.functions.markup import parts
from palimp.operators import audit, sanitize, verify

EVERY = {o: True for o in model.SANITIZE_SWITCHES}
# page, what is left of it
PAGES = [
    ("<div onclick=evil()>x</div>", "<div>x</div>"),
    ("<p>a</p><script src=x.js>", "<p>a</p>"),
    ("<scr<script></script>ipt>alert(1)</script>", ""),
    ("<img src=x onerror=evil()", "<img src=x"),
    ("<a href=&#106;ava&#x09;script:evil()>k</a>", "k"),
    ('<!-- <b title="--> <script>evil()</script>">', '<!-- <b title="--> ">'),
    ('<iframe srcdoc="&lt;script&gt;x&lt;/script&gt;"></iframe>', "<iframe></iframe>"),
    ('<b title=">" onclick=x>ok</b>', '<b title=">">ok</b>'),
    ("<textarea><script>a</script></textarea>", "<textarea></textarea>"),
    ("<svg/onload=evil()>", "<svg>"),
    ("<form action=/x><button formaction=/y>", "<form><button>"),
    ("<p>5 < 6 and 7 > 2</p>", "<p>5 < 6 and 7 > 2</p>"),
    ("<TITLE> a </TITLE>", "<TITLE></TITLE>"),
    ('<img alt="javascript: x" src=data:a>', '<img alt="javascript: x" src="">'),
    ("<META HTTP-EQUIV=refresh content=0><object data=a></object>", "</object>"),
    ("<style>p{}</style>" + "<b onclick=a " * 3000 + ">", None),
    ("", ""), (None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, "https://a.example/p", p) for i, (p, _) in enumerate(PAGES)], "page_id bigint, url string, html string")


def signs(pages):
    return {(r.doc_id, r.id) for r in verify.active_evidence(pages).collect()}


def test_nothing_active_is_left(spark, pages):
    out = sanitize.sanitize_documents(pages, EVERY).cache()
    got = {r.doc_id: r for r in out.collect()}
    for i, (_, left) in enumerate(PAGES):
        if left is not None:
            assert got[i].html == left, i
    assert got[0].removed["auto_actions"] == 1 and got[1].removed["javascript"] == 1 and got[10].total == 2
    assert got[len(PAGES) - 1].html is None and got[len(PAGES) - 1].total == 0
    before = signs(pages)
    assert {i for i, _ in before} >= {0, 1, 3, 4, 7, 9, 10, 13, 14}
    written = out.select(F.col("doc_id").alias("page_id"), F.lit("https://a.example/p").alias("url"), "html")
    assert signs(written) == set()
    again = sanitize.sanitize_documents(written, EVERY)
    assert sorted(again.select("doc_id", "html").collect(), key=str) == sorted(out.select("doc_id", "html").collect(), key=str)


def test_switches_work_alone(spark, pages):
    off = {o: False for o in EVERY}
    plain = {r.page_id: r.html for r in pages.collect()}
    assert {r.doc_id: r.html for r in sanitize.sanitize_documents(pages, off).collect()} == plain
    only = {r.doc_id: r.html for r in sanitize.sanitize_documents(pages, off | {"auto_actions": True}).collect()}
    assert only[0] == "<div>x</div>" and only[1] == PAGES[1][0] and only[10] == PAGES[10][0]
    js = {r.doc_id: r.removed for r in sanitize.sanitize_documents(pages, off | {"javascript": True}).collect()}
    assert js[0]["javascript"] == 1  # a handler runs script


def test_proof_fails_where_something_is_left(spark, pages):
    findings = verify.sanitization_findings(pages, audit.explode_findings(audit.audit_pages(pages)))
    docs = pages.select(F.col("page_id").alias("doc_id"))
    failed = {r.doc_id for r in verify.promise_checks(docs, findings, EVERY).where("not passed").collect()}
    assert failed >= {0, 1, 3, 4, 7, 9, 10, 13, 14, len(PAGES) - 1} and 11 not in failed


def test_parts_cover_every_page(spark):
    for page, _ in PAGES:
        for inert in (False, True):
            found = list(parts(page or "", inert))
            assert "".join((page or "")[p.start : p.end] for p in found) == (page or "")


def test_audit_sees_unquoted_values(spark, pages):
    found = {(r.doc_id, r.id) for r in audit.explode_findings(audit.audit_pages(pages)).collect()}
    assert {(0, "actions.autorun"), (3, "actions.autorun"), (10, "forms.submit")} <= found

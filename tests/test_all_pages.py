"""Redaction and its proof over all pages: nothing that is removed from page 1 stays on a later one."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_oracles import TABLES, rows

NAMES = ["verify_redaction", "verified_docs", "failed_pages", "suppression_targets", "fail_closed_release", "suppress_pages", "stream_redact_release"]


@pytest.mark.parametrize("name", [f"{n}_all_pages" for n in NAMES])
def test_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    expected = con.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_later_pages_are_redacted_and_released(spark, sf_dir):
    got = entry.queries()["fail_closed_release_all_pages"](spark, sf_dir).where("status <> 'no_match'")
    assert got.where("page_no > 1 and contains(text, '\u2588')").count() > 0
    assert got.where("status <> 'released' or lower(text) like '%token%'").count() == 0

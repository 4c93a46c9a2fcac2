"""Every query with an oracle gives the rows DuckDB gives on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# One per operator family; tools/check.py compares all of them.
NAMES = ["audit_documents", "select_page_ranges", "toc_ranges", "compare_pages", "redact_terms", "check_evidence",
         "scrub_surfaces", "sanitize_documents", "preset_whatif", "audit_image_tags", "detect_language", "literal_spans",
         "chain_walk", "unprotect_columns", "stream_op_metrics"]


def text(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    expected = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Queries that an earlier round had made smaller do their whole job again."""

import duckdb

import __spark_entry__ as entry
from test_oracles import rows


def write_events(spark, folder):
    spark.sql("""select * from values (timestamp_ntz '2024-01-01 10:05:00', 1L, 'click'), (timestamp_ntz '2024-01-01 10:59:59', 6L, 'error'),
      (timestamp_ntz '2024-01-01 23:30:00', 3L, 'error'), (timestamp_ntz '2024-01-01 23:40:00', 3L, null), (cast(null as timestamp_ntz), 2L, 'click')
      as t(ts, user_id, event_type)""").write.parquet(f"{folder}/events.parquet")


def test_every_hour_counts_also_the_last(spark, tmp_path):
    write_events(spark, tmp_path)
    got = entry.queries()["stream_op_metrics"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    expected = con.sql(entry.oracle_sql()["stream_op_metrics"])
    assert rows(got.columns, got.collect()) == rows(expected.columns, expected.fetchall())
    assert {(r.hour, r.tool, r.done, r.failed) for r in got.collect()} == {
        ("2024-01-01 10:00:00", 1, 1, 1), ("2024-01-01 23:00:00", 3, 0, 1), (None, 2, 1, 0)}


def test_suppression_comes_after_the_whole_removal(spark, sf_dir):
    """Terms in other letters are cut; no page has to lose its text for them."""
    whole = entry.queries()["suppress_pages_all_pages"](spark, sf_dir)
    cased = entry.queries()["suppress_pages"](spark, sf_dir)
    assert whole.where("lower(text) like '%token%' or lower(text) like '%the%'").count() == 0
    assert whole.where("contains(text, '█')").count() > cased.where("contains(text, '█')").count()

"""The plans of images leave no image out."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_oracles import TABLES, rows


@pytest.mark.parametrize("name", ["asset_extract_plan_all_sizes", "asset_skip_reason_all_sizes", "asset_encode_route_all_presets"])
def test_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    expected = con.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_every_image_has_a_row(spark, sf_dir):
    q = entry.queries()
    assert q["asset_extract_plan_all_sizes"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    plans = q["asset_encode_route_all_presets"](spark, sf_dir)
    assert plans.count() == 5 * q["asset_features"](spark, sf_dir).count() and plans.where("outcome = 'skipped_bomb'").count() > 0

"""Input tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables with much work per row.
SPREAD_TABLES = {"documents", "pages", "conversations", "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in SPREAD_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table that comes in fewer splits than there are cores.

    A small file is often one row group and would keep one core busy. A large table has more splits than
    cores and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


ASSETS_SQL = """
select l_orderkey as doc_id, cast(l_linenumber as bigint) as page_no, l_partkey as obj_id, pixel_w, pixel_h, codec,
 cast(bits as bigint) as bits, is_gray, display_w_pts, display_h_pts,
 cast(floor(pixel_w * pixel_h * (case when is_gray then 1 else 3 end) * ((l_orderkey % 45) + 1) / 100.0) as bigint) as raw_size,
 n_colors, variance, has_mask from (
 select l_orderkey, l_linenumber, l_partkey,
  cast(case when l_quantity <= 2 then 4 + l_partkey % 60 when l_quantity = 50 and l_partkey % 7 = 0 then 20000 else 8 + (l_partkey * 37) % 3000 end as bigint) as pixel_w,
  cast(case when l_quantity <= 2 then 4 + l_suppkey % 60 when l_quantity = 50 and l_partkey % 7 = 0 then 12000 else 8 + (l_suppkey * 53 + l_linenumber * 211) % 2400 end as bigint) as pixel_h,
  case l_orderkey % 6 when 0 then 'FlateDecode' when 1 then 'JPXDecode' else 'DCTDecode' end as codec,
  case when l_suppkey % 10 = 0 then 1 else 8 end as bits, l_suppkey % 4 = 0 as is_gray,
  cast(case when l_orderkey % 5 = 0 then 0 else 72 + (l_orderkey * 13) % 540 end as double) as display_w_pts,
  cast(case when l_orderkey % 5 = 0 then 0 else 72 + (l_partkey * 17) % 720 end as double) as display_h_pts,
  l_partkey % 600 as n_colors, (l_suppkey * 7) % 300 as variance, l_partkey % 7 = 3 as has_mask
 from {lineitem}) t
"""

ROUTES_SQL = """
select distinct cast(src as bigint) as src, cast(dst as bigint) as dst from (
 select n_nationkey as src, 0 as dst from {nation} where n_nationkey % 3 <> 0
 union all select 0, n_nationkey from {nation} where n_nationkey % 2 = 1
 union all select n_nationkey, (n_nationkey + 1) % 25 from {nation} where n_nationkey % 5 = 0) r where src <> dst
"""

EXIF_SQL = """
select p_partkey as image_id, 'gps' as ifd, 'lat' as tag, concat(cast(p_partkey % 90 as {string}), ',', cast(p_size % 60 as {string}), ',', cast(p_partkey % 60 as {string})) as value from {part} where p_partkey % 7 = 0
union all select p_partkey, 'gps', 'lat_ref', case when p_size % 2 = 0 then 'N' else 's' end from {part} where p_partkey % 7 = 0
union all select p_partkey, 'gps', 'lon', concat(cast(p_partkey % 180 as {string}), ',', cast(p_size % 60 as {string}), ',30') from {part} where p_partkey % 14 = 0
union all select p_partkey, 'gps', 'lon_ref', case when p_size % 3 = 0 then 'E' else 'W' end from {part} where p_partkey % 14 = 0
union all select p_partkey, 'ifd0', 'Make', p_brand from {part} where p_partkey % 3 = 0
union all select p_partkey, 'ifd0', 'Model', p_type from {part} where p_partkey % 6 = 0
union all select p_partkey, 'ifd0', 'Artist', p_name from {part} where p_partkey % 11 = 0
union all select p_partkey, 'ifd1', '513', '1' from {part} where p_partkey % 5 = 0
"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image inventory derived from ``lineitem`` by integer expressions."""
    return spark.sql(ASSETS_SQL.format(lineitem="{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed language routes derived from ``nation``; 0 is the hub."""
    return spark.sql(ROUTES_SQL.format(nation="{nation}"), nation=table(spark, sf_dir, "nation"))


def exif_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tags (image_id, ifd, tag, value) derived from ``part``."""
    return spark.sql(EXIF_SQL.format(part="{part}", string="string"), part=table(spark, sf_dir, "part"))


def asset_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, overhead): one row per order; its file holds its distinct assets' bytes and a fixed part."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return docs.withColumn("overhead", 10000 + F.col("doc_id") % 1000)

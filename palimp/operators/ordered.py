"""Order-aware operators that never hold one whole key in one task.

A window partitioned by a key alone puts that key's rows into a single task. Here the order column is
first cut into chunks of bounded size at approximate quantiles of the whole table. The window then runs
per (key, chunk), a summary of one row per (key, chunk) carries state across chunks, and the two are
joined on (key, chunk). Tables that fit into one chunk take the plain window.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
ROWS_PER_CHUNK = 2_000_000


def with_chunks(df: DataFrame, order: str, rows_per_chunk: int = ROWS_PER_CHUNK,
                profile: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Add the chunk number of ``order``; also tells whether there is more than one chunk.

    ``profile`` is a cheaper frame with the same distribution of ``order`` to take the quantiles from.
    """
    base = (profile if profile is not None else df).select(order)
    chunks = math.ceil(base.count() / rows_per_chunk)
    if chunks > 1:
        shares = [i / chunks for i in range(1, chunks)]
        cuts = sorted(set(base.approxQuantile(order, shares, 1.0 / (8 * chunks))))
        if cuts:
            splits = [float("-inf"), *cuts, float("inf")]
            bucketizer = Bucketizer(splits=splits, inputCol="_order", outputCol=CHUNK)
            cut = bucketizer.transform(df.withColumn("_order", F.col(order).cast("double")))
            return cut.drop("_order").withColumn(CHUNK, F.col(CHUNK).cast("int")), True
    return df.withColumn(CHUNK, F.lit(0)), False


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, **chunking) -> DataFrame:
    """Exclusive running sum of ``value`` per key in ``order``."""
    cut, many = with_chunks(df, order, **chunking)
    before = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    inner = F.coalesce(F.sum(value).over(before), zero)
    if not many:
        plain = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(plain), zero))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_total")).select(
        *keys, CHUNK, F.coalesce(F.sum("_total").over(earlier), zero).alias("_carried"))
    return cut.withColumn("_inner", inner).join(carried, [*keys, CHUNK]).withColumn(
        out, F.col("_inner") + F.col("_carried")).drop("_inner", "_carried", CHUNK)


def next_value(df: DataFrame, keys: list[str], order: str, value: str, out: str, **chunking) -> DataFrame:
    """``value`` of the following row of the same key, null on the last."""
    cut, many = with_chunks(df, order, **chunking)
    if not many:
        return df.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(order)))
    within = Window.partitionBy(*keys, CHUNK).orderBy(order)
    firsts = cut.groupBy(*keys, CHUNK).agg(F.min_by(value, order).alias("_first"))
    carried = firsts.select(*keys, CHUNK, F.lead("_first").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_carried"))
    return cut.withColumn("_inner", F.lead(value).over(within)).join(carried, [*keys, CHUNK]).withColumn(
        out, F.coalesce("_inner", "_carried")).drop("_inner", "_carried", CHUNK)


def first_following(df: DataFrame, keys: list[str], order: str, values: list[str], suffix: str, **chunking) -> DataFrame:
    """For each value column the first non-null one on a later row of the same key.

    The frame runs over descending order, so it grows row by row instead of being rebuilt.
    ``order`` must be unique per key.
    """
    cut, many = with_chunks(df, order, **chunking)
    part = [*keys, CHUNK] if many else keys
    later = Window.partitionBy(*part).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    scanned = cut.withColumns({v + suffix: F.last(v, ignorenulls=True).over(later) for v in values})
    if not many:
        return scanned.drop(CHUNK)
    firsts = cut.groupBy(*keys, CHUNK).agg(*[
        F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias("_f_" + v) for v in values])
    later_chunks = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(*keys, CHUNK, *[F.last("_f_" + v, ignorenulls=True).over(later_chunks).alias("_c_" + v) for v in values])
    return scanned.join(carried, [*keys, CHUNK]).withColumns(
        {v + suffix: F.coalesce(v + suffix, "_c_" + v) for v in values}).drop(CHUNK, *["_c_" + v for v in values])

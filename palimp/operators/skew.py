"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
HOT_ROWS = 1_000_000


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side only after counting it; beyond the bound Spark shuffles it as usual."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def join_back(rows: DataFrame, per_key: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner-join rows to one summary row per key, where ``count`` is the key's number of rows.

    Keys with more than ``hot_rows`` rows number at most (rows / hot_rows), so their summary is small:
    it is broadcast after a check of its size, and hot rows are not shuffled by key.
    """
    hot = per_key.where(F.col(count) > hot_rows)
    n_hot = hot.limit(BROADCAST_ROWS + 1).count()
    if n_hot == 0 or n_hot > BROADCAST_ROWS:
        return rows.join(per_key, key)
    hot_keys = F.broadcast(hot.select(key))
    cold = rows.join(hot_keys, key, "left_anti").join(per_key.where(F.col(count) <= hot_rows), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))

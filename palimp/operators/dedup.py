"""De-duplication by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.operators.skew import join_back


def content_groups(docs: DataFrame) -> DataFrame:
    """(hash, keeper, copies): the lowest id of each content. Pre-aggregated, so a hot content is cheap."""
    return docs.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))


def content_hash_dedup(documents: DataFrame, content: Column, **skew) -> DataFrame:
    """Every document with its content hash and the document it points to; only hashes are shuffled."""
    hashed = documents.select("doc_id", F.sha2(content, 256).alias("hash"))
    return join_back(hashed, content_groups(hashed), "hash", "copies", **skew).select(
        "doc_id", "hash", "keeper", (F.col("doc_id") == F.col("keeper")).alias("kept"))


def distinct_objects(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """One row per key, the first in ``order``, with ``payload`` as the last tie-break."""
    first = F.min(F.struct(*order, *[p for p in payload if p not in order]))
    return rows.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*")


def first_occurrence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep-first de-duplication: where each value is first seen."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("occurrences"))

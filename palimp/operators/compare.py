"""Comparison of two documents page by page, and of their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.functions.text import words
from palimp.operators import ordered


def neighbour_pairs(docs: DataFrame, group: str, **chunking) -> DataFrame:
    """(a, b): each document with the next one of its group."""
    paired = ordered.next_value(docs.select(group, "doc_id"), [group], "doc_id", "doc_id", "b", **chunking)
    return paired.where("b is not null").select(F.col("doc_id").alias("a"), "b")


def compare_pages(a_pages: DataFrame, b_pages: DataFrame) -> DataFrame:
    """Both sides (pair, page_no, text) to one status row per page of either."""
    both = a_pages.withColumnRenamed("text", "text_a").join(
        b_pages.withColumnRenamed("text", "text_b"), ["pair", "page_no"], "full")
    a, b = F.col("text_a"), F.col("text_b")
    added = F.size(F.array_except(words(b), words(a))).cast("string")
    removed = F.size(F.array_except(words(a), words(b))).cast("string")
    status = (F.when(a.isNull(), "added_in_b").when(b.isNull(), "removed_in_b")
              .when(a == b, "identical").otherwise("different"))
    details = (F.when(a.isNull(), "Page only in document B").when(b.isNull(), "Page only in document A")
               .when(a == b, "").otherwise(F.concat(F.lit("+"), added, F.lit(" words, -"), removed, F.lit(" words"))))
    return both.select("pair", "page_no", status.alias("status"), details.alias("details"))


def changed_pages(diffs: DataFrame) -> DataFrame:
    """Page totals of each side and the number of pages that differ."""
    s = F.col("status")
    return diffs.groupBy("pair").agg(
        F.count_if(s != "added_in_b").alias("pages_a"),
        F.count_if(s != "removed_in_b").alias("pages_b"),
        F.count_if(s != "identical").alias("changed"))


def word_set_diff(pairs_with_text: DataFrame) -> DataFrame:
    """(pair, text_a, text_b) to the words found on one side only."""
    a, b = words(F.col("text_a")), words(F.col("text_b"))
    return pairs_with_text.select("pair", F.array_except(b, a).alias("added"), F.array_except(a, b).alias("removed"))


def compare_metadata(a_meta: DataFrame, b_meta: DataFrame, fields: list[str]) -> DataFrame:
    """Both sides (pair, one column per field) to rows of differing fields; missing counts as ''."""
    def long(df, out):
        return df.unpivot(["pair"], fields, "field", out)
    both = long(a_meta, "a").join(long(b_meta, "b"), ["pair", "field"], "full")
    return both.select("pair", "field", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")).where("a <> b")

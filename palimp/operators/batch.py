"""Metadata overlays and totals of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.functions.matching import slices
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Characters of a failure's message that are kept.
MESSAGE_CHARS = 100


def batch_totals(rows: DataFrame) -> DataFrame:
    """rows(status, original_size, saved): counts, totals without errors, saved percent."""
    s = F.col("status")
    agg = rows.agg(
        F.count_if(s == "ok").alias("ok"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "error").alias("failed"),
        F.sum(F.when(s != "error", F.col("original_size"))).cast("bigint").alias("total_original"),
        F.sum("saved").cast("bigint").alias("total_saved"))
    return agg.withColumn("saved_pct", F.round(F.lit(100.0) * F.col("total_saved") / F.col("total_original"), 4))


def overlay(old: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """A new value wins only where it is not empty."""
    joined = old.join(updates, "doc_id", "left")
    return joined.select("doc_id", *[
        F.when(F.length("new_" + f) > 0, F.col("new_" + f)).otherwise(F.col(f)).alias(f) for f in fields])


def isolated(rows: DataFrame, key: str, operation: Callable[[dict], int | None], message_chars: int = MESSAGE_CHARS) -> DataFrame:
    """(key, status, message, result): an operation on each row, called with the row as a dictionary and giving an integer.

    An operation that raises costs its own row only: its status is ``error``, with the message. Nothing is shuffled.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: dict) -> tuple:
            try:
                return "ok", "", operation(row)
            except Exception as exc:
                return "error", (str(exc) or type(exc).__name__)[:message_chars], None

        for batch in slices(batches):
            done = [one(row) for row in batch.to_pylist()]
            columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "status", "message", "result"])

    return rows.mapInArrow(work, f"{key} {dict(rows.dtypes)[key]}, status string, message string, result bigint")

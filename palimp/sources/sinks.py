"""Sinks that write one output per group of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(pages: DataFrame, path: str, folder: str) -> None:
    """pages(folder column, out_name, page_no, text) written under one directory per value of ``folder``.

    A range of (folder, out_name) goes to each task: a task touches few folders, and a folder that holds
    most outputs is shared by many tasks.
    """
    ranged = pages.repartitionByRange(folder, "out_name")
    ranged.sortWithinPartitions(folder, "out_name", "page_no").write.partitionBy(folder).parquet(path)


def write_text(extracted: DataFrame, path: str) -> None:
    """Extracted document texts as text files."""
    extracted.select(F.col("text").alias("value")).write.option("lineSep", "\n").text(path)

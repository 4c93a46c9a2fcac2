"""Registration, staging in the shared folder, and text helpers that several operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.session import scratch_path

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Spark's setting to delete the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: White space of every operator here: the ASCII blanks, no others.
BLANKS = r"[\x20\x09-\x0D]+"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write to the shared folder, with Parquet's ``options``, and read back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")  # what was shuffled for this table is of no use once it is written
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the split into learning and held-out rows. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(df: DataFrame) -> int:
    """Shuffle width of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def set_apart(*taken: str):
    """For operators that return their input's columns: columns whose names the operator needs for itself are renamed on the
    way in and get their names back on the way out. Without a clash nothing changes."""

    def around(operator):
        @functools.wraps(operator)
        def wrapped(docs: DataFrame, *args, **options) -> DataFrame:
            aside = {c: f"{c}__aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken}
            out = operator(docs.withColumnsRenamed(aside) if aside else docs, *args, **options)
            return out.withColumnsRenamed({new: old for old, new in aside.items()}) if aside else out

        return wrapped

    return around

"""Small-table lookups: code descriptions and routes through a hub."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp import model


def describe_codes(rows: DataFrame, trigger: Column, action: Column) -> DataFrame:
    """Add ``fires`` and ``does``; unknown codes get a default wording. The tables are fixed and small."""
    spark = rows.sparkSession
    triggers = F.broadcast(spark.createDataFrame(list(model.TRIGGERS.items()), "trigger string, fires string"))
    verbs = F.broadcast(spark.createDataFrame(list(model.ACTION_VERBS.items()), "action string, does string"))
    coded = rows.withColumn("trigger", trigger).withColumn("action", action)
    joined = coded.join(triggers, "trigger", "left").join(verbs, "action", "left")
    fallback = F.when(F.col("trigger") == "", "fires automatically").otherwise(F.concat(F.lit("fires on the "), "trigger", F.lit(" event")))
    return joined.withColumn("fires", F.coalesce("fires", fallback)).withColumn("does", F.coalesce("does", F.lit("runs an action")))


def describe_autorun(rows: DataFrame, where: Column, action: Column) -> DataFrame:
    """Add ``description``: where an action hangs, when it fires and what it does.

    ``where`` is a path of names; the trigger is its last name behind an additional-actions entry. An open action fires as soon as
    the document is opened, whatever else the path says; a path without a trigger fires automatically.
    """
    names = F.filter(F.split(F.replace(where, F.lit("/Next"), F.lit("")), "[ \t\r\n]+", -1), lambda t: t.startswith("/") & (t != "/AA"))
    trigger = F.when(F.contains(where, F.lit("/AA")), F.substring(F.coalesce(F.get(names, F.size(names) - 1), F.lit("/")), 2, 1 << 30)).otherwise("")
    coded = describe_codes(rows, trigger, action)
    when = F.when(F.contains(where, F.lit("/OpenAction")), "fires as soon as the document is opened").otherwise(F.col("fires"))
    return coded.withColumn("description", F.concat(where, F.lit(" \u2014 "), when, F.lit("; "), F.col("does"))).drop("trigger", "action", "fires", "does")


def hub_reach(codes: DataFrame, edges: DataFrame, hub: int | str) -> DataFrame:
    """codes(code) with flags: reachable from the hub, and able to reach it. Linear in the edges."""
    flags = edges.where((F.col("src") == hub) | (F.col("dst") == hub)).select(
        F.when(F.col("src") == hub, F.col("dst")).otherwise(F.col("src")).alias("code"), (F.col("src") == hub).alias("into"))
    per_code = flags.groupBy("code").agg(F.bool_or("into").alias("to_ok"), F.bool_or(~F.col("into")).alias("from_ok"))
    is_hub = F.col("code") == hub
    return codes.join(per_code, "code", "left").select(
        "code", (is_hub | F.coalesce("to_ok", F.lit(False))).alias("to_ok"), (is_hub | F.coalesce("from_ok", F.lit(False))).alias("from_ok"))


def hub_routes(edges: DataFrame, hub: int | str) -> DataFrame:
    """Reachable (src, dst): direct, else through the hub. Codes form a small registry, so pairs do too."""
    direct = edges.select("src", "dst").distinct().withColumn("via", F.lit("direct"))
    into = edges.where(F.col("dst") == hub).select("src").distinct()
    out = edges.where(F.col("src") == hub).select("src", "dst").distinct().select(F.col("src").alias("hub"), "dst")
    through = into.withColumn("hub", F.lit(hub).cast("bigint")).join(out, "hub").where("src <> dst").select("src", "dst")
    return direct.unionByName(through.join(direct, ["src", "dst"], "left_anti").withColumn("via", F.lit("hub")))

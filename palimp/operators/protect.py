"""Authenticated encryption of columns by envelopes.

Every value has a data key of its own. The data key is wrapped by a master key that a table of keys holds under an id, so that
no key is in a query's text or plan, and a new master key needs only the wrapped keys to be written anew. A header, which
names the master key, is bound to the value and to the wrapped key.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.operators.skew import checked_broadcast
from palimp.session import scratch_path

CIPHER, VERSION = "aes-256-gcm", 3
KEYS = "key_id string, key binary"
#: The session's setting that names the table of keys.
SETTING = "palimp.protect.keys"
_EPHEMERAL: dict[str, str] = {}


def key_table(spark: SparkSession, *key_ids: str) -> DataFrame:
    """keys(key_id, key): the table that the session names. Where it names none, random keys of the given ids are written to
    the shared folder once for the session, so that what they seal can only be opened in it."""
    path = spark.conf.get(SETTING, None)
    if path is None:
        at = f"{spark.sparkContext.applicationId}/{'/'.join(key_ids)}"
        if at not in _EPHEMERAL:
            _EPHEMERAL[at] = scratch_path(spark, "keys")
            spark.createDataFrame([(k, bytearray(secrets.token_bytes(32))) for k in key_ids], KEYS).write.parquet(_EPHEMERAL[at])
        path = _EPHEMERAL[at]
    return spark.read.schema(KEYS).parquet(path)


def header(name: Column, key_id: Column) -> Column:
    """The clear header that is authenticated with the value."""
    return F.to_json(F.struct(F.lit(CIPHER).alias("cipher"), F.lit(VERSION).alias("version"), key_id.alias("key"), name.alias("name")))


def _seal(value: Column, key: Column, aad: Column) -> Column:
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.encode(aad, "utf-8"))


def _open(value: Column, key: Column, aad: Column) -> Column:
    return F.try_aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(aad, "utf-8"))


def _with_key(df: DataFrame, key_id: Column, keys: DataFrame, out: str) -> DataFrame:
    """Each row's master key, null where the table has none; the few keys go to the many rows after a count."""
    held = checked_broadcast(keys.select(F.col("key_id").alias("_key_id"), F.col("key").alias(out)))
    return df.join(held, key_id == F.col("_key_id"), "left").drop("_key_id")


def protect_columns(df: DataFrame, value: str, name: Column, keys: DataFrame, key_id: str) -> DataFrame:
    """Replace ``value`` by (header, wrapped, payload) under the master key ``key_id`` of keys(key_id, key)."""
    drawn = df.withColumn("header", header(name, F.lit(key_id))).withColumn("_data", F.unhex(F.sha2(F.concat(F.uuid(), F.uuid()), 256)))
    sealed = _with_key(drawn, F.lit(key_id), keys, "_master")
    sealed = sealed.withColumn("wrapped", _seal(F.col("_data"), F.col("_master"), F.col("header")))
    return sealed.withColumn("payload", _seal(F.encode(F.col(value), "utf-8"), F.col("_data"), F.col("header"))).drop(value, "_data", "_master")


def unprotect_columns(df: DataFrame, value: str, keys: DataFrame) -> DataFrame:
    """Decrypt; a missing or wrong key, or an altered header, wrapped key or payload gives an error row, never garbage."""
    opened = _with_key(df, F.get_json_object("header", "$.key"), keys, "_master")
    opened = opened.withColumn("_data", _open(F.col("wrapped"), F.col("_master"), F.col("header")))
    opened = opened.withColumn("_plain", _open(F.col("payload"), F.col("_data"), F.col("header")))
    failed = F.col("_plain").isNull() & F.col("payload").isNotNull()
    return opened.withColumn(value, F.decode("_plain", "utf-8")).withColumn(
        "status", F.when(failed, "wrong key or altered").otherwise("ok")).drop("_plain", "_data", "_master", "payload", "wrapped")


def rotate_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Wrap every data key anew under the master key that ``rotated`` (a column of ``df``) names; payloads stay as they are.

    The header that is bound to a payload names the first master key, so the new one is kept beside it: rows gain
    ``rewrapped``, which ``unprotect_rotated`` opens. A data key that cannot be opened stays null.
    """
    old = _with_key(df, F.get_json_object("header", "$.key"), keys, "_old")
    both = _with_key(old, F.col("rotated"), keys, "_new")
    data = _open(F.col("wrapped"), F.col("_old"), F.col("header"))
    return both.withColumn("rewrapped", _seal(data, F.col("_new"), F.concat("header", "rotated"))).drop("_old", "_new", "wrapped")


def unprotect_rotated(df: DataFrame, value: str, keys: DataFrame) -> DataFrame:
    """:func:`unprotect_columns` for rows whose data key was wrapped anew."""
    held = _with_key(df, F.col("rotated"), keys, "_master")
    held = held.withColumn("_data", _open(F.col("rewrapped"), F.col("_master"), F.concat("header", "rotated")))
    plain = held.withColumn("_plain", _open(F.col("payload"), F.col("_data"), F.col("header")))
    failed = F.col("_plain").isNull() & F.col("payload").isNotNull()
    return plain.withColumn(value, F.decode("_plain", "utf-8")).withColumn(
        "status", F.when(failed, "wrong key or altered").otherwise("ok")).drop("_plain", "_data", "_master", "payload", "rewrapped", "rotated")

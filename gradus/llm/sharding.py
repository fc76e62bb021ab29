"""Sharding with jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide the shard; there is no ring table. One more
shard takes about 1/(n+1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import hex_digits, keep

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, for all keys at once; about ln(shards) rounds."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), dtype=np.int64)
    jumped = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = jumped[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * _STEP + np.uint64(1)
        high = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jumped[live] = ((at[live] + 1) * (float(1 << 31) / high)).astype(np.int64)
        live = live[jumped[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard column for a long key column; a null key counts as 0."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64), shards))

    return run(F.coalesce(key, F.lit(0)).cast("long"))


def stable_key(df: DataFrame, column: str) -> Column:
    """Integers are their own key, anything else is hashed (xxHash64)."""
    kind = dict(df.dtypes)[column]
    col = F.col(column)
    return col.cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.when(col.isNotNull(), F.xxhash64(col))


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard") -> DataFrame:
    """df with its shard number; no shuffle. To keep equal texts together, give a text column as key."""
    return df.withColumn(shard, shard_of(stable_key(df, key), shards))


def place(docs: DataFrame, shards: int = 16, rows_per_bucket: int = 100_000) -> DataFrame:
    """Shard, gapless slot within the shard, and the shard with one shard more, of every document.

    Law ``key``: doc_id and the number of shards alone decide. Slots follow the md5 of
    (doc_id, checksum, size), so they don't depend on files or partitions. A shard isn't
    numbered by one task: it is cut into buckets by the leading digits of that md5, counts of
    buckets are summed up, and only then rows are numbered, within a bucket.

    Null doc_id: the key is 0. Null text: size 1, text_crc32 null. Repeated rows each get a
    slot of their own. An empty table gives an empty result. Extra columns are not read.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.md5(F.concat_ws(":", "doc_id", "text_crc32", "size").cast("binary")).alias("place"),
    )
    rows = keep(rows, "shards")
    digits = hex_digits(rows.count() // max(1, shards), rows_per_bucket)
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "text_crc32")
    return rows.join(first, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        "grown_shard",
    )

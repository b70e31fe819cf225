"""Sharding: jump consistent hashing of a stable key.

The hash is Lamping and Veach's jump consistent hash: the shard of a key depends on the key and the number of
shards only, and one more shard takes rows into itself alone. No ring table is kept or broadcast.

Defined cases: a null key hashes as null does in xxhash64 (its seed), a null text has size 1 and the checksum of
no bytes, very long texts count whole, an empty table gives an empty result, repeated rows and rows that tie in their
slot's order each get a slot of their own (any order among them), and other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARDS = 16


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all at once."""
    state = np.array(keys, dtype=np.uint64)
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        leap = (shard[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))
        ahead[live] = np.minimum(leap, float(1 << 40)).astype(np.int64)
        live = live[ahead[live] < n_shards]
    return shard


def shard_columns(key, n_shards: int):
    """Struct of shard (0 to n_shards - 1) and grown (with one shard more) for a column of keys of any type."""

    @F.pandas_udf("shard int, grown int")
    def of(hashes: pd.Series) -> pd.DataFrame:
        keys = hashes.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump(keys, n_shards).astype(np.int32), "grown": jump(keys, n_shards + 1).astype(np.int32)})

    return of(F.xxhash64(key))


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Texts are read once; what follows works on the narrow rows, which are written to the shared folder. Slots are
    numbered without putting a shard in one task: rows of a shard are cut into buckets by the hash of their place among
    the written rows (so that repeated rows spread), the bucket sizes (n_shards x buckets rows, whatever the input) are
    summed up to offsets, and rows are numbered inside their bucket.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_bytes"))
        .select("doc_id", (F.octet_length("_bytes") + F.lit(1)).cast("long").alias("size"), F.crc32("_bytes").alias("text_crc32"))
        .withColumn("_both", shard_columns(F.col("doc_id"), n_shards))
        .select("doc_id", "size", "text_crc32", F.col("_both.shard").alias("shard"), F.col("_both.grown").alias("grown_shard"))
    )
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("_n", F.row_number().over(inside) - 1)
    ahead = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select("shard", "_bucket", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    )  # at most n_shards x buckets rows
    slot = (F.col("_before") + F.col("_n")).cast("long").alias("slot")
    numbered = numbered.join(F.broadcast(offsets), ["shard", "_bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))

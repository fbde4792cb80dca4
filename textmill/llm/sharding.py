"""Shards by jump consistent hashing.

The shard of a row is a function of its key and the number of shards alone: a few rounds of a linear
congruential generator, seeded with the key, give the shard counts at which the key would move, and the
last of them below the count in force is the shard. No ring table is kept or sent. When a shard is
appended, a key either stays or goes to the new shard, and one in n + 1 goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import fresh, stage

#: The generator of the published algorithm. Fixed value.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key; a key in shard s goes through s + 1 rounds at most."""
    out, going = np.zeros(len(keys), np.int32), np.arange(len(keys))
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    while len(going):
        out[going] = at
        state = state * STEP + np.uint64(1)
        at = ((at + 1) * (float(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        more = at < shards
        going, state, at = going[more], state[more], at[more]
    return out


def _key(df: DataFrame, key: str) -> Column:
    """The key as a 64-bit integer: itself if it is one, else its hash. A null key is the key 0."""
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(F.col(key).cast("long") if whole else F.xxhash64(key), F.lit(0).cast("long"))


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key."""

    @F.arrow_udf("int")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), shards), pa.int32())

    return run(key)


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with slot: the place from 0 within the shard, in the order given.

    Rows are dealt in ranges of shard and order, so a shard of any size is numbered by many tasks. A row's
    place in its task is kept with it; what comes before in its shard is a prefix sum over one row for each
    shard in each range. That table has fewer rows than ranges and shards together, and is broadcast.
    Rows equal in the order take their slots in any order.
    """
    keys = [F.col("shard"), *(F.col(c).asc_nulls_first() for c in order), F.col("__place")]
    rows = rows.withColumn("__place", F.monotonically_increasing_id())  # many equal rows needn't be in one range
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__place")
    placed = stage(placed.withColumn("__id", F.monotonically_increasing_id()), "slots")
    part = F.shiftright("__id", 33).alias("__part")
    runs = placed.groupBy(part, "shard").agg(F.min("__id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__shift"))
    out = placed.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(runs), ["__part", "shard"])
    return out.withColumn("slot", F.col("__id") + F.col("__shift")).drop("__id", "__part", "__shift")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text).

    size is the text's bytes in UTF-8 and one more, text_crc32 their unsigned CRC-32; a null text has no
    bytes. The law is `key`: shard depends on the key column and the number of shards, grown_shard on one
    shard more. Rows of equal key are in one shard, those without a key in the shard of key 0; rows of equal
    texts are in one shard if the key is a function of the text. slot numbers a shard's rows from 0 by
    doc_id, then checksum and size. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        _key(docs, key).alias("__key"),
    )
    rows = rows.withColumn("shard", shard_of(F.col("__key"), shards)).withColumn("grown_shard", shard_of(F.col("__key"), shards + 1))
    return slots(rows.drop("__key"), ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, shards: int = 8, key: str = "doc_id") -> None:
    """Write whole documents below folder/shard=0, folder/shard=1, ...; a shard's rows come from many tasks.

    Every column of docs is kept under its name."""
    name = fresh(docs, "shard")
    for_name = docs.withColumn(name, shard_of(_key(docs, key), shards))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    for_name.select(whole, F.col(name).alias("shard")).write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, shards: int, key: str = "doc_id") -> DataFrame:
    """(shard, row) of the documents in a folder that holds `shards` shards. Rows that an appended shard took over
    still lie in their old files; they are passed over, as their key says another shard."""
    found = spark.read.parquet(folder).where(F.col("shard") < shards)
    rows = found.select("row.*")
    keyed = found.withColumn("__key", F.coalesce(F.col(f"row.{key}").cast("long") if rows.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(f"row.{key}"), F.lit(0).cast("long")))
    return keyed.where(shard_of(F.col("__key"), shards) == F.col("shard")).select(F.col("shard").cast("int").alias("shard"), "row")


def append_shard(spark: SparkSession, folder: str, shards: int, key: str = "doc_id") -> None:
    """Make shards + 1 of a folder's shards: writes the new shard's rows, 1 in shards + 1, and no others.

    May run again after a failure: it only ever replaces the new shard."""
    rows = read_shards(spark, folder, shards, key).select("row.*")
    to = fresh(rows, "to")
    moving = rows.withColumn(to, shard_of(_key(rows, key), shards + 1)).where(F.col(to) == shards).drop(to)
    moving.select(F.struct(*(F.col(f"`{c}`") for c in moving.columns)).alias("row")).write.mode("overwrite").parquet(f"{folder}/shard={shards}")

"""Tables that grow by deltas: each batch adds files below the hash buckets of its keys and rewrites nothing.

A delta lies in d_level=0/d_bucket=B/d_batch=N, so a batch that runs again replaces its own files, and a reader that
knows its keys reads their buckets only. Compaction merges a bucket's deltas into d_level=1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_PLACE = ("d_level", "d_bucket", "d_batch")
#: Bits for each key of a Bloom filter, at least, and probes of a key: one absent key in a hundred passes at most.
BITS, PROBES = 10, 7


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """The buckets of the rows' keys: at most `buckets` numbers come to the driver."""
    return [r["b"] for r in rows.select(bucket_of(keys, buckets).alias("b")).distinct().collect()]


def write_delta(rows: DataFrame, folder: str, keys: list[str], batch: int, level: int = 0, buckets: int = BUCKETS) -> None:
    """Add rows as a batch; the same batch again replaces itself. A bucket's rows are split where they are many."""
    placed = rows.withColumns({"d_level": F.lit(level), "d_bucket": bucket_of(keys, buckets), "d_batch": F.lit(batch).cast("long")})
    placed.hint("rebalance", "d_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACE).parquet(folder)


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_deltas(spark: SparkSession, folder: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """All rows of the given buckets (of all without a list) with d_level, d_bucket and d_batch; none without the folder."""
    path, fs = _path(spark, folder)
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    whole = T.StructType([*schema.fields, *(T.StructField(c, T.LongType() if c == "d_batch" else T.IntegerType()) for c in _PLACE)])
    if not fs.exists(path):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(folder)
    return rows if buckets is None else rows.where(F.col("d_bucket").isin(buckets))


def latest(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key's newest batch, without the place."""
    values = [c for c in deltas.columns if c not in (*keys, *_PLACE)]
    newest = deltas.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("d_batch", "d_level")).alias("row"))
    return newest.select(*keys, *(F.col(f"row.{v}").alias(v) for v in values))


def compact(spark: SparkSession, folder: str, schema, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """Merge the deltas of every bucket that has new ones; the buckets. Others aren't read.

    The merged rows are written before the deltas go, and both say the same, so a run that breaks off between leaves
    the table right. Not for use while a batch is being written."""
    news = read_deltas(spark, folder, schema).where("d_level = 0")
    found = [r["d_bucket"] for r in news.select("d_bucket").distinct().collect()]
    if not found:
        return []
    old = read_deltas(spark, folder, schema, found)
    last = old.agg(F.max("d_batch")).first()[0]
    folders = {f.rsplit("/", 1)[0] for f in old.inputFiles()}
    folders = {f for f in folders if int(f.split("d_bucket=")[1].split("/")[0]) in found}
    write_delta(latest(old, keys), folder, keys, last, level=1, buckets=buckets)
    for f in folders:
        if "d_level=0/" in f or not f.endswith(f"d_batch={last}"):
            path, fs = _path(spark, f)
            fs.delete(path, True)
    return sorted(found)


def _hashes(key: str) -> list[Column]:
    """Two hashes of a key, neither of them its bucket's: keys of a bucket share bits of that one."""
    return [F.xxhash64(F.lit(2), key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")]


def _bits(h: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """The places of a key's probes in a filter of `size` bits, a row for each key."""
    return ((h.view(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * (g.view(np.uint64) | np.uint64(1))[:, None]) % np.uint64(size)).astype(np.int64)


def write_filters(rows: DataFrame, folder: str, key: str, batch: int, buckets: int = BUCKETS) -> None:
    """Add a Bloom filter of the keys of each bucket of a batch; what it holds of a key is 16 bytes while it is made."""

    def make(pdf):
        import pandas as pd

        size = 1 << max(6, (BITS * len(pdf) - 1).bit_length())  # odd steps reach every place of a power of two
        bits = np.zeros(size, bool)
        bits[_bits(pdf["h"].to_numpy(), pdf["g"].to_numpy(), size)] = True
        return pd.DataFrame({"size": [size], "bits": [np.packbits(bits).tobytes()], "b": pdf["b"].iloc[:1]})

    keyed = rows.where(F.col(key).isNotNull()).select(bucket_of([key], buckets).alias("b"), *_hashes(key))
    made = keyed.groupBy("b").applyInPandas(make, "size long, bits binary, b int")
    placed = made.withColumns({"d_level": F.lit(0), "d_bucket": F.col("b"), "d_batch": F.lit(batch).cast("long")}).drop("b")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACE).parquet(folder)


def maybe_in(keys: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The keys that a filter below folder doesn't rule out, each once. Filters and keys meet by bucket, filters first."""
    spark = keys.sparkSession
    kind = keys.schema[key].dataType.simpleString()
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    filters = read_deltas(spark, folder, "size long, bits binary")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("k", kind), ("h", "long"), ("g", "long"))]
    left = filters.select(F.col("d_bucket").alias("b"), F.lit(0).alias("side"), *none, "size", "bits")
    right = asked.select(bucket_of(["k"], buckets).alias("b"), F.lit(1).alias("side"), "k", *_hashes("k"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("bits"))

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            b, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            passed = np.zeros(len(b), bool)
            cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else []
            for start, stop in zip(cuts, cuts[1:]):
                if b[start] != bucket:
                    bucket, held = b[start], []
                first = start + int((side[start:stop] == 0).sum())
                for i in range(start, first):
                    held.append((batch.column(5)[i].as_py(), np.unpackbits(np.frombuffer(batch.column(6)[i].as_py(), np.uint8)).astype(bool)))
                h, g = (batch.column(c).slice(first, stop - first).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4))
                for size, bits in held:
                    passed[first:stop] |= bits[_bits(h, g, size)].all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(passed))], names=["k"])

    met = left.union(right).repartition("b").sortWithinPartitions("b", "side").mapInArrow(run, f"k {kind}")
    return met.withColumnRenamed("k", key)


def missing_keys(rows: DataFrame, folder: str, schema, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows whose key a bucketed index (folder/rows, with filters in folder/filters) lacks, null keys included.

    The filters rule out nearly all new keys, so the index is read only in the buckets of the rest, its keys only."""
    maybe = maybe_in(rows, f"{folder}/filters", key, buckets)
    spark, found = rows.sparkSession, touched(maybe, [key], buckets)
    if not found:
        return rows
    held = read_deltas(spark, f"{folder}/rows", schema, found).select(key)
    return rows.join(held.join(maybe, key, "left_semi").distinct(), key, "left_anti").select(*rows.columns)


def add_rows(rows: DataFrame, folder: str, key: str, batch: int, buckets: int = BUCKETS) -> None:
    """Add a batch of rows and its filters to a bucketed index; the filters come first, so a row is never unknown to them."""
    write_filters(rows, f"{folder}/filters", key, batch, buckets)
    write_delta(rows, f"{folder}/rows", [key], batch, buckets=buckets)

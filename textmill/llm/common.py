"""Helpers shared by the corpus operators: shared folder, staged tables, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is
    unset, a temp folder of the application's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[app]


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, which wait for a driver's GC."""
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a work_dir that nothing reads any more."""
    if "/textmill/" in folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **conf):
    """Session settings for the time of an action; keys with __ for dots."""
    keys = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_model: dict = {}


def worker_model(key, make):
    """make(), kept in this Python worker until another key is asked for: workers live on for the tasks of other
    operators, whose models shouldn't add up."""
    if key not in _model:
        _model.clear()
        give_back()
        _model[key] = make()
    return _model[key]


def give_back() -> None:
    """Give the system the memory that this Python worker holds but doesn't use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Remembered(dict):
    """A bounded memory of make(key). A key enters it when it comes again soon after its first time."""

    def __init__(self, make, most: int = 500_000, recent: int = 500_000):
        self.make, self.most, self.recent, self.young = make, most, recent, {}

    def __missing__(self, key):
        value = self.young.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(self.young) >= self.recent:
                self.young.clear()
            self.young[key] = value
        else:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of edges(a, b): comp is the smallest node that links reach.

    Each round takes the smallest label among the neighbours, then follows the label's own label
    twice, so chains shrink by a power of two. Labels live in staged tables; only a count of
    changed labels comes to the driver.
    """
    pairs = edges.select("a", "b").where("a <> b")
    pairs = stage(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = stage(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    for _ in range(rounds):
        near = (
            pairs.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        moved = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        first = stage(moved, "moved")
        up = first.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = stage(
            first.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"),
            "labels",
        )
        changed = new.where("comp <> old").limit(1).count()
        release(first, labels)
        labels = new.select("node", "comp")
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    release(pairs)
    return labels

"""Exact deduplication as a stateful stream: keyed state on disk, without expiry.

The stream's state holds, for each digest, the stable identifier and content locator (file and row)
of the document to keep and the number of rows seen. It lives in RocksDB on the executors' disks
with its changes in the checkpoint folder, and grows only with the number of different texts. Rows are
combined before the shuffle, so a group of copies costs each task one row. Where a digest was hit more
than once, the members' full bytes are compared with those at the kept locator.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import fresh, release, remove, settings, stage, sweep, work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPDATE = "digest string, keep struct<doc_id: bigint, file: string, row: bigint>, n bigint"
KEPT = "file = keep.file AND row = keep.row"
#: A kept text meets so many of its copies at a time while bytes are compared.
PIECE = 4_096
ROW = "doc_id bigint, file string, row bigint, digest string"


def placed(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with the columns file and row: where a reader finds each row again. Frames that are no plain
    file scan are written to the shared folder first."""
    def place(df):
        at = df.metadataColumn("_metadata")
        return df.withColumns({file: at["file_path"], row: at["row_index"]})

    try:
        return place(docs)
    except AnalysisException:  # no such metadata: not a scan
        return place(stage(docs, "content"))


def located(rows: DataFrame, id_col: str, text_col: str, file: str, row: str) -> DataFrame:
    """(doc_id, text, file, row) of placed rows; a null text is empty."""
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    return rows.select(*cols, F.col(file).alias("file"), F.col(row).alias("row"))


def advance(spark: SparkSession, rows: str, schema, files: int, out: str, checkpoint: str) -> None:
    """Runs the stream over the digest rows below rows that checkpoint hasn't seen, files at a time. Every
    (digest, keep, n) that changes is written to out/batch=<number>."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(rows)
    keep = F.max(F.struct("doc_id", "file", "row")).alias("keep")
    state = stream.groupBy("digest").agg(keep, F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a replayed batch replaces itself

    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="128",
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",  # many small stores
        spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="8",
    ):
        writer = (
            state.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
        )
        writer.start().awaitTermination()


def _folder(spark: SparkSession, path: str, make: bool = False):
    """(file system, Hadoop path) of a folder, made if asked for."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if make:
        fs.mkdirs(folder)
    return fs, folder


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, folder = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def latest(spark: SparkSession, out: str, first: int = 0) -> DataFrame:
    """(digest, keep, n) as of the last update of every digest that changed in batch first or later."""
    _folder(spark, out, make=True)  # without rows there was no batch
    updates = spark.read.schema(f"{UPDATE}, batch int").parquet(out).where(F.col("batch") >= first)
    # counts only grow, so a digest's largest count is its last update
    last = updates.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last"))
    return last.select("digest", F.col("last.keep").alias("keep"), F.col("last.n").alias("n"))


def keyed_state(spark: SparkSession, path: str, schema, batches: int) -> DataFrame:
    """Runs the stream over the digest rows at path; (digest, keep, n) for every digest, as a table. The
    stream ends here, so its updates and its checkpoint are given back."""
    files = max(1, -(-len(spark.read.schema(schema).parquet(path).inputFiles()) // batches))
    out, checkpoint = work_dir(spark, "updates"), work_dir(spark, "state")
    advance(spark, path, schema, files, out, checkpoint)
    state = stage(latest(spark, out), "latest")
    remove(spark, out)
    remove(spark, checkpoint)
    return state


def stream_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, digest=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, file, row) for every row of docs.

    Of equal texts the row with the largest doc_id stays; among rows with that same doc_id, the one
    that comes last by file and row. A null text counts as empty; a null doc_id is smaller than any
    other. digest maps the text column to the state's key (default: SHA-256); texts that share a
    key but not all bytes are grouped by the full text instead, so a weak key is right too.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _dedup(located(placed(own, "file", "row"), "doc_id", "text", "file", "row"), batches, digest)


def _dedup(base: DataFrame, batches: int = 3, digest=None) -> DataFrame:
    """stream_dedup of located rows."""
    spark = base.sparkSession
    make = digest or (lambda text: F.sha2(text, 256))
    light = stage(base.select("doc_id", "file", "row", make(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256")), "digests")
    folder = light.inputFiles()[0].rsplit("/", 1)[0] if light.inputFiles() else None
    if folder is None or not light.limit(1).count():
        return light.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "file", "row")
    state = keyed_state(spark, folder, light.schema, batches)

    # full bytes on hits
    hits = state.where("n > 1").select("digest", "keep")
    members = base.withColumn("digest", make(F.col("text"))).join(hits, "digest")
    members = stage(members.select("digest", "doc_id", "file", "row", "text", F.expr("file = keep.file AND row = keep.row").alias("is_keep")), "hits")
    keepers = members.where("is_keep").select("digest", F.col("text").alias("kept_text"))
    differ = members.where("NOT is_keep").join(keepers, "digest").where("text <> kept_text").select("digest")
    differ = stage(differ, "differ")
    sweep(spark)

    result = light.join(state, "digest")
    if differ.limit(1).count():
        apart = members.join(differ, "digest", "left_semi")
        exact = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep2"), F.count("*").alias("n2"))
        exact = apart.join(exact, ["digest", "text"]).select("file", "row", "keep2", "n2")
        result = result.join(exact, ["file", "row"], "left")
        result = result.withColumn("keep", F.coalesce("keep2", "keep")).withColumn("n", F.coalesce("n2", "n"))
    else:
        release(members, differ)
    return result.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.expr("file = keep.file AND row = keep.row").alias("kept"),
        "text_sha256",
        "file",
        "row",
    )


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) without the rows that stream_dedup drops; all columns stay."""
    file, row, lost_file, lost_row = (fresh(docs, c) for c in ("file", "row", "lost_file", "lost_row"))
    rows = placed(docs, file, row)
    lost = _dedup(located(rows, "doc_id", "text", file, row)).where("NOT kept").select(F.col("file").alias(lost_file), F.col("row").alias(lost_row))
    left = rows.join(lost, (F.col(file) == F.col(lost_file)) & (F.col(row) == F.col(lost_row)), "left_anti")
    return left.drop(file, row)


def dedup_arrivals(docs: DataFrame, memory: str, name: str, id_col: str = "doc_id", text_col: str = "text", files: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, file, row) for every row of docs, an arrival in a
    corpus that grows: equal texts of all arrivals with the same memory count.

    memory is a shared folder with the stream's checkpoint, so the keyed state outlives the call and the
    application; it never expires. An arrival reads its own rows and the kept texts that they hit, not
    the others of earlier arrivals. docs must be a scan of Parquet files that stay where they are: their
    rows are the content locators. name names the arrival; the same name again changes nothing and gives
    the arrival's rows as of now, so a call that was cut short is simply made again.

    As in stream_dedup the largest doc_id stays, then the last by file and row; a null text is empty, a
    null doc_id is smaller than any other. A later arrival can take the place of a row kept before:
    kept_rows has the rows that stay as of now. Texts that share a SHA-256 but not all bytes raise an error.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError("an arrival's name is letters, digits and underscores")
    spark, at = docs.sparkSession, docs.metadataColumn("_metadata")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), at["file_path"].alias("file"), at["row_index"].alias("row"))
    base = located(base, "doc_id", "text", "file", "row")
    rows, updates = f"{memory}/rows/arrival={name}", f"{memory}/updates"
    if "_SUCCESS" not in _listed(spark, rows):  # the stream starts after a whole write only
        base.select("doc_id", "file", "row", F.sha2("text", 256).alias("digest")).write.mode("overwrite").parquet(rows)
    begun = [int(n.split("-")[1]) for n in _listed(spark, f"{memory}/arrivals") if n.split("-")[0] == name]
    first = begun[0] if begun else 1 + max((int(n[6:]) for n in _listed(spark, updates) if n.startswith("batch=")), default=-1)
    _folder(spark, f"{memory}/arrivals/{name}-{first}", make=True)
    advance(spark, f"{memory}/rows", T.StructType.fromDDL(f"{ROW}, arrival string"), files, updates, f"{memory}/state")

    mine = spark.read.schema(ROW).parquet(rows)
    result = mine.join(latest(spark, updates, first), "digest")
    hits = result.where(f"n > 1 AND NOT ({KEPT})").withColumn("pieces", F.ceil(F.col("n") / PIECE))
    hits = stage(hits.select("digest", "file", "row", "keep", "pieces"), "hits")
    folders = [r[0] for r in hits.select(F.regexp_extract("keep.file", "^(.*)/[^/]*$", 1)).distinct().collect()]  # of tables, not files
    kept = hits.select("digest", F.col("keep.file").alias("file"), F.col("keep.row").alias("row"), "pieces").distinct()
    members = base.join(hits.select("file", "row", "digest", F.pmod("row", "pieces").alias("piece")), ["file", "row"])
    for folder in folders:
        earlier = placed(spark.read.schema(docs.select(id_col, text_col).schema).parquet(unquote(folder)), "__file", "__row")
        texts = located(earlier, id_col, text_col, "__file", "__row").join(kept, ["file", "row"])
        texts = texts.select("digest", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("text").alias("kept_text"))
        if members.join(texts, ["digest", "piece"]).where("text <> kept_text").limit(1).count():
            raise ValueError("different texts share a SHA-256")
    release(hits)
    columns = ["doc_id", "keep.doc_id AS keep_id", "n AS group_size", f"{KEPT} AS kept", "digest AS text_sha256", "file", "row"]
    return result.selectExpr(*columns)


def kept_rows(spark: SparkSession, memory: str) -> DataFrame:
    """(text_sha256, doc_id, file, row, group_size) of the rows that stay, of all arrivals in memory; none
    if nothing has arrived."""
    state = latest(spark, f"{memory}/updates")
    return state.select(F.col("digest").alias("text_sha256"), "keep.*", F.col("n").alias("group_size"))

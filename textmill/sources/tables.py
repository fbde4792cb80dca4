"""Session settings and the sources and sinks of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.sources.deltas import add_rows, missing_keys, read_deltas

STUDENT = "id_alumno string, nombre string, apellido string, email string"
COURSE = "id_curso string, nombre_curso string, creditos int"
ENROLMENT = "id_inscripcion int, id_alumno string, id_curso string, fecha_inscripcion date"
LOG = "Timestamp timestamp, Message string"
CHUNK = "id string, text string, metadata struct<source_file:string,category:string,chunk_index:int,total_chunks_in_doc:int,title:string,original_url:string,type:string>"
SCORES = "map<string,map<string,map<string,struct<player_wins:bigint,ai_wins:bigint,player_score:bigint,ai_score:bigint,long:struct<mode:string,rivals:string,difficulty:string>>>>>"
SCORE_KEYS = ("mode", "rivals", "difficulty")
#: Combinations in one JSON document of a scoreboard, about; characters of a key that stands as a name; the mark before
#: each text of a JSON text sequence.
DOCUMENT, NAME, JSON_APART = 1_000, 10_000, "\x1e"
INDEX = "chunk_id string, text string, embedding array<float>"


def session(app: str = "textmill", **conf) -> SparkSession:
    """A session with the engine's settings: UTC, ANSI, AQE, last key wins in maps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed table; broken rows give nulls instead of stopping the read."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def decode_fallback(content: str | Column, second: str = "ISO-8859-1") -> Column:
    """Bytes as UTF-8 text where they are valid, else by the second codec, which never fails."""
    content = F.col(content) if isinstance(content, str) else content
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, second))


def read_corpus(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(source_file, category, text) of all *.txt below path but 00_*; the category is the parent folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    parts = F.split("path", "/")
    name, parent = F.element_at(parts, -1), F.element_at(parts, -2)
    top = (root or path).rstrip("/").rsplit("/", 1)[-1]
    return files.where(~name.startswith("00_")).select(
        F.url_decode(name).alias("source_file"),
        F.when(F.url_decode(parent) == top, "general").otherwise(F.url_decode(parent)).alias("category"),
        decode_fallback("content").alias("text"),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; the id goes into the metadata as chunk_id. A missing path is an empty table."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        chunks = spark.createDataFrame([], T._parse_datatype_string(CHUNK))
    else:
        chunks = spark.read.schema(CHUNK).json(path)
    return chunks.withColumn("metadata", F.col("metadata").withField("chunk_id", F.col("id")))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_scoreboard(spark: SparkSession, path: str) -> DataFrame:
    """(mode, rivals, difficulty, 4 counts) from the nested scoreboard; corrupt text gives no rows."""
    raw = spark.read.text(path, lineSep=JSON_APART).select(F.from_json("value", SCORES, {"maxStringLen": str(2**31 - 1)}).alias("m"))
    flat = raw.select(F.explode("m").alias("mode", "m")).select("mode", F.explode("m").alias("rivals", "m"))
    flat = flat.select("mode", "rivals", F.explode("m").alias("difficulty", "s"))
    keys = (F.coalesce(F.col("s.long")[k], F.when(F.col(k) != r"\N", F.regexp_replace(k, r"^\\\\", r"\\"))).alias(k) for k in SCORE_KEYS)
    return flat.select(*keys, "s.player_wins", "s.ai_wins", "s.player_score", "s.ai_score")


def nested_scoreboard(scores: DataFrame, documents: int = 1) -> DataFrame:
    """The scoreboard as nested JSON in one row, or dealt by its keys to so many rows, each with a nested scoreboard.

    JSON has no null keys: null is \\N, and a key's own leading backslash is doubled. Readers of JSON take no names over
    50,000 characters: a key over NAME is \\L and its hash, and the counts hold its text."""
    names, long = [], []
    for k in SCORE_KEYS:
        is_long = F.length(k) > NAME
        own = F.when(is_long, F.concat(F.lit(r"\L"), F.sha2(k, 256))).otherwise(F.regexp_replace(k, r"^\\", r"\\\\"))
        names.append(F.coalesce(own, F.lit(r"\N")).alias(k))
        long.append(F.when(is_long, F.col(k)).alias(k))
    held = F.when(F.coalesce(*long).isNotNull(), F.struct(*long)).alias("long")
    a = scores.select(*names, F.struct("player_wins", "ai_wins", "player_score", "ai_score", held).alias("s"))
    part = ["part"] if documents > 1 else []
    if part:
        a = a.withColumn("part", F.pmod(F.xxhash64(*SCORE_KEYS), F.lit(documents))).repartition("part")
    a = a.groupBy(*part, "mode", "rivals").agg(F.map_from_entries(F.collect_list(F.struct("difficulty", "s"))).alias("d"))
    b = a.groupBy(*part, "mode").agg(F.map_from_entries(F.collect_list(F.struct("rivals", "d"))).alias("r"))
    return b.groupBy(*part).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("mode", "r")))).alias("value")).select("value")


def write_scoreboard(scores: DataFrame, path: str) -> None:
    """One JSON document; beyond DOCUMENT combinations a sequence of JSON texts (RFC 7464) of about so many each, so that
    no task holds the whole scoreboard."""
    held = scratch_dir(scores.sparkSession, "scores")  # the scores are made once for their number and the rows
    scores.write.parquet(held)
    rows = scores.sparkSession.read.schema(scores.schema).parquet(held)
    documents = -(-rows.count() // DOCUMENT)
    nested = nested_scoreboard(rows, documents)
    if documents > 1:
        nested = nested.select(F.concat(F.lit(JSON_APART), "value").alias("value"))
    nested.write.mode("overwrite").text(path)
    remove(scores.sparkSession, held)


def append_log(messages: DataFrame, path: str) -> None:
    """Append (Timestamp, Message) rows; every file carries the header."""
    messages.select("Timestamp", "Message").write.mode("append").option("header", True).csv(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents below a folder for each category."""
    docs.write.mode("overwrite").partitionBy("category").parquet(path)


def save_index(index: DataFrame, path: str) -> None:
    index.select("chunk_id", "text", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(INDEX).parquet(path) if place.getFileSystem(conf).exists(place) else None


def missing_from_index(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks that an index read whole lacks: only these need vectors before an append."""
    return chunks.join(index.select("chunk_id"), "chunk_id", "left_anti")


def cached_index(chunks: DataFrame, path: str, make, batch: int) -> DataFrame:
    """The index at path after the chunks(chunk_id, text) that it lacked got vectors; make(chunks) adds embedding.

    The index lies in hash buckets with Bloom filters, so a build reads of it only the keys that may be known, writes
    the new rows only, and may run again under its batch number."""
    new = make(missing_keys(chunks.dropDuplicates(["chunk_id"]), path, INDEX, "chunk_id"))
    new = new.select("chunk_id", "text", F.col("embedding").cast("array<float>").alias("embedding"))
    held = scratch_dir(chunks.sparkSession, "vectors")  # the model runs once for filters and rows
    new.write.parquet(held)
    add_rows(chunks.sparkSession.read.schema(new.schema).parquet(held), path, "chunk_id", batch)
    remove(chunks.sparkSession, held)
    return read_deltas(chunks.sparkSession, f"{path}/rows", INDEX).select("chunk_id", "text", "embedding")


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def framed_pages(exported: DataFrame) -> DataFrame:
    """(source, page, text) of exported PDF text framed by page marks; empty pages are dropped."""
    parts = exported.select("source", F.posexplode(F.split("text", "\n?={80}\nPÁGINA [0-9]+\n={80}\n")).alias("page", "text"))
    return parts.where("page > 0 AND trim(text) <> ''")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; in local mode without one, below the
    warehouse."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/textmill/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch_dir that nothing reads any more."""
    if "/textmill/" in folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

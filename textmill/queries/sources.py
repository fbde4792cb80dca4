"""Sources and sinks: tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators import chunk
from textmill.plans import corpus
from textmill.queries.register import registry
from textmill.sources import tables as io
from textmill.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = io.scratch_dir(spark, "csv")
    io.write_csv(rows, path)
    return io.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("""SELECT CAST(doc_id AS VARCHAR) || '-' || s // 3600 AS id, substr(text, CAST(s AS INT) + 1, 4000) AS text, source AS source_file, lang AS category, CAST(s // 3600 AS INT) AS chunk_index
    FROM (SELECT *, unnest(range(0, length(text), 3600)) AS s FROM documents)""")
def jsonl_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = chunk.fixed_chunks(docs).join(docs.select("doc_id", "source", "lang"), "doc_id")
    total = F.lit(None).cast("int")
    none = F.lit(None).cast("string")
    meta = F.struct(F.col("source").alias("source_file"), F.col("lang").alias("category"), "chunk_index", total.alias("total_chunks_in_doc"), none.alias("title"), none.alias("original_url"), none.alias("type"))
    path = io.scratch_dir(spark, "chunks")
    io.write_chunks(chunks.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.col("chunk").alias("text"), meta.alias("metadata")), path)
    return io.read_chunks(spark, path).select(F.col("metadata.chunk_id").alias("id"), "text", "metadata.source_file", "metadata.category", "metadata.chunk_index")


@query("SELECT event_type AS mode, CAST(user_id % 3 AS VARCHAR) AS rivals, CAST(user_id % 4 AS VARCHAR) AS difficulty, CAST(count(*) AS INT) AS player_wins, 0 AS ai_wins, CAST(sum(user_id) AS INT) AS player_score, 0 AS ai_score FROM events GROUP BY 1, 2, 3")
def scoreboard_round_trip(spark, sf_dir):
    u = F.col("user_id")
    keys = [F.col("event_type").alias("mode"), (u % 3).cast("string").alias("rivals"), (u % 4).cast("string").alias("difficulty")]
    scores = table(spark, sf_dir, "events").groupBy(*keys).agg(F.count("*").alias("player_wins"), F.lit(0).alias("ai_wins"), F.sum(u).alias("player_score"), F.lit(0).alias("ai_score"))
    path = io.scratch_dir(spark, "scores")
    io.write_scoreboard(scores, path)
    return io.read_scoreboard(spark, path)


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 3 = 0")
def index_increment(spark, sf_dir):
    """The index holds two thirds of the chunks; the rest still needs vectors."""
    e = table(spark, sf_dir, "embeddings")
    path = io.scratch_dir(spark, "index")
    io.save_index(e.where("vec_id % 3 <> 0").select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("t").alias("text"), "embedding"), path)
    chunks = e.select(F.col("vec_id").cast("string").alias("chunk_id"))
    return io.missing_from_index(chunks, io.load_index(spark, path)).select(F.col("chunk_id").cast("long").alias("chunk_id"))


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 't' || CASE WHEN vec_id % 3 <> 0 THEN 0 WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END AS text FROM embeddings")
def index_builds(spark, sf_dir):
    """Three builds of one index: two thirds of the chunks, then the even ones, then all; each makes vectors for what
    is new only, and the text tells the build that made it."""
    e = table(spark, sf_dir, "embeddings").withColumn("chunk_id", F.col("vec_id").cast("string"))
    path, out = io.scratch_dir(spark, "index"), None
    for n, which in enumerate(("vec_id % 3 <> 0", "vec_id % 2 = 0", "true")):
        vectors = e.select("chunk_id", "embedding")
        out = io.cached_index(e.where(which).select("chunk_id", F.lit(f"t{n}").alias("text")), path, lambda new, v=vectors: new.join(v, "chunk_id"), n)
    return out.select("chunk_id", "text")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'café ' || doc_id END AS text FROM documents")
def decode_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.concat(F.lit("café "), F.col("doc_id").cast("string")), "ISO-8859-1"))
    return docs.select("doc_id", io.decode_fallback(raw).alias("text"))


@query("SELECT 'f' || doc_id AS source, 1 AS page, text FROM documents WHERE trim(text) <> ''")
def framed_pages(spark, sf_dir):
    rule = "=" * 80
    framed = F.concat(F.lit(f"\n{rule}\nPÁGINA 1\n{rule}\n"), "text", F.lit(f"\n{rule}\nPÁGINA 2\n{rule}\n "))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source"), framed.alias("text"))
    return io.framed_pages(docs)


@query()
def corpus_build(spark, sf_dir):
    return corpus.build(table(spark, sf_dir, "pages"))


_LOG = "SELECT event_id AS n, CAST(date_trunc('second', ts) AS VARCHAR) AS stamp FROM events"


@query(_LOG)
def log_append(spark, sf_dir):
    """Two appends to one log that together hold all events, read back with the log's own time stamps."""
    events = table(spark, sf_dir, "events")
    path = io.scratch_dir(spark, "log")
    for k in (0, 1):
        part = events.where(F.coalesce(F.pmod("event_id", F.lit(2)), F.lit(0)) == k)
        io.append_log(part.select(F.date_trunc("second", "ts").alias("Timestamp"), F.col("event_id").cast("string").alias("Message")), path)
    return io.read_csv(spark, path, io.LOG).select(F.col("Message").cast("long").alias("n"), F.col("Timestamp").cast("string").alias("stamp"))


@query(_LOG)
def log_append_all(spark, sf_dir):
    return log_append(spark, sf_dir)


@query("SELECT 'lang=' || lang AS category, CAST(sum(length(text) + 1) AS BIGINT) AS characters, CAST(sum(n_chars) AS BIGINT) AS declared FROM documents GROUP BY 1")
def corpus_files(spark, sf_dir):
    """Documents written as text files below a folder for each language and read as a corpus; a hundred
    texts make a file, and every text ends with a line end."""
    docs = table(spark, sf_dir, "documents")
    path = io.scratch_dir(spark, "corpus")
    docs.select("lang", "text").write.partitionBy("lang").option("maxRecordsPerFile", 100).text(path)
    corpus_ = io.read_corpus(spark, path).groupBy("category").agg(F.sum(F.length("text")).alias("characters"))
    declared = docs.groupBy(F.concat(F.lit("lang="), "lang").alias("category")).agg(F.sum("n_chars").alias("declared"))
    return corpus_.join(declared, "category")


@query("SELECT doc_id, lang AS category, text FROM documents")
def documents_by_category(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), "text")
    path = io.scratch_dir(spark, "documents")
    io.write_documents(docs, path)
    return spark.read.schema(docs.schema).parquet(path)


@query("SELECT item_id AS query_id, text AS question, n FROM benchmark CROSS JOIN (SELECT unnest([1, 2]) AS n)")
def results_append(spark, sf_dir):
    """Two runs appended to one file of results."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    path = io.scratch_dir(spark, "results")
    for n in (1, 2):
        io.append_results(q.withColumn("n", F.lit(n)), path)
    return spark.read.schema("query_id long, question string, n int").json(path)


@query("SELECT doc_id, CAST(s // 3600 AS INT) AS chunk_index, sha256(doc_id || '|' || s // 3600 || '|' || substr(text, CAST(s AS INT) + 1, 4000)) AS chunk_id FROM (SELECT doc_id, text, unnest(range(0, length(text), 3600)) AS s FROM documents)")
def chunk_ids(spark, sf_dir):
    chunks = chunk.fixed_chunks(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_index", chunk.chunk_id("doc_id", "chunk_index", "chunk").alias("chunk_id"))

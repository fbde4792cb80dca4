"""Queries on vectors, questions and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators import chunk
from textmill.operators import retrieve as r
from textmill.queries.register import registry
from textmill.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


def _index(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _questions(spark, sf_dir, n):
    """The vectors whose id is divisible by n stand in for questions."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % n == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_Q = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 50 = 0), i AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
_COS = "list_sum(list_transform(list_zip(embedding, query), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x * x))) * sqrt(list_sum(list_transform(query, lambda x: x * x))))"
_TOP = f"""{_Q},
    d AS (SELECT query_id, chunk_id, round(list_sum(list_transform(list_zip(embedding, query), lambda p: pow(p[1] - p[2], 2.0))), 6) AS distance FROM i, q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d),
    top AS (SELECT * FROM ranked WHERE rank <= 10)"""


@query(f"WITH {_Q}, s AS (SELECT query_id, chunk_id, round({_COS}, 6) AS score FROM i, q WHERE query_id <> chunk_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM s) SELECT query_id, chunk_id, score FROM k WHERE n = 1")
def cosine_best(spark, sf_dir):
    return r.best_match(_index(spark, sf_dir), _questions(spark, sf_dir, 50), exclude_self=True).drop("answer")


@query(f"""WITH {_Q}, s AS (SELECT query_id, chunk_id, round({_COS}, 6) AS score FROM i, q WHERE query_id <> chunk_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM s WHERE score > 0.9)
    SELECT q.query_id, chunk_id, score, CASE WHEN chunk_id IS NULL THEN '{r.DEFAULT_ANSWER}' END AS answer FROM q LEFT JOIN k ON k.query_id = q.query_id AND n = 1""")
def best_match_or_default(spark, sf_dir):
    """Questions without a chunk above 0.9 get the default answer."""
    return r.best_match(_index(spark, sf_dir), _questions(spark, sf_dir, 50), exclude_self=True, above=0.9)


@query(f"WITH {_TOP} SELECT query_id, chunk_id, distance, rank FROM top")
def topk_l2(spark, sf_dir):
    return r.top_k(_index(spark, sf_dir), _questions(spark, sf_dir, 50), 10)


_CONTEXT = f"{_TOP}, c AS (SELECT query_id, string_agg('chunk ' || chunk_id, chr(10) ORDER BY rank) AS context FROM top GROUP BY 1)"


def _contexts(spark, sf_dir):
    top = r.top_k(_index(spark, sf_dir), _questions(spark, sf_dir, 50), 10)
    return r.join_context(top.withColumn("text", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))))


@query(f"WITH {_CONTEXT} SELECT * FROM c")
def context_join(spark, sf_dir):
    return _contexts(spark, sf_dir)


@query(f"WITH {_CONTEXT} SELECT query_id, 'Contexto:' || chr(10) || context || chr(10) || chr(10) || 'Pregunta: ' || query_id || chr(10) || 'Respuesta:' AS prompt FROM c")
def prompt_render(spark, sf_dir):
    return _contexts(spark, sf_dir).select("query_id", r.render_prompt("context", F.col("query_id").cast("string")).alias("prompt"))


@query("SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS lengths, max(len(embedding)) AS dim FROM embeddings")
def vector_dims(spark, sf_dir):
    return r.dimensions(table(spark, sf_dir, "embeddings"))


@query("SELECT conv_id, turn, role, text, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS back FROM conversations) WHERE back <= 4")
def history_window(spark, sf_dir):
    return r.history_window(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role", "text", "back")


@query("""SELECT conv_id, turn, role, text, count(text) OVER w AS n_seen, coalesce(string_agg(text, chr(10)) OVER w, '') AS seen
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def turn_context(spark, sf_dir):
    return r.turn_context(table(spark, sf_dir, "conversations"))


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang || '.txt' END AS card_title, CASE WHEN doc_id % 4 = 0 THEN 'DOCUMENTO' ELSE upper(lang) END AS card_type,
    translate(substr(text, 1, 150), chr(10), ' ') AS snippet, CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id END AS card_url FROM documents""")
def source_cards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    when = lambda n, a, b: F.when(F.col("doc_id") % n == 0, a).otherwise(b)
    return r.source_cards(
        docs.select(
            F.col("doc_id").alias("chunk_id"),
            "text",
            when(3, F.col("source"), F.lit(" ")).alias("title"),
            F.concat("lang", F.lit(".txt")).alias("source_file"),
            when(4, F.lit(None), F.col("lang")).alias("type"),
            when(2, F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")), F.lit("N/A")).alias("url"),
        )
    )


@query(f"""WITH {_TOP}, k AS (SELECT query_id, list(substr('fragment ' || chunk_id, 1, 200) ORDER BY rank) AS c, count(*) AS n FROM top GROUP BY 1)
    SELECT item_id AS query_id, text AS question, 'answer ' || item_id AS answer, coalesce(n, 0) AS n_fragments, coalesce(array_to_string(c, '|'), '') AS chunks FROM benchmark LEFT JOIN k ON query_id = item_id""")
def qa_records(spark, sf_dir):
    top = r.top_k(_index(spark, sf_dir), _questions(spark, sf_dir, 50), 10).withColumn("text", F.concat(F.lit("fragment "), F.col("chunk_id").cast("string")))
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"))
    return r.qa_records(answers, top).withColumn("chunks", F.array_join("chunks", "|"))


@query(f"SELECT lang, count(*) FILTER (strlen(text) <= {r.LONGEST}) AS kept, count(*) AS n FROM documents GROUP BY 1")
def oversize_guard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = r.oversize_guard(docs).groupBy("lang").agg(F.count("*").alias("kept"))
    return docs.groupBy("lang").agg(F.count("*").alias("n")).join(kept, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), "n")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0")
def failed_vectors(spark, sf_dir):
    """One vector in seven came back empty."""
    e = table(spark, sf_dir, "embeddings")
    made = e.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")))
    return r.drop_failed(made).select("vec_id", "label")


def _letters(texts):
    return [[(t or "").count(chr(97 + i)) for i in range(26)] for t in texts]


@query(f"""SELECT doc_id, CAST(i AS INT) AS letter, length(text) - length(replace(text, chr(CAST(97 + i AS INT)), '')) AS n
    FROM documents, range(26) r(i) WHERE strlen(text) <= {r.LONGEST}""")
def letter_embeddings(spark, sf_dir):
    """The encoder with a model of the caller's own, which counts letters."""
    docs = r.oversize_guard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = r.drop_failed(r.embed(docs, model=_letters))
    return made.select("doc_id", F.posexplode("embedding").alias("letter", "n")).withColumn("n", F.col("n").cast("long"))


@query()
def hashed_embeddings(spark, sf_dir):
    """Texts of any length; only those whose hashed words give no vector, as without words, are left out."""
    return r.drop_failed(r.embed(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "embedding")


@query()
def doc_search(spark, sf_dir):
    """The benchmark's passages as questions against all chunks of the documents."""
    chunks = chunk.fixed_chunks(table(spark, sf_dir, "documents"), 1000, 200).where("length(chunk) >= 50")
    index = r.drop_failed(r.embed(chunks.select(chunk.chunk_id("doc_id", "chunk_index", "chunk").alias("chunk_id"), F.col("chunk").alias("text"))))
    q = r.drop_failed(r.embed(table(spark, sf_dir, "benchmark"))).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return r.top_k(index.select("chunk_id", "embedding"), q, 5)

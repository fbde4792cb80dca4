"""Vectors of chunks, exact top-k retrieval, context assembly and bounded chat history."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.batches import udf
from textmill.functions.text import col
from textmill.operators.nearest import BlockedIndex, nearest_pairs
from textmill.operators.nearest import top_k as top_k

#: Bytes of the longest text that oversize_guard keeps, for models with such a limit; characters of a text whose words
#: are hashed at a time.
LONGEST, SLICE = 35_000, 1 << 18
_BLANK = re.compile(r"\s")
DEFAULT_ANSWER = "No se encontró información relevante."


def oversize_guard(chunks: DataFrame, text: str = "text", most: int = LONGEST) -> DataFrame:
    return chunks.where(F.octet_length(text) <= most)


def _words(text: str) -> Iterator[list[str]]:
    """The lower-case words, of a long text in lists of about SLICE characters."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + SLICE)
        end = blank.start() if blank else len(text)
        yield text[at:end].lower().split()
        at = end


def _hashed(texts, dim: int) -> list[np.ndarray]:
    from xxhash import xxh64_intdigest

    out = []
    for t in texts:
        v = np.zeros(dim)
        for words in _words(t or ""):
            h = np.array([xxh64_intdigest(w, 7) for w in words], np.uint64)
            v += np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), dim)
        n = np.linalg.norm(v)
        out.append(v / n if n else np.empty(0))
    return out


def embed(chunks: DataFrame, dim: int = 64, text: str = "text", model=None) -> DataFrame:
    """Adds embedding array<float>. model maps a list of texts to vectors and is called once for each
    piece of an Arrow batch on the executors; the default hashes words. Texts without a vector get an empty array."""
    make = model or (lambda texts: _hashed(texts, dim))
    run = udf(lambda texts: pa.array([np.asarray(v, dtype=np.float32) for v in make(texts)], pa.list_(pa.float32())), "array<float>")
    # a filter on the vectors would otherwise be pushed below them, and the model run twice
    return chunks.withColumn("embedding", run.asNondeterministic()(text))


def drop_failed(index: DataFrame) -> DataFrame:
    return index.where(F.size("embedding") > 0)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(col(v), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: str | Column, b: str | Column, na: str | Column | None = None, nb: str | Column | None = None) -> Column:
    """Cosine of two arrays; 0.0 if a norm is 0. Pass norms that are computed already."""
    na, nb = norm(a) if na is None else col(na), norm(b) if nb is None else col(nb)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(_dot(col(a), col(b)) / (na * nb))


def squared_l2(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def best_match(index: DataFrame, queries: DataFrame, digits: int = 6, exclude_self: bool = False, above: float = -1.0, default: str = DEFAULT_ANSWER) -> DataFrame:
    """(query_id, chunk_id, score, answer): the largest cosine of each query, smallest chunk_id on ties.

    A query without a chunk above `above` (any cosine by default) has no chunk and the default answer. The
    largest cosine is the least distance of the vectors at length 1, so blocks are left out as in top_k. A vector
    of length 0 has cosine 0 with every other: of these only the two smallest ids can win.
    """
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.col("__n"))
    sized = lambda df, v: df.where(F.size(v) > 0).withColumn("__n", norm(v))
    chunks, asked = sized(index.select("chunk_id", "embedding"), "embedding"), sized(queries.select("query_id", "query"), "query")
    usual = asked.where("__n > 0").withColumn("query", unit("query"))
    blocked = BlockedIndex(chunks.where("__n > 0").withColumn("embedding", unit("embedding")))
    kind = index.schema["chunk_id"].dataType.simpleString()
    first = lambda df: F.array(*(F.lit(r["chunk_id"]) for r in df.select("chunk_id").orderBy("chunk_id").limit(2).collect())).cast(f"array<{kind}>")
    found = asked.where("__n > 0").select("query_id", F.explode(first(chunks.where("__n = 0"))).alias("chunk_id"), F.lit(0.0).alias("score"))
    found = found.union(asked.where("__n = 0").select("query_id", F.explode(first(chunks)).alias("chunk_id"), F.lit(0.0).alias("score")))
    if len(blocked.pivots):
        near, _ = nearest_pairs(blocked, usual, 2 if exclude_self else 1)
        found = found.union(near.select("query_id", "chunk_id", F.round(1 - F.col("score") / 2, digits).alias("score")))
    if exclude_self:
        found = found.where(F.col("query_id").cast("string") != F.col("chunk_id").cast("string"))
    best = found.where(F.col("score") > above).groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("b"))
    best = best.select("query_id", F.col("b.chunk_id").alias("chunk_id"), (-F.col("b.s")).alias("score"))
    return queries.select("query_id").join(best, "query_id", "left").withColumn("answer", F.when(F.col("chunk_id").isNull(), default))


def dimensions(index: DataFrame) -> DataFrame:
    """One row: number of vectors, of different lengths, and the length."""
    size = F.size("embedding")
    return index.agg(F.count("*").alias("vectors"), F.countDistinct(size).alias("lengths"), F.max(size).alias("dim"))


def join_context(ranked: DataFrame, glue: str = "\n") -> DataFrame:
    """(query_id, context): texts of ranked(query_id, rank, text) in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))  # k texts
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), glue).alias("context"))


def render_prompt(context: str | Column, question: str | Column) -> Column:
    return F.format_string("Contexto:\n%s\n\nPregunta: %s\nRespuesta:", col(context), col(question))


def history_window(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of every conversation."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("role"), F.col("text")))
    return messages.withColumn("back", rank).where(F.col("back") <= n)


def turn_context(messages: DataFrame, n: int = 10) -> DataFrame:
    """Each message with how many of up to n earlier ones it can see and their joined texts."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-n, -1)
    seen = F.collect_list("text").over(w)
    return messages.select("conv_id", "turn", "role", "text", F.size(seen).alias("n_seen"), F.array_join(seen, "\n").alias("seen"))


def source_cards(chunks: DataFrame) -> DataFrame:
    """Cards of chunks(chunk_id, text, title, source_file, type, url): title or file name or a default,
    type in capitals, a one-line snippet of 150 characters, the URL only if it is one."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return chunks.select(
        "chunk_id",
        F.coalesce(filled("title"), filled("source_file"), F.lit("Documento")).alias("card_title"),
        F.upper(F.coalesce(filled("type"), F.lit("documento"))).alias("card_type"),
        F.translate(F.substring("text", 1, 150), "\n", " ").alias("snippet"),
        F.when(F.col("url").startswith("http"), F.col("url")).alias("card_url"),
    )


def qa_records(answers: DataFrame, ranked: DataFrame, snippet: int = 200) -> DataFrame:
    """(query_id, question, answer, n_fragments, chunks): answers with their ranked snippets."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, snippet).alias("text"))))
    found = ranked.groupBy("query_id").agg(F.transform(ordered, lambda r: r["text"]).alias("chunks"), F.count("*").alias("n_fragments"))
    return answers.join(found, "query_id", "left").select("query_id", "question", "answer", F.coalesce("n_fragments", F.lit(0)).alias("n_fragments"), F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))

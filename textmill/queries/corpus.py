"""Cleaning and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import text as t
from textmill.operators import chunk, clean
from textmill.queries.register import registry
from textmill.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

#: The corpus at hand has no gazette headers, so licence and markup lines stand in for them.
EXTRA_NOISE = (r"licensed under", r"[^ ]+\.$")
KEYWORDS = ("license", "the", "of")
_STRIP = f"'^{t.BLANK}+|{t.BLANK}+$'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_STRIP}, '', 'g')"


_NOISE = f"(length({_strip('{x}')}) < 3 OR regexp_matches({_strip('{x}')}, '^(?:{t.BLANK}|[-_.=*])+$') OR regexp_matches({_strip('{x}')}, '(?i){t.noise_regex(EXTRA_NOISE)}'))"


def _noise(x: str) -> str:
    return _NOISE.replace("{x}", x)


_LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_HEADERS = f"""
    headers AS (SELECT doc_id, {_strip('line')} AS bare, count(*) AS n FROM lines
        WHERE length({_strip('line')}) > 10 AND regexp_matches(lower({_strip('line')}), '{'|'.join(KEYWORDS)}')
        GROUP BY 1, 2 HAVING count(*) >= 3)"""
_CLEAN = f"""
    WITH {_LINES}, {_HEADERS},
    kept AS (SELECT l.doc_id, pos, line, {_strip('line')} AS bare FROM lines l
        WHERE NOT {_noise('line')} AND NOT EXISTS (SELECT 1 FROM headers h WHERE h.doc_id = l.doc_id AND h.bare = {_strip('l.line')})),
    marked AS (SELECT *, bare <> '' AND bare IS NOT DISTINCT FROM lag(bare) OVER (PARTITION BY doc_id ORDER BY pos) AS again FROM kept),
    parts AS (SELECT doc_id, (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id) AS n_lines,
        (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id) - (SELECT count(*) FROM kept k WHERE k.doc_id = d.doc_id) AS n_noise,
        (SELECT count(*) FROM marked k WHERE k.doc_id = d.doc_id AND again) AS n_repeats,
        coalesce((SELECT string_agg({_strip("regexp_replace(line, ' +', ' ', 'g')")}, chr(10) ORDER BY pos) FROM marked k WHERE k.doc_id = d.doc_id AND NOT again), '') AS clean
        FROM documents d)
"""


@query(f"WITH {_LINES} SELECT * FROM lines")
def doc_lines(spark, sf_dir):
    return clean.lines(table(spark, sf_dir, "documents"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) FILTER ({_noise('line')}) AS noise, count(*) AS n FROM lines GROUP BY 1")
def noise_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    split = F.split("text", "\n")
    return rows.select("doc_id", F.size(F.filter(split, lambda x: t.is_noise(x, EXTRA_NOISE))).alias("noise"), F.size(split).alias("n"))


@query(f"WITH {_LINES}, {_HEADERS} SELECT doc_id, bare FROM headers")
def repeated_headers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(clean.header_lines("text", 3, KEYWORDS)).alias("bare"))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, {_strip('line')} AS bare, lag({_strip('line')}) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM lines)
    SELECT doc_id, count(*) FILTER (bare <> '' AND bare = before) AS repeats FROM k GROUP BY 1""")
def consecutive_dups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    split = F.split("text", "\n")
    return docs.select("doc_id", (F.size(split) - F.size(clean.without_repeats(split))).alias("repeats"))


@query(f"{_CLEAN} SELECT * FROM parts")
def clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean.clean_parts(docs, extra=EXTRA_NOISE, keywords=KEYWORDS).drop("text")


@query(f"{_CLEAN} SELECT count(*) AS processed, 0 AS errors, sum(n_noise) AS noise_lines, sum(n_repeats) AS duplicate_lines FROM parts")
def cleaning_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean.cleaning_report(clean.clean_parts(docs, extra=EXTRA_NOISE, keywords=KEYWORDS))


@query(f"{_CLEAN}, c AS (SELECT doc_id, clean, unnest(range(0, length(clean), 900)) AS s FROM parts WHERE length(clean) > 0) SELECT lang, count(*) AS chunks, round(avg(length(substr(clean, CAST(s AS INT) + 1, 1000))), 4) AS mean_length FROM c JOIN documents USING (doc_id) GROUP BY 1")
def corpus_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    parts = clean.clean_parts(docs, extra=EXTRA_NOISE, keywords=KEYWORDS)
    chunks = chunk.fixed_chunks(parts, 1000, 100, key="lang", text="clean")
    return chunks.groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("chunk")), 4).alias("mean_length"))


_FIXED = "SELECT doc_id, CAST(s // 3600 AS INT) AS chunk_index, substr(text, CAST(s AS INT) + 1, 4000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 3600)) AS s FROM documents)"


@query(_FIXED)
def fixed_chunks(spark, sf_dir):
    return chunk.fixed_chunks(table(spark, sf_dir, "documents"))


@query(f"SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks FROM ({_FIXED}) WHERE length(chunk) >= 50")
def chunk_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunk.chunk_totals(docs, chunk.fixed_chunks(docs).where(F.length("chunk") >= 50))


@query(f"SELECT * FROM ({_FIXED}) WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5)")
def limited_chunks(spark, sf_dir):
    return chunk.fixed_chunks(chunk.limit_documents(table(spark, sf_dir, "documents")))


@query("""WITH c AS (SELECT doc_id, s, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks
        FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS s FROM documents)),
    t AS (SELECT doc_id, chunk_index, total_chunks, substr(text, CAST(s AS INT) + 1, 500) AS chunk FROM c)
    SELECT doc_id, chunk_index, total_chunks, sha256(doc_id || '|' || chunk_index || '|' || chunk) AS chunk_id FROM t WHERE length(chunk) >= 50""")
def chunk_numbers(spark, sf_dir):
    """The total counts the chunks that are too short to stay."""
    return chunk.numbered_chunks(table(spark, sf_dir, "documents"), 500, 50).drop("chunk")


@query()
def semantic_chunks(spark, sf_dir):
    return chunk.semantic_chunks(table(spark, sf_dir, "documents"))


@query()
def recursive_chunks(spark, sf_dir):
    return chunk.recursive_chunks(table(spark, sf_dir, "documents"), 500, 50)


@query("SELECT lang, count(*) AS docs, count(*) FILTER (text <> nfc_normalize(text)) AS changed FROM documents GROUP BY 1")
def nfc_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("text") != t.nfc("text")).alias("changed"))


_RULE = "repeat('=', 80)"


@query(f"""SELECT doc_id, 'LEY' AS category, source AS title, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS kind,
    n_chars AS body_length FROM documents""")
def header_roundtrip(spark, sf_dir):
    """Documents rendered with a header and parsed again."""
    from textmill.operators.html import render_document

    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    made = docs.select("doc_id", render_document(F.lit("LEY"), kind, "source", F.lit("https://example.org/x"), "text").alias("doc"))
    got = made.select("doc_id", clean.parse_header("doc").alias("h"))
    meta = clean.essential("h.metadata")
    return got.select("doc_id", F.try_element_at(meta, F.lit("CATEGORÍA")).alias("category"), F.try_element_at(meta, F.lit("TÍTULO")).alias("title"), F.try_element_at(meta, F.lit("TIPO")).alias("kind"), (F.length("h.body") - 1).cast("long").alias("body_length"))


@query(f"""SELECT doc_id, title, type, original_url, length(trim(text, chr(10) || ' ')) AS n FROM
    (SELECT doc_id, source AS title, lang AS type, 'https://example.org/' || doc_id AS original_url, text FROM documents)""")
def chunk_headers(spark, sf_dir):
    """Clean documents rebuilt, then their header fields and bodies taken out as the chunker does."""
    docs = table(spark, sf_dir, "documents")
    meta = F.create_map(F.lit("TIPO"), "lang", F.lit("TÍTULO"), "source", F.lit("URL ORIGINAL"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")))
    made = docs.select("doc_id", clean.rebuild_document(meta, "text", "source").alias("doc"))
    head = chunk.header_metadata("doc")
    body = t.strip(chunk.chunk_body("doc", strip_footer=True))
    return made.select("doc_id", head["title"].alias("title"), head["type"].alias("type"), head["original_url"].alias("original_url"), F.length(body).alias("n"))

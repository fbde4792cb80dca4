"""The corpus build as one lazy plan: pages -> documents -> clean text -> chunks -> vectors.

Every step is row-local, so the plan has no shuffle but for the file names' numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.batches import flat_map
from textmill.operators import chunk, clean, html, retrieve


def page_contents(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, content): the block texts of each page joined by blank lines."""

    def content(page_id, url, title, page):
        yield page_id, url, title, "\n\n".join(text for _, _, text in html._blocks_of(page))

    titled = pages.select("page_id", "url", html.page_title("html").alias("title"), "html")
    return flat_map(titled, content, "page_id long, url string, title string, content string")


def documents(pages: DataFrame) -> DataFrame:
    """Stored documents with class, priority, type, file name and the text with its header block."""
    rows = page_contents(pages).where("content <> ''")
    c = html.classify("url", "title")
    rows = rows.withColumns(
        {
            "category": c["category"],
            "directory": c["directory"],
            "priority": html.doc_priority("url"),
            "type": html.doc_type("url"),
            "name": html.page_name("title", "url"),
        }
    )
    rows = html.unique_names(rows)
    return rows.withColumn("text", html.render_document("category", "type", "title", "url", "content"))


def build(pages: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """(page_id, chunk_index, total_chunks, chunk_id, chunk, embedding) of every page."""
    docs = documents(pages)
    parsed = docs.select("page_id", "file", clean.parse_header("text").alias("h"))
    parts = clean.clean_parts(parsed.select("page_id", "file", F.col("h.metadata").alias("metadata"), F.col("h.body").alias("body")), text="body")
    ready = parts.select("page_id", clean.rebuild_document("metadata", "clean", "file").alias("text"))
    chunks = chunk.semantic_chunks(ready.select("page_id", chunk.chunk_body("text").alias("text")), size, overlap, key="page_id")
    return retrieve.drop_failed(retrieve.embed(retrieve.oversize_guard(chunks, "chunk"), text="chunk"))

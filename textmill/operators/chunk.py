"""Chunking of documents. Row-local: no shuffle but for totals."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.batches import flat_map
from textmill.functions.text import col, strip

#: Characters over the size that a semantic chunk may have before the next separator is tried.
SLACK = 100
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def fixed_chunks(docs: DataFrame, size: int = 4000, overlap: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, chunk): windows at 0, size - overlap, ...; the last may lie inside its predecessor."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    return docs.select(key, F.posexplode(F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size)))).alias("chunk_index", "chunk"))


def numbered_chunks(docs: DataFrame, size: int = 4000, overlap: int = 400, least: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, total_chunks, chunk_id, chunk) of fixed windows, without Python; chunks under `least`
    go after the numbering, so the total counts them. A null or empty text has no chunks."""
    total = F.ceil(F.length(text) / F.lit(size - overlap)).cast("int")
    rows = docs.select(F.col(key), F.col(text).alias("__text"), total.alias("total_chunks"), F.posexplode(F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))).alias("chunk_index", "__at"))
    rows = rows.select(key, "chunk_index", "total_chunks", F.substring("__text", F.col("__at") + 1, F.lit(size)).alias("chunk"))
    return rows.where(F.length("chunk") >= least).select(key, "chunk_index", "total_chunks", chunk_id(key, "chunk_index", "chunk").alias("chunk_id"), "chunk")


def chunk_id(key: str | Column, index: str | Column, text: str | Column) -> Column:
    """The same id in every run."""
    return F.sha2(F.concat_ws("|", col(key).cast("string"), col(index).cast("string"), col(text)), 256)


def _ends(text: str, mark: str):
    """Where a chunk of the text may end: behind each mark, one more of which follows the text; anywhere
    without a mark."""
    if not mark:
        return range(1, len(text) + 1)
    return [m.end() for m in re.finditer(re.escape(mark), text)] + [len(text) + len(mark)]


def _spans(text: str, ends, size: int, overlap: int):
    """(start, end) of chunks of the text that end at some of the ends. Each holds one stretch between ends at least, and as
    many as fit the size. The next one starts behind the first blank of its predecessor's last one and
    a half overlaps if that leaves half an overlap or more, else a whole overlap before its end; a
    chunk no longer than the overlap isn't repeated."""
    start = i = 0
    while i < len(ends):
        i = max(i + 1, bisect_right(ends, start + size))
        end = ends[i - 1]
        yield start, end
        if end - start <= overlap:
            start = end
            continue
        blank = text.find(" ", max(start, end - overlap * 3 // 2), end) if overlap else -1
        start = blank + 1 if blank >= 0 and end - blank > overlap / 2 else end - overlap


def semantic_split(text: str, size: int = 1500, overlap: int = 200) -> list[str]:
    """Chunks at paragraphs; those over the size again at lines, sentences, words and characters, until none
    is over the size by more than SLACK. A mark counts as part of the chunk before it; blanks around
    chunks go."""
    chunks = [text]
    for mark in SEPARATORS:
        finer = []
        for whole in chunks:
            closed = whole + mark
            finer += [closed[a:b].strip() for a, b in _spans(closed, _ends(whole, mark), size, overlap)] if len(whole) > size else [whole]
        chunks = finer
        if max(map(len, chunks)) <= size + SLACK:
            break
    return chunks


def _merged(starts, end: int, size: int, overlap: int):
    """(start, end) of chunks made of neighbouring pieces, given their starts and the last one's end: as many
    as fit the size, repeating as many of the last ones as fit the overlap and leave room for the next."""
    first, last = 0, 1  # the chunk holds the pieces from first to before last
    at = lambda i: starts[i] if i < len(starts) else end
    while True:
        while last < len(starts) and at(last + 1) - at(first) <= size:
            last += 1
        yield at(first), at(last)
        if last == len(starts):
            return
        first = min(bisect_left(starts, max(at(last) - overlap, at(last + 1) - size)), last)
        last += 1


def recursive_split(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks by the coarsest separator that a stretch of text has: pieces shorter than the size are merged,
    longer ones are cut by the next separators. A separator belongs to the piece behind it; blanks around chunks go."""
    todo, spans = [(0, len(text), 0)], []
    while todo:
        lo, hi, level = todo.pop()
        if level < 0:  # a finished span, in its place
            spans.append((lo, hi))
            continue
        level = next((i for i in range(level, len(separators)) if separators[i] in text[lo:hi]), len(separators))
        if level == len(separators):
            spans.append((lo, hi))
            continue
        mark = separators[level]
        starts = range(lo, hi) if not mark else sorted({lo, *(m.start() for m in re.compile(re.escape(mark)).finditer(text, lo, hi))})
        found, run = [], []
        for a, b in zip(starts, [*starts[1:], hi]):
            if b - a < size:
                run.append(a)
                continue
            if run:
                found += [(x, y, -1) for x, y in _merged(run, a, size, overlap)]
                run = []
            found.append((a, b, level + 1 if level + 1 < len(separators) else -1))
        if run:
            found += [(x, y, -1) for x, y in _merged(run, hi, size, overlap)]
        todo += reversed(found)
    chunks = (text[a:b].strip() for a, b in spans)
    return [c for c in chunks if c]


def _split_with(docs: DataFrame, split, key: str, text: str, least: int) -> DataFrame:
    def chunks(k, t):
        parts = split(t) if t else []
        for i, c in enumerate(parts):
            if len(c) >= least:
                yield k, i, len(parts), hashlib.sha256(f"{k}|{i}|{c}".encode()).hexdigest(), c

    return flat_map(docs.select(key, text), chunks, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index int, total_chunks int, chunk_id string, chunk string")


def semantic_chunks(docs: DataFrame, size: int = 1500, overlap: int = 200, least: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, total_chunks, chunk_id, chunk); chunks under `least` go after the numbering."""
    return _split_with(docs, lambda t: semantic_split(t, size, overlap), key, text, least)


def recursive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, least: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _split_with(docs, lambda t: recursive_split(t, size, overlap), key, text, least)


def header_metadata(text: str | Column) -> Column:
    """struct<title, original_url, type> from the first 25 lines; the last of equal marks wins."""
    head = F.slice(F.split(col(text), "\n"), 1, 25)

    def last(mark: str) -> Column:
        hits = F.filter(head, lambda x: x.startswith(mark))
        return F.when(F.size(hits) > 0, strip(F.replace(F.element_at(hits, -1), F.lit(mark), F.lit(""))))

    return F.struct(last("TÍTULO:").alias("title"), last("URL ORIGINAL:").alias("original_url"), last("TIPO:").alias("type"))


def chunk_body(text: str | Column, strip_footer: bool = False) -> Column:
    """What follows the first CONTENIDO: without the rule below it; else the whole text."""
    t = col(text)
    body = strip(F.regexp_replace(strip(F.regexp_extract(t, r"(?s)CONTENIDO:(.*)", 1)), "^=+\n+", ""))
    out = F.when(F.contains(t, F.lit("CONTENIDO:")), body).otherwise(t)
    if strip_footer:
        out = F.regexp_replace(out, r"(?s)\n+={80}\nDocumento original: [^\n]*\nProcesado y limpiado automáticamente\n={80}\s*$", "")
    return out


def limit_documents(docs: DataFrame, n: int = 5, order: str = "doc_id") -> DataFrame:
    return docs.orderBy(order).limit(n)


def chunk_totals(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: documents read and chunks written."""
    return docs.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks")))

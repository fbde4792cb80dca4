"""Cleaning of documents. Everything is row-local on arrays of lines: no shuffle at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import HEADER_KEYWORDS, bare_is_noise, col, fix_mojibake, last_wins, let, nfc, strip

RULE = "={20}"
ESSENTIAL = ("CATEGORÍA", "TIPO", "TÍTULO", "URL ORIGINAL")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) with positions from 0; a null text has no lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _headers(bare: Column, least: int, keywords: tuple[str, ...] | None) -> Column:
    """Of stripped lines, those of more than 10 characters that come `least` times and hold a keyword."""
    long = F.filter(bare, lambda x: F.length(x) > 10)
    # runs of the sorted lines, so counting takes no look at all lines for each; few lines are left for the keywords
    often = let(F.sort_array(long), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + least - 1))))
    return often if keywords is None else F.filter(often, lambda x: F.lower(x).rlike("|".join(keywords)))


def header_lines(text: str | Column, least: int = 3, keywords: tuple[str, ...] | None = HEADER_KEYWORDS) -> Column:
    """Stripped lines of more than 10 characters that occur `least` times in the text and hold a keyword."""
    return _headers(F.transform(F.split(col(text), "\n"), strip), least, keywords)


def without_repeats(kept: Column) -> Column:
    """Lines without those equal, once stripped, to the line before; blank ones stay."""
    fresh = lambda b: lambda x, i: (i == 0) | (F.get(b, i) == "") | (F.get(b, i) != F.get(b, i - 1))
    return let(kept, lambda k: let(F.transform(k, strip), lambda b: F.filter(k, fresh(b))))


def clean_parts(docs: DataFrame, text: str = "text", extra: tuple[str, ...] = (), least: int = 3, keywords: tuple[str, ...] | None = HEADER_KEYWORDS) -> DataFrame:
    """docs with n_lines, n_noise (noise and running headers), n_repeats and clean (the cleaned text).

    Lines are stripped once. Those kept have three characters or more, so squeezing them is a matter of
    the blanks within them.
    """
    bare = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), strip)
    kept = let(_headers(F.col("__bare"), least, keywords), lambda h: F.filter("__bare", lambda x: ~bare_is_noise(x, extra) & ~F.array_contains(h, x)))
    fresh = F.filter("__kept", lambda x, i: (i == 0) | (x != F.get("__kept", i - 1)))
    squeezed = F.transform("__clean", lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x))
    out = docs.withColumn("__bare", bare).withColumn("__kept", kept).withColumn("__clean", fresh)
    parts = out.select(
        *docs.columns,
        F.size("__bare").alias("n_lines"),
        (F.size("__bare") - F.size("__kept")).alias("n_noise"),
        (F.size("__kept") - F.size("__clean")).alias("n_repeats"),
        F.array_join(squeezed, "\n").alias("clean"),
    )
    return parts.withColumn("clean", nfc("clean")).withColumn("clean", fix_mojibake("clean"))


def cleaning_report(parts: DataFrame) -> DataFrame:
    return parts.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("text").isNull()).alias("errors"),
        F.sum("n_noise").alias("noise_lines"),
        F.sum("n_repeats").alias("duplicate_lines"),
    )


def parse_header(text: str | Column) -> Column:
    """struct<metadata, body>: `key: value` lines between the first two rules; the last value of a key wins.

    Without a second rule the whole text is the body.
    """
    numbered = lambda r: F.filter(F.transform(r, lambda x, i: F.when(F.contains(x, F.lit("=" * 20)), i)), lambda i: i.isNotNull())
    value = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))

    def parts(rows: Column, rules: Column) -> Column:
        first, second = F.get(rules, F.lit(0)), F.get(rules, F.lit(1))
        block = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(rows, first + 2, F.coalesce(second - first - 1, F.size(rows))))
        pairs = F.filter(F.transform(F.filter(block, lambda x: F.contains(x, F.lit(":"))), value), lambda p: (p["key"] != "") & (p["value"] != ""))
        body = F.array_join(F.slice(rows, F.coalesce(second, F.lit(-1)) + 2, F.size(rows) + 1), "\n")
        return F.struct(last_wins(pairs).alias("metadata"), body.alias("body"))

    return let(F.split(col(text), "\n"), lambda rows: let(numbered(rows), lambda rules: parts(rows, rules)))


def essential(metadata: str | Column) -> Column:
    return F.map_filter(col(metadata), lambda k, v: k.isin(*ESSENTIAL))


def rebuild_document(metadata: str | Column, body: str | Column, source: str | Column) -> Column:
    """The clean document: title banner, essential metadata, content, footer with the source's name."""
    rule, thin = "=" * 80, "-" * 80
    kept = essential(metadata)
    info = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    head = F.when(F.size(col(metadata)) > 0, F.concat(F.lit(f"INFORMACIÓN DEL DOCUMENTO:\n{thin}\n"), F.when(F.size(kept) > 0, F.concat(info, F.lit("\n"))).otherwise(""), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit(f"{rule}\nDOCUMENTO LIMPIO Y NORMALIZADO\n{rule}\n\n"),
        head,
        F.lit(f"{rule}\nCONTENIDO:\n{rule}\n\n"),
        col(body),
        F.concat(F.lit(f"\n\n{rule}\nDocumento original: "), col(source), F.lit(f"\nProcesado y limpiado automáticamente\n{rule}")),
    )

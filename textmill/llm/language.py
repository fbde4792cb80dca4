"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies what a text, the declared markup language, the address and the
host say:

* text: a naive Bayes model over byte trigrams, fitted on a bounded sample of labelled documents
  (``PER_LANGUAGE`` rows of each language), tempered by the text's length;
* declared language, address suffix (the host's last label: .de, .fr) and path tag (a first path segment
  of two letters: /de/): P(value | language), from a grouped count over all rows of the values against
  the text's own posterior;
* host: a prior smoothed in a hierarchy, all rows -> domain -> host, from grouped sums of the text's
  posteriors over all rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.text import let
from textmill.llm.common import fresh, stage, worker_model

#: Labelled rows of each language that the text model is fitted on.
PER_LANGUAGE = 2_000
#: Trigrams are hashed to so many columns: the model has 4 bytes for each and language, 128 kB a language.
BUCKETS = 1 << 15
#: A text counts as so many independent trigrams at most.
TRIGRAMS = 60.0
#: Rows of prior knowledge that stand behind a domain and a host.
PRIOR_ROWS = 20.0
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def _trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the folded text: letters only, every other ASCII byte a blank."""
    b = _FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[(b[:-2] != 32) | (b[1:-1] != 32)]
    return ((code * np.uint32(2654435761)) >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64)


def visible_text(html) -> F.Column:
    """The text of a page: without scripts, styles, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*+>.*?</(?:script|style)\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*+>", " "), r"&[a-zA-Z0-9#]{1,10};", " ")


def fit_text_model(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods [BUCKETS, languages]) from labelled(text, lang).

    The sample takes per_language different texts of each language at most, by their hash, so its size is
    bounded and it is the same in every run; a repeated text counts once. Null or blank languages and null
    texts take no part. The driver sees one row of 4 * BUCKETS bytes for each language.
    """
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND trim(lang) <> ''")
    rows = rows.withColumn("h", F.xxhash64("text", "lang"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("c")).collect()  # a row for each language
    if not sizes:
        return ["und"], np.zeros((BUCKETS, 1), np.float32)
    size = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], r["c"])))
    drawn = rows.withColumn("c", F.try_element_at(size, F.col("lang"))).where(f"pmod(h, greatest(c, 1)) < {per_language * 5 // 4}")
    first = Window.partitionBy("lang").orderBy("h")
    chosen = drawn.dropDuplicates(["lang", "h"]).withColumn("place", F.row_number().over(first)).where(f"place <= {per_language}")

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if lang not in tables:
                    tables[lang] = np.zeros(BUCKETS, np.int64)
                tables[lang] += np.bincount(_trigrams(text.as_py()), minlength=BUCKETS)
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(t[at], pa.int64())], names=["lang", "g", "n"])

    def likelihoods(pdf):
        import pandas as pd

        t = np.full(BUCKETS, 0.5)
        t[pdf["g"].to_numpy()] += pdf["n"].to_numpy()
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "logs": [np.log(t / t.sum()).astype(np.float32).tobytes()]})

    counts = chosen.select("text", "lang").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    found = sorted(counts.groupBy("lang").applyInPandas(likelihoods, "lang string, logs binary").collect())
    if not found:
        return ["und"], np.zeros((BUCKETS, 1), np.float32)
    return [r["lang"] for r in found], np.stack([np.frombuffer(r["logs"], np.float32) for r in found], axis=1)


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows(key columns ..., text) with the text replaced by ev: log likelihoods, tempered; null without letters."""
    shared, mine = rows.sparkSession.sparkContext.broadcast(model), ("language", uuid.uuid4().hex)
    keys = [f for f in rows.schema.fields if f.name != "text"]
    out = T.StructType([*keys, T.StructField("ev", T.ArrayType(T.DoubleType()))])

    def run(batches):
        _, table = worker_model(mine, lambda: shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            ev = []
            for text in batch.column(at):
                g = _trigrams(text.as_py() or "")
                if len(g) == 0:
                    ev.append(None)
                    continue
                total = np.zeros(table.shape[1])
                for a in range(0, len(g), 1 << 16):
                    total += table[g[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64)
                ev.append((total * (min(len(g), TRIGRAMS) / len(g))).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keys), pa.array(ev, pa.list_(pa.float64()))], names=[*(f.name for f in keys), "ev"])

    return rows.select(*(f.name for f in keys), "text").mapInArrow(run, out)


def _softmax(x):
    powers = lambda a, top: F.transform(a, lambda v: F.exp(v - top))
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total))
    return let(x, lambda a: let(F.array_max(a), lambda top: let(powers(a, top), shares)))


def _sums(prefix: str, n: int):
    return [F.sum(F.col("own")[i]).alias(f"{prefix}{i}") for i in range(n)]


#: Columns whose values speak for languages.
VALUES = ("declared", "suffix", "path")


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """Adds lang, confidence and text_lang to evidence(ev, host, domain, ...) and those of VALUES it has.

    Null values and hosts say nothing; a row without letters rests on its other evidence.
    """
    n = len(languages)
    names = F.array(*map(F.lit, languages))
    flat = F.array(*[F.lit(0.0)] * n)
    rows = stage(evidence.withColumn("own", _softmax(F.coalesce("ev", flat))), "evidence")
    heard = rows.where("ev IS NOT NULL")
    total = heard.agg(*_sums("t", n))
    everywhere = [F.coalesce(F.col(f"t{i}"), F.lit(0.0)) + 1.0 for i in range(n)]
    share = [e / sum(everywhere) for e in everywhere]
    everyone = total.select(F.array(*share).alias("p_all"))  # one row

    def declared(col: str) -> DataFrame:
        """log P(value | language) for each value of col, smoothed."""
        counts = heard.where(F.col(col).isNotNull()).groupBy(col).agg(*_sums("d", n))
        sums = counts.agg(*(F.sum(f"d{i}").alias(f"s{i}") for i in range(n)), F.count("*").alias("values"))
        logs = [F.log((F.col(f"d{i}") + 0.5) / (F.col(f"s{i}") + 0.5 * (F.col("values") + 1))) for i in range(n)]
        return counts.join(F.broadcast(sums)).select(F.col(col), F.array(*logs).alias(f"log_{col}"))  # sums is one row

    hosts = heard.where("host IS NOT NULL").groupBy("domain", "host").agg(*_sums("h", n), F.count("*").alias("c"))
    hosts = stage(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(*(F.sum(f"h{i}").alias(f"m{i}") for i in range(n)), F.sum("c").alias("mc"))
    domains = domains.join(F.broadcast(everyone))
    domains = domains.select("domain", F.array(*((F.col(f"m{i}") + PRIOR_ROWS * F.col("p_all")[i]) / (F.col("mc") + PRIOR_ROWS) for i in range(n))).alias("p_domain"))
    smooth = [(F.col(f"h{i}") + PRIOR_ROWS * F.col("p_domain")[i]) / (F.col("c") + PRIOR_ROWS) for i in range(n)]
    domains = domains.withColumnRenamed("domain", "__d")
    priors = hosts.join(domains, F.col("domain").eqNullSafe(F.col("__d")))
    by_host = stage(priors.select(F.col("host").alias("__h"), "__d", F.array(*smooth).alias("p_host")), "priors")
    out = rows.join(by_host, (F.col("host") == F.col("__h")) & F.col("domain").eqNullSafe(F.col("__d")), "left").drop("__h", "__d")
    values = [c for c in VALUES if c in rows.columns]
    for col in values:
        says = declared(col).toDF(f"__{col}", f"log_{col}")
        out = out.join(says, F.col(col) == F.col(f"__{col}"), "left")
    out = out.join(F.broadcast(everyone))
    terms = [
        sum((F.coalesce(F.col(f"log_{c}")[i], F.lit(0.0)) for c in values), F.coalesce("ev", flat)[i]) + F.log(F.coalesce(F.col("p_host"), F.col("p_all"))[i])
        for i in range(n)
    ]
    out = out.withColumn("post", _softmax(F.array(*terms)))
    best = F.array_max("post")
    return (
        out.withColumn("lang_id", F.element_at(names, F.array_position("post", best).cast("int")))
        .withColumn("confidence", best)
        .withColumn("text_lang", F.when(F.col("ev").isNotNull(), F.element_at(names, F.array_position("own", F.array_max("own")).cast("int"))))
    )


def _tag(col):
    """The primary part of a language tag, lower-case; null if it is none."""
    tag = F.lower(F.regexp_extract(col, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(tag != "", tag)


def identify_pages(pages: DataFrame, labelled: DataFrame, least: float = 0.5) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, suffix, path, host, accepted) for every row of pages(page_id, url, html).

    accepted: the text has letters and the posterior is at least `least`. Null urls and pages are
    rows with less evidence; with none at all lang follows the prior and accepted is false. Without
    labelled rows every page is "und". Repeated rows are answered each; equal posteriors go by the name.
    """
    model = fit_text_model(labelled)
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2,})\.?$", 1)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        _tag(F.regexp_extract(F.col("html"), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3}(?:[-_][A-Za-z0-9]+)?)", 1)).alias("declared"),
        F.when(suffix != "", suffix).alias("suffix"),
        _tag(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)).alias("path"),
        F.when(host != "", host).alias("host"),
        F.when(host != "", F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]+)$", 0)).alias("domain"),
        visible_text(F.col("html").cast("string")).alias("text"),
    )
    out = fuse(text_evidence(rows, model), model[0])
    accepted = F.col("ev").isNotNull() & (F.col("confidence") >= least)
    return out.select("page_id", F.col("lang_id").alias("lang"), F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "suffix", "path", "host", accepted.alias("accepted"))


def identify_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language is rejected; all columns stay as they are.

    Evidence is the text and the source as host. lang only labels the text model's sample: a row's own
    label is no evidence for it, as it would confirm itself. A row goes if its text has no letters or no
    language reaches a posterior of `least`. Null texts go; a null source only says nothing.
    """
    row, digest = fresh(docs, "lost_id"), fresh(docs, "lost_hash")
    model = fit_text_model(docs)
    rows = docs.select(
        F.col("doc_id").alias(row),
        F.xxhash64(F.col("text").cast("string")).alias(digest),
        F.col("source").cast("string").alias("host"),
        F.lit(None).cast("string").alias("domain"),
        F.col("text").cast("string").alias("text"),
    )
    evidence = text_evidence(rows, model)
    out = fuse(evidence, model[0])
    lost = out.where((F.col("ev").isNull()) | (F.col("confidence") < least)).select(row, digest).distinct()
    on = docs["doc_id"].eqNullSafe(lost[row]) & (F.xxhash64(docs["text"].cast("string")) == lost[digest])
    return docs.join(lost, on, "left_anti")

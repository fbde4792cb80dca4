"""Partitions without words, control characters, thousands of matches in one text, columns with the helpers' names."""

import hashlib
import random
import time

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.test_operators import DOC, base_spans, prose  # noqa: E402


def dealt(spark, rows, schema, n):
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, n), schema)


@pytest.mark.parametrize("texts", [[None, "", " \t\n"], ["", "one two three four five six", None, "\v"], [None], ["a b c d e f"], []])
def test_ngram_join_with_partitions_without_words(spark, texts):
    from textmill.llm.ngram_join import keep_one, ngram_join

    docs = dealt(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC, max(1, len(texts)))
    got = ngram_join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, max(0, len((t or "").split()) - 4), i) for i, t in enumerate(texts)]
    assert keep_one(docs).count() == len(texts)


def test_token_files_with_control_characters(spark):
    from tokenizers import Tokenizer

    from textmill.llm.token_files import ByteBpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, library = ByteBpe(path), Tokenizer.from_file(path)
    random.seed(8)
    signs = [chr(c) for c in range(33)] + ["\x7f", "\x85", "\xa0", "\xad", "​", "﻿", "'s", "'", "a", "b c", " the", "é", "日", "1", "!", "<|endoftext|>"]
    texts = ["a \0b", "\0", " \0", "\0 a", "a\0 b", "a\n\0b"] + [f"a {chr(c)}b {chr(c)} {chr(c)}{chr(c)}c" for c in range(33)]
    texts += ["".join(random.choice(signs) for _ in range(random.randint(1, 12))) for _ in range(20_000)]
    end = coder.bytes([0])
    for at in range(0, len(texts), 512):
        some = texts[at : at + 512]
        for t, got in zip(some, coder.encode(some, end)):
            assert got == coder.bytes(library.encode(t, add_special_tokens=False).ids) + end, repr(t)


def test_pii_with_very_many_matches_in_one_text(spark):
    from textmill.llm.pii import find_pii

    random.seed(9)
    say = lambda: random.choice([f"{random.randint(0, 10**9)}", f"1.2.{random.randint(0, 400)}.4", f"+1 (743) 555-{random.randint(1000, 9999)}", "4111 1111 1111 1111", f"a{random.randint(0, 99)}@b.org", "555 010 7777", "x (at) y.org"])
    texts = ["; ".join(say() for _ in range(n)) for n in (1, 3, 63, 64, 65, 129, 5_000)] + [" x ".join(str(random.randint(0, 10**15)) for _ in range(60_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    assert time.time() - began < 90
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        found = got[i].spans.split(",") if got[i].spans else []
        assert set(want) <= set(found)
        base = [tuple(map(int, s.split(":")[1:])) for s in want]
        for s in set(found) - set(want):  # what the patterns add overlaps no base span
            a, b = map(int, s.split(":")[1:])
            assert not any(a < y and x < b for x, y in base)


def test_running_sums_and_maxima(spark):
    from pyspark.sql import functions as F

    from textmill.llm.pii import running

    random.seed(1)
    rows = [([random.randint(-5, 9) for _ in range(n)],) for n in (0, 1, 2, 63, 64, 65, 128, 129, 4096, 4097, 20_000)]
    got = spark.createDataFrame(rows, "x array<long>").select("x", running(F.col("x")).alias("s"), running(F.col("x"), F.greatest).alias("m")).collect()
    for r in got:
        s, m = [], []
        for v in r.x:
            s.append(v + (s[-1] if s else 0))
            m.append(max(v, m[-1]) if m else v)
        assert (r.s, r.m) == (s, m)


RESERVED = ["file", "row", "own_file", "own_row", "times", "copy", "lost_id", "lost_hash", "lost_file", "lost_row", "__id", "__hash", "__file", "__row", "h", "toxic", "size", "bucket", "whole", "rest", "Shard"]


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline
    from textmill.llm.toxicity import score_toxicity

    random.seed(4)
    rows = [(i, prose(30), "en", f"s{i % 3}", 5, *[f"{c}{i}" for c in RESERVED]) for i in range(30)]
    rows += [(40 + i, rows[i][1], "en", "s1", 5, *["v"] * len(RESERVED)) for i in range(5)]
    docs = spark.createDataFrame(rows, DOC + "".join(f", `{c}` string" for c in RESERVED))
    whole = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, None)
        assert got.columns == docs.columns, name
        found = [tuple(r) for r in got.collect()]
        assert found and set(found) <= whole, name
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert score_toxicity(docs, labels).count() == len(rows)

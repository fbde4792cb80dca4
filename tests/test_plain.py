"""Queries that SQL can't express, against plain versions and properties."""

import random
import re

import numpy as np
import xxhash

from __spark_entry__ import queries
from textmill.operators import chunk, retrieve

SF = "/root/testdata/sf0.001"


def plain_vector(text, dim=64):
    v = np.zeros(dim)
    for w in text.lower().split():
        h = xxhash.xxh64_intdigest(w, 7)
        v[h % dim] += 1.0 if h >= 1 << 63 else -1.0
    n = np.sqrt((v * v).sum())
    return v / n if n else None


def test_hashed_embeddings(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.embedding for r in queries()["hashed_embeddings"](spark, SF).collect()}
    want = {i: v for i, t in texts.items() if len(t.encode()) <= 35_000 and (v := plain_vector(t)) is not None}
    assert set(got) == set(want)
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def test_long_texts_get_vectors_too(spark, tmp_path):
    long = "".join(f"Wort{i} ÁΣ{i}Σ{blank}" for i in range(12_000) for blank in " \n\u2003")
    texts = {1: "a b c", 2: "ab " * 11_666 + "cd", 3: "ab " * 11_667, 4: long, 5: "x" * 600_000 + " y z z", 6: None, 7: " \n", 8: " " * 600_000 + "end"}
    assert [len(texts[i].encode()) for i in (2, 3)] == [35_000, 35_001] and len(long) > 600_000
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.embedding for r in queries()["hashed_embeddings"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 8]
    assert all(np.allclose(got[i], plain_vector(texts[i]), atol=1e-6) for i in got)


def test_words_of_slices_are_the_text_s(monkeypatch):
    random.seed(4)
    blanks = [c for c in map(chr, range(0x110000)) if c.isspace()]
    for _ in range(2_000):
        monkeypatch.setattr(retrieve, "SLICE", random.randint(1, 9))
        text = "".join(random.choice([random.choice(blanks), *"aΣİßA.\u0301"]) for _ in range(random.randint(0, 40)))
        assert [w for words in retrieve._words(text) for w in words] == text.lower().split()


def test_doc_search(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    chunks = [c for r in texts for s in range(0, len(r.text), 800) if len(c := r.text[s : s + 1000]) >= 50]
    x = np.array([v for c in chunks if (v := plain_vector(c)) is not None], np.float32).astype(float)
    got = {}
    for r in queries()["doc_search"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.distance
    for q in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        v = plain_vector(q.text).astype(np.float32).astype(float)
        near = np.sort(((x - v) ** 2).sum(axis=1))[:5]
        assert np.allclose([got[q.item_id][k] for k in range(1, 6)], near, atol=2e-6)


def random_text(n):
    """Words that occur once, so a chunk has one place."""
    return "".join(random.choice([f"w{i}_ ", f"é{i}_ ", f"d{i}_. ", "\n", "\n\n", " ", f"{'x' * 9}{i}_ "]) for i in range(n))


def covers(parts, text):
    """The chunks come in order, and together hold every character that is no blank."""
    at = done = 0
    for p in parts:
        at = text.find(p, at)
        if at < 0 or text[done:at].strip():
            return False
        done = max(done, at + len(p))
    return not text[done:].strip()


def test_recursive_chunks_have_the_splitter_s_properties():
    random.seed(6)
    for _ in range(400):
        text, (size, overlap) = random_text(random.randint(0, 150)), random.choice([(20, 5), (40, 0), (33, 32)])
        parts = chunk.recursive_split(text, size, overlap)
        assert all(0 < len(p) <= size and p == p.strip() for p in parts)
        assert covers(parts, text)
        if overlap == 0:
            assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)


def test_semantic_chunks_have_the_packer_s_properties():
    random.seed(7)
    for _ in range(400):
        text, (size, overlap) = random_text(random.randint(1, 150)), random.choice([(40, 8), (60, 20), (30, 0)])
        parts = chunk.semantic_split(text, size, overlap)
        assert all(len(p) <= size + chunk.SLACK for p in parts)
        if overlap == 0 and ". " not in text and all(len(p) <= size + chunk.SLACK for p in text.split("\n\n")):
            assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
        if len(text) <= size:
            assert parts == [text]

"""Exact deduplication of a corpus that arrives in parts, against plain Python."""

import hashlib

import pytest

SCHEMA = "doc_id long, text string, file string, _metadata string"


def arrive(spark, tmp_path, name, rows):
    path = f"file://{tmp_path}/tables/{name} x"
    spark.createDataFrame([(i, t, "f", "m") for i, t in rows], SCHEMA).repartition(2).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def brute(seen, rows):
    """{(doc_id, text): (keep_id, group_size)} of rows, given all rows that have arrived."""
    out = {}
    for i, t in rows:
        group = [j for j, u in seen if (u or "") == (t or "")]
        out[i, t or ""] = (max(group), len(group))
    return out


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_arrivals_against_brute_force(spark, tmp_path):
    from textmill.llm.stream_dedup import dedup_arrivals, kept_rows

    memory, seen = f"file://{tmp_path}/memory", []
    arrivals = {
        "a": [(1, "x"), (2, "y"), (3, "x"), (4, None), (5, "")],
        "b": [(6, "y"), (7, "z"), (0, "x"), (8, "long " * 20_000)],
        "none": [],
        "c": [(9, "long " * 20_000), (10, "long " * 20_000), (11, "new"), (12, "")],
    }
    assert kept_rows(spark, memory).count() == 0
    tables = {}
    for name, rows in arrivals.items():
        tables[name] = arrive(spark, tmp_path, name, rows)
        seen += rows
        got = dedup_arrivals(tables[name], memory, name, files=1).collect()
        want = brute(seen, rows)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.kept) for r in got) == sorted(
            (i, *want[i, t or ""], sha(t), i == want[i, t or ""][0]) for i, t in rows
        )
    last = {(sha(t), max(j for j, u in seen if (u or "") == (t or "")), sum((u or "") == (t or "") for _, u in seen)) for _, t in seen}
    kept = kept_rows(spark, memory)
    assert {(r.text_sha256, r.doc_id, r.group_size) for r in kept.collect()} == last
    assert kept.count() == len(last)
    # the same arrival again counts nothing twice and sees what came later
    again = {r.doc_id: (r.keep_id, r.group_size) for r in dedup_arrivals(tables["a"], memory, "a").collect()}
    assert again == {i: brute(seen, [(i, t)])[i, t or ""] for i, t in arrivals["a"]}
    assert {(r.text_sha256, r.doc_id, r.group_size) for r in kept_rows(spark, memory).collect()} == last


def test_an_arrival_that_was_cut_short_is_made_again(spark, tmp_path, monkeypatch):
    from textmill.llm import stream_dedup as sd

    memory, rows = f"file://{tmp_path}/memory", [(1, "x"), (2, "x"), (3, "y")]
    docs, whole = arrive(spark, tmp_path, "a", rows), sd.latest
    monkeypatch.setattr(sd, "latest", lambda *args: 1 / 0)  # after the stream has run
    with pytest.raises(ZeroDivisionError):
        sd.dedup_arrivals(docs, memory, "a")
    monkeypatch.setattr(sd, "latest", whole)
    got = sd.dedup_arrivals(docs, memory, "a").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
    with pytest.raises(ValueError, match="name"):
        sd.dedup_arrivals(docs, memory, "a/b")


def test_copies_in_many_pieces_and_texts_that_differ(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from textmill.llm import stream_dedup as sd

    monkeypatch.setattr(sd, "PIECE", 3)
    memory = f"file://{tmp_path}/memory"
    got = sd.dedup_arrivals(arrive(spark, tmp_path, "a", [(i, "same") for i in range(20)]), memory, "a").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(19, 20)} and sum(r.kept for r in got) == 1
    sd.dedup_arrivals(arrive(spark, tmp_path, "b", [(30, "same")]), memory, "b")
    monkeypatch.setattr(sd.F, "sha2", lambda c, n: F.lit("one digest for all"))
    other = arrive(spark, tmp_path, "c", [(40, "this"), (41, "that")])
    with pytest.raises(ValueError, match="share"):
        sd.dedup_arrivals(other, f"file://{tmp_path}/other", "c")

"""What only shows on large tables, at a small size."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa

from textmill.functions import batches
from textmill.operators import chunk, html, markup
from textmill.operators import retrieve as rt
from textmill.plans import corpus
from textmill.queries import QUERIES
from textmill.sources import tables as io


def test_scoreboard_holds_sums_beyond_an_int(spark, tmp_path):
    rows = [(i, 2_000_000_000 + 12 * i, "click") for i in range(3)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["scoreboard_round_trip"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("click", "2", "0", 3, 0, 6_000_000_036, 0)]


SCORES = "mode string, rivals string, difficulty string, player_wins long, ai_wins long, player_score long, ai_score long"


def written(path):
    """The JSON documents of a scoreboard on disk."""
    texts = "\x1e".join(f.read_text() for f in sorted(Path(path).glob("part-*"))).split("\x1e")
    return [json.loads(x) for x in texts if x]


def test_scoreboard_of_many_modes_is_written_in_parts(spark, tmp_path):
    rows = [(f"m\x1e{i % 4_001}", str(i % 3), str(i % 5), i, 0, i * 10**12, 1) for i in range(4_001)]
    rows += [("hot", str(i), None, i, 0, -i, 1) for i in range(2_000)]
    io.write_scoreboard(spark.createDataFrame(rows, SCORES), f"{tmp_path}/s")
    sizes = [sum(len(d) for r in doc.values() for d in r.values()) for doc in written(f"{tmp_path}/s")]
    assert sum(sizes) == len(rows) and len(sizes) == 7 and max(sizes) < 1_300
    assert sorted(map(tuple, io.read_scoreboard(spark, f"{tmp_path}/s").collect()), key=str) == sorted(rows, key=str)


def test_few_scores_are_one_json_document(spark, tmp_path):
    io.write_scoreboard(spark.createDataFrame([(f"m{i}", "1", "EASY", i, 0, 1, 1) for i in range(1_000)], SCORES).repartition(4), f"{tmp_path}/s")
    io.write_scoreboard(spark.createDataFrame([], SCORES), f"{tmp_path}/none")
    assert [len(d) for d in written(f"{tmp_path}/s")] == [1_000] and written(f"{tmp_path}/none") == [{}]
    assert io.read_scoreboard(spark, f"{tmp_path}/none").collect() == []
    (tmp_path / "own").write_text(json.dumps({"A": {"1": {"EASY": {"player_wins": 1, "ai_wins": 2, "player_score": 3, "ai_score": 4}}}}, indent=4))
    assert [tuple(r) for r in io.read_scoreboard(spark, f"{tmp_path}/own").collect()] == [("A", "1", "EASY", 1, 2, 3, 4)]


def test_scoreboard_keeps_keys_too_long_for_a_name(spark, tmp_path):
    long = ["k" * 60_000, "\\L" + "é\n" * 40_000, "\\L" + "0" * 64, "x" * 10_001, "\U0001f600" * 10_000]
    rows = [(a, b, c, 1, 0, 5, 0) for a, b, c in zip(long, [None, *long], ["d", None, *long])] + [(None, "1", "EASY", 1, 0, 5, 0)]
    io.write_scoreboard(spark.createDataFrame(rows, SCORES), f"{tmp_path}/s")
    assert sorted(map(tuple, io.read_scoreboard(spark, f"{tmp_path}/s").collect()), key=str) == sorted(rows, key=str)


class Frame:
    """Stands in for a table and keeps the function that is mapped over its batches."""

    schema = {"doc_id": type("", (), {"dataType": type("", (), {"simpleString": staticmethod(lambda: "bigint")})})}

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def parts_of(frame, **columns):
    """What a task hands back for one batch, each piece of it small."""
    batch = pa.RecordBatch.from_pydict(columns)
    out = list(frame.run(iter([batch])))
    assert len(out) > 3 and all(b.num_rows <= batches.ROWS and b.nbytes <= 2 * batches.PIECE for b in out)
    return [tuple(r.values()) for b in out for r in b.to_pylist()]


PAGE = "<article>" + "<li>some words</li>" * 200 + "</article>"


def test_blocks_come_in_pieces():
    got = parts_of(html.page_blocks(Frame()), page_id=list(range(2_000)), html=[PAGE] * 1_999 + [None])
    text = " ".join(["some words"] * 200)
    assert got == [x for i in range(1_999) for x in ((i, 0, "article", text), (i, 1, "li", "some words"))]


def test_contents_come_in_pieces(spark):
    got = parts_of(corpus.page_contents(Frame()), page_id=list(range(5_000)), url=["u"] * 5_000, title=[None] * 5_000, html=[PAGE] * 4_999 + [None])
    assert len(got) == 5_000 and got[0][1:3] == ("u", None) and got[0][3].endswith("some words\n\nsome words") and got[-1] == (4_999, "u", None, "")


def test_chunks_come_in_pieces():
    got = parts_of(chunk.semantic_chunks(Frame()), doc_id=pa.array([*range(2_999), None], pa.int64()), text=["a word. " * 1_000] * 2_998 + [None, ""])
    want = [(i, len(parts)) for parts in [chunk.semantic_split("a word. " * 1_000)] for i in range(len(parts))]
    assert [r[1:3] for r in got if r[0] == 2_997] == want and {r[0] for r in got} == set(range(2_998))


def test_column_functions_work_in_pieces(spark, monkeypatch):
    made = []
    monkeypatch.setattr(markup, "udf", lambda make, kind="string": lambda *columns: made.append(batches.udf(make, kind).func))
    markup.without_tags(None, ("nav",))
    markup.area_of(None, None, "main")
    page = "<nav>x</nav><article>" + "y" * 3_000 + "</article>"
    pages = pa.array([page] * 4_000 + [None], pa.string())
    for run, batch, want in ((made[0], pages, page[12:]), (made[1], (pages, pa.array([False] * 4_001)), "y" * 3_000)):
        out = list(run(iter([batch])))
        assert all(len(x) <= batches.ROWS and x.nbytes <= 2 * batches.PIECE for x in out)
        assert [v for x in out for v in x.to_pylist()] == [want] * 4_000 + [None]


def test_models_get_pieces_once(spark):
    docs = spark.range(0, 5_000, 1, 1).selectExpr("id", "if(id = 7, NULL, repeat('x', 1000)) AS text")
    made = rt.drop_failed(rt.embed(docs, model=lambda texts: [np.array([len(texts), t is None]) if i % 2 else np.empty(0) for i, t in enumerate(texts)]))
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = made.collect()
    assert len(rows) == 2_500 and max(r.embedding[0] for r in rows) <= batches.ROWS
    assert [r.embedding[1] for r in rows if r.id == 7] == [1.0]


def test_search_makes_vectors_once(spark, tmp_path):
    def model(texts):
        (tmp_path / uuid.uuid4().hex).write_text(str(len(texts)))
        return [np.array([float(t), 1.0]) for t in texts]

    index = rt.drop_failed(rt.embed(spark.range(0, 600, 1, 3).selectExpr("id AS chunk_id", "string(id) AS text"), model=model))
    questions = spark.createDataFrame([(1, [300.25, 1.0]), (2, [0.0, 1.0])], "query_id int, query array<double>")
    got = {(r.query_id, r.rank): (r.chunk_id, r.distance) for r in rt.top_k(index.select("chunk_id", "embedding"), questions, 2).collect()}
    assert got == {(1, 1): (300, 0.0625), (1, 2): (301, 0.5625), (2, 1): (0, 0.0), (2, 2): (1, 1.0)}
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 600

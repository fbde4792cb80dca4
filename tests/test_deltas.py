"""Tables that grow by deltas: replays, compaction, filters, the crawl and the log tail on them."""

import os
import random

from pyspark.sql import functions as F

from textmill.operators import html as h
from textmill.sources import deltas as d
from textmill.sources import tables as io
from textmill.streaming import monitor as m


def test_deltas_replay_and_compact(spark, tmp_path):
    folder, schema = f"{tmp_path}/t", "k string, n long"
    want = {}
    assert d.read_deltas(spark, folder, schema).count() == 0 and d.compact(spark, folder, schema, ["k"]) == []
    for batch in range(4):
        rows = [(f"k{i}", 10 * batch + i) for i in range(batch, 12 + batch)] + ([(None, batch)] if batch < 2 else [])
        for _ in range(2):  # the second run replaces the first
            d.write_delta(spark.createDataFrame(rows, schema), folder, ["k"], batch)
        want |= dict(rows)
        if batch == 1:
            assert d.compact(spark, folder, schema, ["k"])
        assert {r.k: r.n for r in d.latest(d.read_deltas(spark, folder, schema), ["k"]).collect()} == want
    again = d.compact(spark, folder, schema, ["k"])
    assert d.compact(spark, folder, schema, ["k"]) == [] and again
    table = d.read_deltas(spark, folder, schema)
    assert {(r.k, r.n) for r in table.collect()} == set(want.items()) and table.count() == len(want)
    assert table.where("d_level = 0").count() == 0
    one = d.touched(spark.createDataFrame([("k3", 0)], schema), ["k"])
    assert len(one) == 1 and d.read_deltas(spark, folder, schema, one).where("k = 'k3'").count() == 1


def test_filters_hold_every_key_and_few_others(spark, tmp_path):
    index, schema = f"{tmp_path}/i", "k string, v int"
    for batch in range(3):
        d.add_rows(spark.createDataFrame([(f"in{i}", i) for i in range(batch * 700, (batch + 1) * 700)] + [(None, 1)], schema), index, "k", batch)
    asked = spark.createDataFrame([(f"in{i}",) for i in range(2100)] + [(f"out{i}",) for i in range(4000)] + [(None,), (None,), ("out1",)], "k string")
    maybe = {r.k for r in d.maybe_in(asked, f"{index}/filters", "k").collect()}
    assert {f"in{i}" for i in range(2100)} <= maybe
    assert len(maybe) - 2100 < 0.08 * 4000  # three filters of one in a hundred each
    missing = [r.k for r in d.missing_keys(asked, index, schema, "k").collect()]
    assert sorted(map(str, missing)) == sorted([f"out{i}" for i in range(4000)] + ["None", "None", "out1"])
    assert d.missing_keys(asked, f"{tmp_path}/none", schema, "k").count() == asked.count()
    assert d.missing_keys(asked.limit(0), index, schema, "k").count() == 0


def test_cached_index_makes_each_vector_once(spark, tmp_path):
    made = []

    def make(chunks):
        made.append(sorted(r.chunk_id for r in chunks.collect()))
        return chunks.withColumn("embedding", F.array(F.lit(1.0)))

    chunks = lambda ids: spark.createDataFrame([(i, i) for i in ids], "chunk_id string, text string")
    assert io.cached_index(chunks("aab"), f"{tmp_path}/x", make, 0).count() == 2
    assert io.cached_index(chunks("abc"), f"{tmp_path}/x", make, 1).count() == 3
    assert io.cached_index(chunks("abc"), f"{tmp_path}/x", make, 2).count() == 3
    assert made == [["a", "b"], ["c"], []]


def test_crawl_by_deltas_as_a_plain_walk(spark):
    random.seed(5)
    links = [(f"u{random.randrange(60)}", f"u{random.randrange(60)}", random.choice(["PDF", "HTML", "HTML"])) for _ in range(110)]
    seeds = [("u0", 0), ("u1", 1), ("u1", 0), ("gone", 0)]
    got = h.crawl_frontier(spark.createDataFrame(seeds, "url string, depth int"), spark.createDataFrame(links, "url string, target string, kind string"), 3).collect()
    want, queue = {}, list(seeds)
    while queue:
        u, depth = queue.pop()
        if depth >= want.get(u, 99):
            continue
        want[u] = depth
        if depth < 3:
            queue += [(t, depth + (k != "PDF")) for f, t, k in links if f == u]
    assert {r.url: r.depth for r in got} == want and len(got) == len(want)


def test_log_tail_writes_changed_counts_only(spark, tmp_path):
    logs, out = f"{tmp_path}/logs", f"{tmp_path}/counts"
    os.makedirs(logs)

    def arrive(name, rows):
        with open(f"{logs}/{name}.csv", "w") as f:
            f.write("k,x\n" + "".join(f"{k},{x}\n" for k, x in rows))

    def run():
        counts = m.log_tail(spark, logs, "k string, x int", ["k"])
        m.tail_counts(counts, ["k"], out, f"{tmp_path}/state", {"availableNow": True}).awaitTermination()
        return {r.k: r.n for r in m.read_counts(spark, out, counts.schema, ["k"]).collect()}

    arrive("a", [("a", 1), ("b", 1), ("b", 2)])
    assert run() == {"a": 1, "b": 2}
    arrive("b", [("b", 1), ("c", 1)])
    assert run() == {"a": 1, "b": 3, "c": 1}
    rows = d.read_deltas(spark, out, "k string, n long")
    assert {(r.d_batch, r.k, r.n) for r in rows.collect()} == {(0, "a", 1), (0, "b", 2), (1, "b", 3), (1, "c", 1)}
    d.compact(spark, out, "k string, n long", ["k"])
    assert run() == {"a": 1, "b": 3, "c": 1}

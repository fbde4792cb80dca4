"""Ledgers and neighbours by ranges: a hot account gives what a plain loop gives."""

import random

import numpy as np
import pytest

from textmill.operators import ledger, stats


def moves(n_hot, seed=3):
    rng = random.Random(seed)
    rows = [("hot", i, float(rng.choice([5, 7, 20, -9, -14, -31, 0, -300]))) for i in range(n_hot)]
    rows += [(f"a{rng.randrange(40):02d}", i, rng.choice([1.25, 3.5, -2.75, -0.05, 0.1])) for i in range(n_hot // 4)]
    rows += [("none", 1, None), ("none", 2, 5.0), ("zz", 1, -1.0), (None, 1, 4.0)]
    rng.shuffle(rows)
    return rows


def plain_guarded(rows, opening):
    out, balance = [], {}
    for k, i, x in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2]):
        b = balance.get(k, round(100 * opening))
        u = None if x is None else round(100 * x)
        ok = u is not None and (u > 0 or (u < 0 and -u <= b))
        balance[k] = b = b + (u if ok else 0)
        out.append((k, i, x, ok, b / 100))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "parts", "opening"), [(20_000, 16, 50.0), (300, 40, 0.0), (3, 4, 1.0)])
def test_guarded_ledger_of_a_hot_account(spark, n, parts, opening):
    rows = moves(n)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = stats.ledger_guarded(spark.createDataFrame(rows, "place string, part int, kind double"), "place", ["part"], "kind", opening)
        assert got.columns == ["place", "part", "kind", "accepted", "balance"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_guarded(rows, opening)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stats.ledger_guarded(spark.createDataFrame([], "a int, i int, x double"), "a", ["i"], "x").count() == 0


def test_balance_map_is_the_plain_walk():
    rng = random.Random(1)
    for _ in range(60):
        steps = [rng.choice([rng.randint(-40, 40), -100, 0]) for _ in range(rng.randint(0, 60))]
        m = ledger.BalanceMap()
        for s in steps:
            m.move(s)
        starts, offsets = map(np.array, m.table())
        for opening in range(-5, 200):
            b = opening
            for s in steps:
                b = ledger.decide(b, s)[1]
            assert ledger.closing(opening, starts, offsets) == b


def test_segments_are_cut_by_moves_and_pieces(monkeypatch):
    """Small segments of one account, decided by way of the chain."""
    import pyarrow as pa

    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 5})()))
    monkeypatch.setattr(ledger, "MOVES", 11)
    monkeypatch.setattr(ledger, "PIECES", 6)
    rng = random.Random(2)
    units = [rng.randint(-60, 50) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * 200), pa.array(range(200)), pa.array(units), pa.array(units, pa.int64())], names=["a", "i", "x", "__units"])
    out = [r for b in ledger._first_pass(3, 70)([batch]) for r in b.to_pylist()]
    notes = sorted((r for r in out if r["kind"] == 1), key=lambda r: r["segment"])
    assert len(notes) > 18 and all(len(r["starts"]) <= 13 for r in notes)
    chain = pa.RecordBatch.from_pylist([{k: r[k] for k in ("a", "segment", "balance", "starts", "offsets", "part")} for r in notes], pa.schema([("a", pa.string()), ("segment", pa.int32()), ("balance", pa.int64()), ("starts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("part", pa.int64())]))
    found = {r["segment"]: r["opening"] for b in ledger._chain(70)([chain]) for r in b.to_pylist()}
    b = 70
    for r, u in zip((r for r in out if r["kind"] == 0), units):
        if r["place"] == 0:
            assert found[r["segment"]] == b
        b = ledger.decide(b, u)[1]


@pytest.mark.parametrize("parts", [1, 24])
def test_running_ledgers_and_neighbours_of_a_hot_group(spark, parts):
    rng = random.Random(7)
    rows = [("hot", i, rng.choice([3, -5, 8, -2, 0])) for i in range(5_000)] + [(f"g{i % 9}", i, rng.randint(-9, 9)) for i in range(200)] + [(None, i, 1) for i in range(5)] + [("gap", 1, None), ("gap", 2, 4), ("one", 1, 4)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame(rows, "k string, i int, x int")
        total = {(r.k, r.i): r.total for r in stats.floored_total(df, "k", ["i"], "x").collect()}
        balance = {(r.k, r.i): r.balance for r in stats.ledger_balance(df, "k", ["i"], "x", 10.0).collect()}
        close = {r.k: (r.low, r.high, r.gap) for r in stats.closest_pair(df.selectExpr("k", "i * i * 7 % 100003 AS v"), "k", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    floor, run, want, plain = {}, {}, {}, {}
    for k, i, x in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        floor[k] = max(0, floor.get(k, 0) + (x or 0))
        want[k, i] = floor[k]
        if x:
            run[k] = run.get(k, 10.0) + x
            plain[k, i] = run[k]
    assert total == want and balance == plain
    for k in {r[0] for r in rows}:
        v = sorted(r[1] * r[1] * 7 % 100003 for r in rows if r[0] == k)
        assert close.get(k) == (min((b - a, a, b) for a, b in zip(v, v[1:]))[1:] + (min(b - a for a, b in zip(v, v[1:])),) if len(v) > 1 else None)

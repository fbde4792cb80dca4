"""Prefix trie, centroid clusters and shards against brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

TURN = "turn int, conv_id long, role string, text string, key string, depth int"
VEC = "vec_id long, embedding array<double>, label int, cluster string, x int"
DOC = "doc_id long, text string, shard string, slot int, size string"


# --- prefix trie ---------------------------------------------------------------------------------------


def words(text):
    return len([w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w])


def brute_trie(rows):
    own = {}
    for turn, conv, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - c % 20, [])[:h] + ts[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(1 for n in below if not any(m[:-1] == n for m in members if m))
        saved = sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c, e in who if e)))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in who), len(node), parent, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    random.seed(11)
    say = [f"say {'x ' * i}{i}" for i in range(5)]
    rows = []
    for c in [*range(70), -3, -20, 999, 1000]:
        for t in range(random.choice([0, 1, 2, 3, 5, 9])):
            rows.append((t, c, random.choice(["user", "assistant"]), random.choice(say), "k", 7))
    rows += [(t, 200 + c, "user", f"hot {t}", None, 0) for c in range(60) for t in range(4)]  # one conversation, many times
    rows += [(None, 300, None, None, None, None), (None, 300, None, "b", None, None), (0, 300, "", "", None, None), (0, 300, "user", "a\x85b c\td", None, None)]
    rows += [(1, None, "user", "no number", None, None), (0, 400, "user", "long " * 30_000, None, None), (0, 401, "ab", "c", None, None), (0, 402, "a", "bc", None, None)]
    rows += [(3, 403, "user", "tie", None, None), (3, 403, "user", "tie", None, None), (3, 403, "assistant", "other", None, None)]
    rows += [(t, 420, "user", f"deep {t}", None, None) for t in range(300)] + [(t, 421, "user", f"deep {t}", None, None) for t in range(290)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [20_000, 7, 1])
def test_turn_trie_against_brute_force(spark, monkeypatch, block):
    """Blocks of any size give the same trie; here they are made in the driver, as workers don't see the patch."""
    from textmill.llm import turn_trie as t

    rows = conversations()
    keyed = t.rebuilt(spark.createDataFrame(rows, TURN))
    if block == 20_000:
        got = t.trie_nodes(keyed)
    else:
        monkeypatch.setattr(t, "BLOCK", block)
        found = sorted((r.key, r.conv_id, r.words) for r in keyed.collect())
        made, place = [], 0
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([c for _, c, _ in found]), pa.array([bytes(k) for k, _, _ in found]), pa.array([w for *_, w in found])], names=["c", "k", "w"])
        for part in t._blocks([batch]):
            made += t._block_rows(*part, place)
            place += 2
        nodes = spark.createDataFrame([tuple(r) for r in made], t.NODE)
        monkeypatch.setattr(t, "stage", lambda df, name, f=t.stage: nodes if name == "trie" else f(df, name))
        got = t.trie_nodes(keyed)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_turn_trie_of_nothing(spark):
    from textmill.llm.turn_trie import turn_trie

    assert turn_trie(spark.createDataFrame([], TURN)).count() == 0
    only = turn_trie(spark.createDataFrame([(None, 7, None, None, None, None)], TURN)).collect()  # crc32("7") % 4 is not 0: no turn is left
    assert zlib.crc32(b"7") % 4 and [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in only] == [(7, 0, 1, 1, hashlib.sha256(b"7").hexdigest())]


def test_radix_layouts_grow_and_keep_their_children():
    from textmill.llm.radix import Full, Indexed, RadixTree, Small

    kinds = []
    for n in (4, 16, 48, 256):
        tree = RadixTree()
        for m, b in enumerate(random.Random(n).sample(range(256), n)):
            tree.insert(bytes([9, b, 1]), m)
        node = tree.root
        assert node.path == b"\x09" and len(list(node.children)) == n
        assert [c.path for c in node.children] == [b"\x01"] * n
        kinds.append((type(node.children), getattr(node.children, "most", None)))
    assert kinds == [(Small, 4), (Small, 16), (Indexed, None), (Full, None)]


def test_radix_tree_emits_whole_units_only():
    """Keys part inside a unit: no node there; a key may end where another goes on; keys repeat."""
    from textmill.llm.radix import RadixTree, unit_nodes

    keys = sorted([b"", b"aaaa", b"aaab", b"aaabcccc", b"aaabcccd", b"aaabcccd", b"abab", b"zzzzyyyyxxxx"])
    tree = RadixTree()
    for m, k in enumerate(keys):
        tree.insert(k, m)
    got = sorted((keys[n.low][: 4 * n.depth], n.high - n.low + 1, len(n.ends), n.kids, n.leaves, n.saved) for n, _ in unit_nodes(tree, 4, lambda m, d: 1, lambda low, high: False))
    prefixes = {k[: 4 * d] for k in keys for d in range(len(k) // 4 + 1)}
    want = []
    for p in prefixes:
        n = lambda q: sum(k.startswith(q) for k in keys)
        below = [q for q in prefixes if q.startswith(p)]
        kids = [q for q in below if len(q) == len(p) + 4]
        want.append((p, n(p), keys.count(p), len(kids), sum(not any(o != q and o.startswith(q) for o in prefixes) for q in below), sum(n(q) - 1 for q in below if q)))
    assert got == sorted(want)


# --- centroid clusters ---------------------------------------------------------------------------------


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    name = lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [x for _, x in sorted(kept, key=name)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        by = assign()
        for j in range(len(cents)):
            mine = [x for (_, x), (_, at) in zip(kept, by) if at == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    by = assign()
    total = {j: sum(d for d, at in by if at == j) for j in range(len(cents))}
    show = lambda v: -1 if v is None else v
    return sorted((show(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, by))


def vectors():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 64))
    rows = [(i, (middles[i % 6] + rng.normal(scale=0.4, size=64)).tolist(), i % 3, "c", 1) for i in range(180)]
    rows += [(200 + i, rows[4][1], 0, None, None) for i in range(60)] + [rows[7], rows[7], (None, rows[9][1], 1, None, None), (None, rows[10][1], 1, None, None)]
    rows += [(300, None, 0, None, None), (301, [1.0] * 63, 0, None, None), (302, [], 0, None, None), (303, [None] + [1.0] * 63, 0, None, None)]
    rows += [(304, [float("nan")] + [1.0] * 63, 0, None, None), (305, [float("-inf")] + [1.0] * 63, 0, None, None), (306, [0.0] * 64, None, None, None)]
    rows += [(400 + i, [float(i % 2)] * 64, None, None, None) for i in range(8)]
    return rows


@pytest.mark.parametrize("n", [None, 5, 1])
def test_clusters_against_brute_force(spark, n):
    from textmill.llm.clustering import centroid_clusters

    rows = vectors()[:n]
    got = centroid_clusters(spark.createDataFrame(rows, VEC).repartition(3)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows)
    assert all(1 <= r.n_compared <= 8 for r in got)
    if n is None:
        assert np.mean([r.n_compared for r in got]) < 4  # the bound rules most centroids out


def test_clusters_of_nothing_and_of_what_does_not_fit(spark):
    from textmill.llm.clustering import MOST, centroid_clusters

    assert centroid_clusters(spark.createDataFrame([], VEC)).count() == 0
    assert centroid_clusters(spark.createDataFrame([(1, None, 1, None, None)], VEC)).count() == 0
    edge = float(MOST // 1024)
    far = [(1, [edge] * 64, 1, None, None), (2, [-edge] * 64, 1, None, None)]
    got = {r.vec_id: (r.cluster, r.distance) for r in centroid_clusters(spark.createDataFrame(far, VEC)).collect()}
    assert sorted(got.values()) == [(0, 0), (1, 0)]
    with pytest.raises(Exception, match="beyond"):
        centroid_clusters(spark.createDataFrame([(1, [2 * edge] * 64, 1, None, None)], VEC)).count()


def test_bound_is_never_above_the_distance():
    from textmill.llm.clustering import nearest, rotate

    rng = np.random.default_rng(1)
    for size in (1, 1000, 1 << 27):
        x, c = (rng.integers(-size, size + 1, (n, 64)) for n in (500, 8))
        axes = np.linalg.qr(rng.normal(size=(64, 64)))[0][:, :16]
        mean = x.mean(axis=0)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        cluster, best, tried = nearest(x, rotate(x.astype(float), mean, axes), c, rotate(c.astype(float), mean, axes))
        assert (best == d.min(axis=1)).all() and (cluster == d.argmin(axis=1)).all()


# --- shards --------------------------------------------------------------------------------------------


def brute_jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def shard_rows():
    random.seed(2)
    rows = [(i, random.choice(["same", f"text {i}", "é日本", "x" * 50_000]), "s", 1, "z") for i in range(-20, 300)]
    return rows + [(None, None, None, None, None), (None, "no key", None, None, None), (5, "again", None, None, None), (7, None, None, None, None), (8, "", None, None, None)] + [(9, "many", "s", 1, "z")] * 200 + [(2**63 - 1, "a", "", 0, ""), (-(2**63), "b", "", 0, "")]


def test_shards_against_brute_force(spark):
    from textmill.llm.sharding import shard_documents

    rows = shard_rows()
    got = shard_documents(spark.createDataFrame(rows, DOC).repartition(5)).collect()
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        want.append((-1.5 if d is None else d, len(b) + 1, zlib.crc32(b), "key", brute_jump(d or 0, 8), brute_jump(d or 0, 9)))
    assert sorted((-1.5 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == sorted(want)
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in mine]
        assert order == sorted(order)
    assert shard_documents(spark.createDataFrame([], DOC)).count() == 0


def test_jump_moves_the_necessary_share():
    from textmill.llm.sharding import jump

    keys = np.arange(60_000, dtype=np.uint64)
    for n in (1, 2, 8, 100):
        a, b = jump(keys, n), jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((a != b).mean() - 1 / (n + 1)) < 0.01
        assert np.bincount(a, minlength=n).max() < 1.2 * len(keys) / n


def test_shard_folders_grow_by_the_new_shard_only(spark, tmp_path):
    from textmill.llm.sharding import append_shard, read_shards, write_shards

    docs = spark.createDataFrame(shard_rows(), DOC)
    folder = str(tmp_path / "shards")
    write_shards(docs, folder, 3)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").rglob("*.parquet")}
    for _ in range(2):  # a repeated run gives the same
        append_shard(spark, folder, 3)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    got = read_shards(spark, folder, 4)
    show = lambda rows: sorted(map(str, rows))
    assert show(tuple(r.row) for r in got.collect()) == show(shard_rows())
    assert all(r.shard == brute_jump(r.row.doc_id or 0, 4) for r in got.collect())
    write_shards(docs, folder + "-text", 4, key="text")
    by = {}
    for r in read_shards(spark, folder + "-text", 4, key="text").collect():
        by.setdefault(r.row.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())

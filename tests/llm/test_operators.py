"""The corpus operators against brute force, and their edge cases: nulls, empty and very long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(3)
VOCAB = [a + b for a in ("the", "or", "an", "ti", "re", "sh") for b in ("", "ing", "ea", "ed", "st", "on", "ble")]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def corpus():
    """Documents with copies, near copies, nulls, empties, a long one, repeated rows and odd text."""
    base = [prose(random.randint(1, 90)) for _ in range(40)]
    rows = [(i, t, random.choice(["en", "fr"]), f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    for i in range(12):
        words = base[5].split() + ["tail", "words"]
        words[i % 3] = f"edit{i}"
        rows.append((100 + i, " ".join(words), "en", "s0", 0))
    rows += [(200 + i, base[7], "en", "s0", 0) for i in range(9)]
    rows += [(300, None, None, None, None), (301, "", "en", None, 0), (302, "   \n\t", "fr", "s1", 0), (303, "one two", "en", "s1", 0), (304, "ONE\ntwo", "en", "s2", 0)]
    rows += [(None, base[9], "en", "s3", 0), (305, "é <|endoftext|> 日本  x  y", "en", "s3", 0), (306, prose(20_000), "en", "s0", 0)]
    rows += [rows[3], rows[3]]
    return rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows, percent=80):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingles(r[1]))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs")) + "/documents.parquet"
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_ngram_join_is_exact(spark, docs, rows):
    from textmill.llm.ngram_join import keep_one, ngram_join

    got = ngram_join(docs.withColumn("component_id", docs["lang"])).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    assert {(r.doc_id, r.n_shingles) for r in got} == {(r[0], len(shingles(r[1]))) for r in rows}
    kept = {r.doc_id for r in keep_one(docs).collect()}
    assert kept == set(want.values()) | {None}
    assert ngram_join(empty(spark)).count() == 0


def test_ngram_join_finds_chains_that_miss_the_first_leader(spark):
    """Near copies in a chain: neighbours link, the ends don't."""
    from textmill.llm.ngram_join import ngram_join

    words = [f"w{i}" for i in range(260)]
    chain = [(i, " ".join(words[i * 4 : i * 4 + 100]), "en", "s", 0) for i in range(40)]
    random.shuffle(chain)
    got = {r.doc_id: r.component_id for r in ngram_join(spark.createDataFrame(chain, DOC)).collect()}
    assert got == brute_components(chain)
    assert set(got.values()) == {0}


def test_ngram_join_with_lists_dealt_in_bands_and_cells(spark, monkeypatch):
    """Texts of many sizes that share passages, in cells of three: each linked pair must meet."""
    from textmill.llm import ngram_join as n

    monkeypatch.setattr(n, "CELL", 3)
    random.seed(17)
    common = [f"c{i}" for i in range(12)]
    base = [[f"b{k}x{i}" for i in range(60)] for k in range(4)]
    rows = []
    for i in range(160):
        k, size = random.randrange(4), random.choice([20, 24, 30, 37, 46, 58])
        at = random.randrange(0, 60 - size + 1, 2)
        words = base[k][at : at + size]
        if random.random() < 0.5:
            words = common[: random.randrange(5, 12)] + words
        rows.append((i, " ".join(words), "c", "s", 0))
    got = {r.doc_id: r.component_id for r in n.ngram_join(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_components(rows)
    assert len(set(got.values())) > 10


def test_ngram_join_tells_rows_of_one_id_apart(spark):
    from textmill.llm.ngram_join import keep_one, ngram_join

    a, b = prose(100).split(), " ".join(f"other{i}" for i in range(40))
    near = " ".join([*a[:20], "edit", *a[21:]])
    rows = [(1, " ".join(a)), (2, near), (2, b), (3, None), (3, ""), (None, near), (4, b + " more"), (1, near), (5, "x " * 40_000), (5, "x " * 40_000)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, digest string, n long")
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in keep_one(docs).collect())
    # 2's other text stays though its near copy goes; of 1's two texts one stays
    assert (2, b) in kept and (2, near) not in kept and (4, b + " more") not in kept
    assert len([k for k in kept if k[0] == 1]) == 1 and len([k for k in kept if k[0] == 5]) == 2
    assert [k for k in kept if k[0] in (-1, 3)] == [(-1, near), (3, ""), (3, "")]
    assert keep_one(docs).columns == docs.columns and ngram_join(docs).count() == len(rows)


def test_ngram_join_tells_long_words_apart_that_a_polynomial_confuses(spark):
    from textmill.llm.ngram_join import ngram_join
    from textmill.llm.shingles import text_sets

    thue = "a"
    for _ in range(12):  # 4,096 letters; polynomials modulo 2**64 take this word and its complement for equal
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [f"{x} one two three four" for x in (thue, other, thue.upper())]
    a, b, c = (s.tolist() for s in text_sets(__import__("pyarrow").array(texts)))
    assert a != b and a == c
    got = {r.doc_id: r.component_id for r in ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_stream_dedup_with_clashing_columns(spark, tmp_path):
    from textmill.llm.stream_dedup import keep_distinct, stream_dedup

    rows = [(1, "a", "f", 1, "d", "m"), (2, "a", "f", 2, "d", "m"), (2, "a", "f", 3, "d", "m"), (None, None, None, None, None, None), (3, "", "f", 4, "d", "m"), (4, "x" * 3_000_000, "f", 5, "d", "m"), (5, "x" * 3_000_000, "f", 6, "d", "m")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, file string, row long, digest string, _metadata string")
    frame.write.parquet(f"{tmp_path}/d")
    for docs in (frame, spark.read.parquet(f"{tmp_path}/d"), frame.withColumn("keep", frame["row"])):
        kept = sorted((r.doc_id, len(r.text)) for r in keep_distinct(docs).collect())
        assert kept == [(2, 1), (3, 0), (5, 3_000_000)]
        assert keep_distinct(docs).columns == docs.columns
        assert stream_dedup(docs).where("kept").count() == 3


def test_mixing_takes_rows_without_id_one_by_one(spark):
    from textmill.llm.mixing import mix_sources, mixed_documents

    rows = [(None, "w " * 10, s, "k", 1) for s in ("a", "b", None) for _ in range(60)] + [(7, "w " * 10, "b", "k", 1)] * 30 + [(8, None, "a", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size long")
    target = {r.source: r.target for r in mix_sources(docs).collect()}
    taken = {s: 0 for s in target}
    for r in mixed_documents(docs).collect():
        taken[r.source] += size(r.text)
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)
    assert mixed_documents(docs).columns == docs.columns and mixed_documents(docs.limit(0)).count() == 0


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_bpe_of_long_texts_and_clashing_columns(spark):
    from textmill.llm.bpe import bpe_round_trip

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["q" * 5_000, prose(200_000), "", None, "Ünï <|endoftext|> " * 3]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids_sha256 string, n_tokens long")
    got = bpe_round_trip(docs, path).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_stream_dedup(spark, docs, rows):
    from textmill.llm.stream_dedup import keep_distinct, stream_dedup

    for digest in (None, lambda t: __import__("pyspark").sql.functions.length(t).cast("string")):  # the second one collides
        got = stream_dedup(docs, digest=digest).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r[1] or "", []).append(r[0])
        assert len(got) == len(rows)
        keep = {hashlib.sha256(t.encode()).hexdigest(): (max(i if i is not None else -1 for i in g), len(g)) for t, g in groups.items()}
        for r in got:
            assert (-1 if r.keep_id is None else r.keep_id, r.group_size) == keep[r.text_sha256]
        assert sum(r.kept for r in got) == len(groups)
    assert keep_distinct(docs).count() == len(groups)
    assert keep_distinct(docs).columns == docs.columns
    assert stream_dedup(empty(spark)).count() == 0


def test_token_files_round_trip(spark, docs, rows):
    from textmill.llm.token_files import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = token_files(docs, path).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start = 0
    text = {r[0]: r[1] for r in rows}
    for r in got:
        ids = np.array([*tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files(empty(spark), path).count() == 0


def test_bpe_matches_the_library(spark, docs, rows):
    from textmill.llm.bpe import WordBpe, bpe_encode, bpe_round_trip

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = sorted((r[0] or -1, *(lambda e: (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()))(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_round_trip(docs, path).collect())
    assert got == want
    assert {r.doc_id: r.ids for r in bpe_encode(docs, path).collect()}[305] == tok.encode(rows[[r[0] for r in rows].index(305)][1], add_special_tokens=False).ids
    model = WordBpe(path)
    alphabet = "abcdefghijklmnopqrstuvwxyzé'0!?. \nΣİß"
    for _ in range(500):
        t = "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))
        assert model.encode(t) == tok.encode(t, add_special_tokens=False).ids
    assert bpe_round_trip(empty(spark), path).count() == 0


def test_mixing_reaches_targets(spark, docs, rows):
    from textmill.llm.mixing import mix_sources, mixed_documents

    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + size(r[1])
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(totals.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * totals[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        free -= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == totals[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max((r.size for r in mine), default=0)
        assert all(r.taken <= 3 * r.size for r in mine)
    again = sorted((r.doc_id or -1, r.taken) for r in mix_sources(docs).collect())
    assert again == sorted((r.doc_id or -1, r.taken) for r in got)
    assert mixed_documents(docs).columns == docs.columns
    assert mix_sources(empty(spark)).count() == 0


def test_embedding_dedup_against_brute_force(spark):
    from textmill.llm.embedding_dedup import projection_dedup

    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    x[40:80] = x[0] + 0.05 * rng.standard_normal((40, 16))
    x[80:100] = x[1]
    x[100:110] = x[2] + 0.2 * rng.standard_normal((10, 16))
    label = [int(i) for i in rng.integers(0, 3, 300)]
    for i in range(40, 110):
        label[i] = label[{0: 0, 1: 1, 2: 2}[0 if i < 80 else 1 if i < 100 else 2]]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(300)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, rows[0][1], None), (305, [None] * 16, 1), (None, rows[0][1], 0), (306, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in projection_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = ((n @ n.T) >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    comp = list(range(300))
    for _ in range(20):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(300)]
    assert len(got) == len(rows)
    assert [got[i].component_id for i in range(300)] == comp
    assert [got[i].n_links for i in range(300)] == near.sum(axis=1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 306))
    assert projection_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


LUHN = "4111111111111111"
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def planted(n, pairs, low, high, seed, common=0.0):
    """n random unit vectors and a partner for the first `pairs` of them, at cosines from low to high; `common` is
    the mean cosine of two vectors."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base[:, 0] += np.sqrt(common / (1 - common))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    w = rng.standard_normal((pairs, 64))
    w -= (w * base[:pairs]).sum(axis=1, keepdims=True) * base[:pairs]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = np.linspace(low, high, pairs)[:, None]
    return np.concatenate([base, c * base[:pairs] + np.sqrt(1 - c * c) * w])


def test_embedding_dedup_recall_in_a_large_label(spark):
    from textmill.llm.embedding_dedup import projection_dedup

    x = planted(40_000, 2_000, 0.9301, 0.95, 11)  # about ten windows
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in projection_dedup(rows).collect()}
    found = sum(got[k].component_id == got[40_000 + k].component_id and got[k].n_links >= 1 for k in range(2_000))
    assert found >= 0.99 * 2_000
    for k in range(0, len(x), 500):
        cosine = x[k] @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x[k])
        assert got[k].n_links <= int((cosine >= 0.93).sum()) - 1


@pytest.mark.parametrize("many", [24, 1_000])
def test_embedding_dedup_of_vectors_with_a_common_direction(spark, monkeypatch, many):
    """Crowded vectors are compared with their whole label, or get more passes."""
    from textmill.llm import embedding_dedup as e

    monkeypatch.setattr(e, "WINDOW", 256)
    monkeypatch.setattr(e, "MANY", many)
    monkeypatch.setattr(e, "CELL", 3_000)
    x = planted(9_000, 1_000, 0.9301, 0.935, 3, 0.8)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in e.projection_dedup(rows).collect()}
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    want, links = near.sum(axis=1), np.array([got[i].n_links for i in range(len(x))])
    assert want.sum() >= 2_000 and (links <= want).all()
    assert links.sum() >= 0.99 * want.sum()
    assert sum(got[k].component_id == got[9_000 + k].component_id for k in range(1_000)) >= 990


def test_embedding_dedup_groups_larger_than_the_window(spark, monkeypatch):
    """Small windows and cells: passes count each pair once, and full vectors are counted again exactly."""
    from textmill.llm import embedding_dedup as e

    monkeypatch.setattr(e, "WINDOW", 64)
    monkeypatch.setattr(e, "FULL", 100)
    monkeypatch.setattr(e, "CELL", 150)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((400, 16)), rng.standard_normal(16) * 5 + 0.02 * rng.standard_normal((500, 16)), planted(300, 300, 0.931, 0.99, 2)[:, :16]])
    x[10:20] = x[9]
    x[30:40] *= 1e-200
    x[40:50] *= 1e200
    label = np.where(np.arange(len(x)) % 7 == 0, 2, 1)
    rows = [(i, v.tolist(), int(label[i]), "c", i) for i, v in enumerate(x)] + [(5, x[6].tolist(), int(label[6]), "c", 0)] * 2
    got = e.projection_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, comp string, rid long")).collect()
    assert len(got) == len(rows)
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = near.sum(axis=1) + 2 * near[:, 6]
    got = {r.vec_id: r.n_links for r in got if r.vec_id not in (5, 6)}
    dense = [i for i in got if want[i] >= 100]
    assert len(dense) > 400 and all(got[i] == want[i] for i in dense)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * sum(want[i] for i in got)


def base_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_and_discovery(spark):
    from textmill.llm.pii import find_pii

    texts = [None, "", "é a.b@c.d.e_x@y.zz 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1", f"{LUHN} 4111-1111 1111-1111x +1 (743) 555-3824. +12", "@@a@b.c+1@2.3", "1" * 40_000, "a" * 40_000 + "@x.y", "+" * 500 + "9" * 12, "x 1.1.1.1 日本 4111 1111 1111 1111"]
    random.seed(5)
    texts += ["".join(random.choice("ab@.-+ 0123459()é") for _ in range(200)) for _ in range(150)]
    texts += [f"prose{i} please call me +1 555 010 {1000 + i} today" for i in range(8)]
    texts += ["again please call me 555 010 7777 soon", "they counted all in 555 010 7777 rows"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i].spans)
        assert set(want) <= set(got[i].spans.split(","))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(w.startswith(k) for w in want) for k in PII)
    assert got[len(texts) - 2].spans == "phone:21:33"
    assert find_pii(docs.limit(0)).count() == 0


def test_revisits_resolve(spark):
    from textmill.llm.warc import resolve_revisits

    full = 'ETag: "a"\r\nContent-Type: text/html\r\nX: 1\r\nX: 2'
    rows = [
        (1, "response", "http://www.A.org:80/p/?utm_source=q#f", 10, 200, full, "D1"),
        (2, "revisit", "https://a.org/p", 20, 304, 'etag: W/"a"\r\nX: 9\r\nContent-Type: none\r\nDate: now', None),
        (3, "revisit", "https://a.org/p", 20, 304, 'ETag: "b"', None),
        (4, "revisit", "https://a.org/p", 5, 304, None, None),
        (5, "revisit", "https://a.org/p", 30, 304, "", None),
        (6, "response", "https://a.org/p", 25, 404, full, "D2"),
        (7, "revisit", None, 30, 304, 'ETag: "a"', None),
        (8, "response", "https://a.org/q?b=1&ref=z", 1, 200, "Last-Modified: x", "D3"),
        (9, "revisit", "http://a.org/q?b=1", 2, 304, "Last-Modified: x", None),
        (10, "revisit", "http://a.org/q?b=1", None, 304, "Last-Modified: x", None),
        (11, None, "http://a.org/q", 3, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, type string, url string, ts long, status int, headers string, payload_digest string")
    got = {r.record_id: r for r in resolve_revisits(df).collect()}
    assert {k: (r.state, r.refers_to) for k, r in got.items()} == {2: ("resolved", 1), 3: ("mismatch", 1), 4: ("orphan", None), 5: ("unverified", 1), 7: ("orphan", None), 9: ("resolved", 8), 10: ("orphan", None)}
    assert got[2].headers == 'content-type: text/html\ndate: now\netag: W/"a"\nx: 9' and got[2].payload_digest == "D1"
    assert got[5].headers == 'content-type: text/html\netag: "a"\nx: 1, 2'
    assert resolve_revisits(df.limit(0)).count() == 0


def trigrams(text):
    """Counts of hashed trigrams, from the definition: bytes, letters only, all else a blank."""
    b = ["%c" % (c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in text.encode()]
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        if (x, y) != (" ", " "):
            out.append(((ord(x) << 16 | ord(y) << 8 | ord(z)) * 2654435761 % 2**32) >> 17)
    return out


def brute_language(rows, labelled):
    """[({language: posterior}, text has letters)] of rows (text, {column: value}, host, domain)."""
    counts = {}
    for text, lang in set(labelled):
        if text is not None and (lang or "").strip():
            own = counts.setdefault(lang, {})
            for g in trigrams(text):
                own[g] = own.get(g, 0) + 1
    langs = sorted(counts)
    total = {la: sum(counts[la].values()) + 0.5 * 2**15 for la in langs}

    def soft(logs):
        top = max(logs.values())
        e = {la: math.exp(v - top) for la, v in logs.items()}
        return {la: v / sum(e.values()) for la, v in e.items()}

    add = lambda a, b: {la: a.get(la, 0.0) + b[la] for la in langs}
    text_logs, own = [], []
    for text, *_ in rows:
        g = trigrams(text)
        logs = {la: sum(math.log((counts[la].get(x, 0) + 0.5) / total[la]) for x in g) * min(len(g), 60) / len(g) for la in langs} if g else None
        text_logs.append(logs)
        own.append(soft(logs) if g else None)
    everyone, hosts, domains, said = {la: 1.0 for la in langs}, {}, {}, {}
    for (_, values, host, domain), p in zip(rows, own):
        if p is None:
            continue
        everyone = add(everyone, p)
        for key in values.items():
            if key[1] is not None:
                said[key] = add(said.get(key, {}), p)
        if host is not None:
            h = hosts.setdefault((host, domain), [{}, 0])
            d = domains.setdefault(domain, [{}, 0])
            for x in (h, d):
                x[0], x[1] = add(x[0], p), x[1] + 1
    p_all = {la: v / sum(everyone.values()) for la, v in everyone.items()}
    smooth = lambda x, up: {la: (x[0].get(la, 0.0) + 20 * up[la]) / (x[1] + 20) for la in langs}
    out = []
    for (_, values, host, domain), logs in zip(rows, text_logs):
        prior = smooth(hosts[host, domain], smooth(domains[domain], p_all)) if (host, domain) in hosts else p_all
        post = {la: (logs[la] if logs else 0.0) + math.log(prior[la]) for la in langs}
        for col, value in values.items():
            if (col, value) in said:
                same = {k: v for k, v in said.items() if k[0] == col}
                for la in langs:
                    post[la] += math.log((said[col, value][la] + 0.5) / (sum(v[la] for v in same.values()) + 0.5 * (len(same) + 1)))
        out.append((soft(post), logs is not None))
    return out


def test_revisits_with_long_queries_ties_and_repeats(spark):
    from textmill.llm.warc import resolve_revisits

    long = "http://a.org/p?q=" + "x" * (2 << 20)
    rows = [
        (1, "response", long + "1", 10, 200, 'ETag: "a"', "D1", "k"),
        (2, "revisit", long + "2", 20, 304, 'ETag: "a"', None, "k"),
        (3, "revisit", long + "1", 20, 304, 'ETag: "a"', None, "k"),
        (4, "response", "http://b.org/", 5, 200, 'ETag: "old"', "D4", "k"),
        (5, "response", "http://b.org/", 5, 200, 'ETag: "new"', "D5", "k"),
        (6, "revisit", "http://b.org/", 5, 304, 'ETag: "new"', None, "k"),
        (6, "revisit", "http://b.org/", 5, 304, 'ETag: "new"', None, "k"),
    ]
    df = spark.createDataFrame(rows, "record_id long, type string, url string, ts long, status int, headers string, payload_digest string, url_key string")
    got = sorted((r.record_id, r.state, r.refers_to) for r in resolve_revisits(df).collect())
    assert got == [(2, "orphan", None), (3, "resolved", 1), (6, "resolved", 5), (6, "resolved", 5)]


def test_pii_without_limits_of_length(spark):
    from textmill.llm.pii import find_pii

    local, label = "l" * 100, "d" * 100
    word = "w" * 300
    texts = [f"{word} {word}: +1 555 010 {1000 + i} end" for i in range(5)] + [f"{word} {word}: 555 010 9999 end"]
    texts += [f"phone: +1 555 020 {1000 + i}\nx" for i in range(5)] + ["phone: 555 020 9999"]
    texts += [f"mail me a{i}@b.org ok" for i in range(5)] + [f"mail me {local} (at) {label}.org ok"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y"), (None, texts[5], "x", "y"), (None, texts[5], "x", "y")]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string, kind string, spans string")).collect()
    assert len(got) == len(rows)
    spans = {r.doc_id: r.spans for r in got if r.doc_id is not None}
    assert spans[5] == "phone:603:615" and spans[11] == "phone:7:19" and spans[17] == f"email:8:{8 + 100 + 6 + 104}"
    assert [r.spans for r in got if r.doc_id is None] == [spans[5]] * 2 and [r.spans for r in got if r.doc_id == 0] == [spans[0]] * 2


def test_identify_pages_against_brute_force(spark):
    from textmill.llm.language import identify_pages

    random.seed(12)
    words = {la: [a + b for a in x for b in y] for la, x, y in (("en", ("the", "wh", "or"), ("ing", "ed", "")), ("fr", ("le", "ou", "d'"), ("eux", "on", "")), ("de", ("der", "sch", "ö"), ("ung", "lich", "")))}
    say = lambda la, n: " ".join(random.choice(words[la]) for _ in range(n))
    labelled = [(say(la, 20), la) for la in words for _ in range(30)] + [(None, "fr"), ("", "de"), ("x", None), ("y", " ")]
    pages, plain = [], []
    for i in range(120):
        la = random.choice(list(words))
        text = say(la, random.choice([0, 0, 1, 2, 12]))
        host, tld = random.choice([("a.x", "de"), ("b.x", "de"), ("www.y", "fr"), ("z", "com"), ("q.z", "com")])
        path, declared = random.choice(["", la, "xy"]), random.choice([None, None, la, "EN-us"])
        url = f"http://{host}.{tld}/" + (f"{path}/p{i}" if path else f"p{i}")
        if i % 17 == 0:
            url, host, tld, path = None, None, None, ""
        tag = f" lang='{declared}'" if declared else ""
        pages.append((i, url, f"<html{tag}><p>{text}</p></html>" if i else None, "clash", 1.0))
        full = f"{host}.{tld}" if host else None
        values = {"declared": (declared or "").lower()[:2] or None, "suffix": tld, "path": path or None}
        plain.append((f"  {text}  " if i else "", values if i else values | {"declared": None}, full, ".".join(full.split(".")[-2:]) if full else None))
    pages.append(pages[5])
    plain.append(plain[5])
    got = identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string, lang string, confidence double"), spark.createDataFrame(labelled, "text string, lang string")).collect()
    want = brute_language(plain, labelled)
    assert len(got) == len(pages)
    by_id = {p[0]: w for p, w in zip(pages, want)}
    for r in got:
        post, heard = by_id[r.page_id]
        assert abs(max(post.values()) - r.confidence) < 2e-6 and abs(post[r.lang] - r.confidence) < 2e-6, r
        assert r.accepted == (heard and max(post.values()) >= 0.5)
    assert identify_pages(spark.createDataFrame(pages[:2], "page_id long, url string, html string, lang string, confidence double"), spark.createDataFrame([], "text string, lang string")).count() == 2
    assert identify_pages(spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame(labelled, "text string, lang string")).count() == 0


def test_language_model_has_no_limit_of_languages(spark):
    from textmill.llm.language import fit_text_model

    stem = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(" ".join(stem(k) * 2 + random.choice("xyz") for _ in range(12)), f"l{k:03}") for k in range(120) for _ in range(3)]
    rows += [("same text again", "l000")] * 5_000
    languages, model = fit_text_model(spark.createDataFrame(rows, "text string, lang string"), per_language=50)
    assert languages == [f"l{k:03}" for k in range(120)] and model.shape[1] == 120


def test_language_fusion(spark, docs):
    from textmill.llm.language import identify_documents, identify_pages

    en, fr = "the of and with that this where them", "le la des une avec qui dans pour"
    labelled = spark.createDataFrame([(f"{en} {i}", "en") for i in range(30)] + [(f"{fr} {i}", "fr") for i in range(30)] + [(None, "fr"), ("x", None)], "text string, lang string")
    pages = [(i, f"http://h.example.com/en/{i}", f"<html lang='en'><p>{en}</p></html>") for i in range(20)]
    pages += [(100 + i, f"http://f.example.org/fr/{i}", f"<html lang='fr'><script>the of</script><p>{fr}</p></html>") for i in range(20)]
    pages += [(200, None, None), (201, "http://f.example.org/fr/x", ""), (202, "nonsense", f"<p>{fr}"), (203, "http://h.example.com/", "<html lang='xx'>")]
    got = {r.page_id: r for r in identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled).collect()}
    assert len(got) == len(pages)
    assert all(got[i].lang == "en" and got[i].accepted for i in range(20))
    assert all(got[100 + i].lang == "fr" and got[100 + i].accepted for i in range(20))
    assert not got[200].accepted and not got[201].accepted and got[201].lang == "fr" and got[202].lang == "fr"
    kept = identify_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids.isdisjoint({300, 301, 302}) and {0, 1, 2, 3, 303} <= ids


def test_toxicity_learns_from_labels(spark):
    from textmill.llm.toxicity import score_toxicity

    random.seed(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(60).split()
        if bad:
            for k in range(3):
                words.insert(random.randrange(len(words)), random.choice(["worthless", "idiot", "clown"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "you Idiot, worthless CLOWN!"), (1002, prose(5_000)), rows[0]]
    labels += [(5000, 1), (None, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_toxicity(docs, known).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert [r.predicted for r in got if r.doc_id is None] == [1] and [r.predicted for r in got if r.doc_id in (1000, 1001)] == [0, 0]
    assert score_toxicity(docs, known.limit(0)).count() == len(rows)
    assert score_toxicity(docs.limit(0), known).count() == 0


def test_toxicity_learns_rare_insults(spark):
    from textmill.llm.toxicity import score_toxicity

    random.seed(21)
    rows, labels = [], []
    for i in range(2_400):
        words = prose(40).split()
        if i % 2:
            rare = i % 60 == 1  # 1 in 30 toxic rows has this insult and no other
            for w in ["nitwit"] if rare else random.sample(["worthless", "idiot", "clown"], 2):
                words.insert(random.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    rows += [(10_000 + i, prose(40) + " nitwit " + prose(5)) for i in range(20)] + [(20_000 + i, prose(40)) for i in range(20)]
    got = {r.doc_id: r.predicted for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[10_000 + i] for i in range(20)) and not any(got[20_000 + i] for i in range(20))


def test_toxicity_scores_as_plain_zstandard(spark):
    """The scoring pass against plain Python and zstandard; toxic words of families, no word twice the same."""
    import zstandard

    from textmill.llm import toxicity as x

    random.seed(33)
    rows = []
    for i in range(900):
        ws = prose(40).split()
        if i % 3 == 0:
            for _ in range(3):  # a family: the word differs, its stem doesn't
                ws.insert(random.randrange(len(ws)), "vequz" + random.choice(VOCAB) + random.choice(VOCAB))
        rows.append((i, " ".join(ws), "s", i))
    rows += [(2_000, None, "s", 1), (2_001, "", "s", 1), (2_002, "!!! ... \u3000", "s", 1), (2_003, prose(60_000), "s", 1), (2_004, "vequzthe " * 5_000, "s", 1), rows[0], rows[0], (None, rows[1][1], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    toxic, ordinary, weights = x.fit(docs, labels)
    params = zstandard.ZstdCompressionParameters.from_level(9, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c + x.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for c in (toxic, ordinary)]

    def plain(text):
        words = re.findall(rb"[0-9a-z'\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        gaps = []
        for w in words:
            a, b = (len(p.compress(b" " + w + b" " + x.TAIL)) for p in packers)
            gaps.append(min(x.MOST, max(0, b - a)))
        low, high = weights[-2:]
        reach = lambda k: sum(g >= k for g in gaps) * min(1, high / max(1, len(gaps)))
        f = [math.sqrt(reach(k) / max(30, min(len(gaps), high))) for k in range(1, 6)] + [math.log1p(reach(k)) for k in (2, 3, 4)] + [math.log(min(high, max(low, len(gaps))))]
        z = sum(a * b for a, b in zip(f, weights)) + weights[9]
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    got = x.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is None or r.doc_id % 9 == 0 or r.doc_id >= 2_000:
            assert abs(r.score - plain(texts[r.doc_id])) < 1e-9, r.doc_id
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (2_000, 2_001, 2_002, 2_003, 2_004)} == {2_000: 0, 2_001: 0, 2_002: 0, 2_003: 0, 2_004: 1}


def test_token_files_order_null_and_repeated_ids(spark):
    from textmill.llm.token_files import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    random.seed(8)
    rows = [(None, prose(random.randint(0, 9)) or None) for _ in range(250)] + [(None, "same text")] * 400
    rows += [(i, prose(random.randint(1, 30))) for i in range(330)] + [(7, prose(3)) for _ in range(200)] + [(9, "a")] * 300
    rows += [(5_000, prose(300_000))]
    random.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, shard string, part int").repartition(8)
    runs = []
    for _ in range(2):
        got = sorted(token_files(docs, path).collect(), key=lambda r: r.start)
        ids = [-1 if r.doc_id is None else r.doc_id for r in got]
        assert ids == sorted(-1 if i is None else i for i, _ in rows)
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
        runs.append([tuple(r) for r in got])
    assert runs[0] == runs[1]
    tok = Tokenizer.from_file(path)
    want = sorted((-1 if i is None else i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((-1 if r[0] is None else r[0], r[2]) for r in runs[0]) == want

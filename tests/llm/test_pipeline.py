"""The pipeline's stages against plain Python versions of what they decide."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_operators import DOC, brute_components, brute_language, corpus  # noqa: E402


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def language_stage(rows):
    """Rows whose best posterior reaches one half and whose text has letters."""
    labelled = [(r[1], r[2]) for r in rows]
    post = brute_language([(r[1] or "", {}, r[3], None) for r in rows], labelled)
    return [r for r, (best, heard) in zip(rows, post) if heard and max(best.values()) >= 0.5]


def exact_stage(rows):
    """Of equal texts one row stays, the one with the largest doc_id."""
    best = {}
    for r in rows:
        key = r[1] or ""
        if key not in best or (-1 if r[0] is None else r[0]) > (-1 if best[key][0] is None else best[key][0]):
            best[key] = r
    return list(best.values())


def near_stage(rows):
    comp = brute_components(rows)
    return [r for r in rows if r[0] is None or comp[r[0]] == r[0]]


def mix_stage(rows, seed=17):
    totals = defaultdict(int)
    for r in rows:
        totals[r[3]] += size(r[1])
    order = sorted(s for s in totals if s is not None) + [None] * (None in totals)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(totals.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * totals[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * totals[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    out = []
    for s in order:
        mine = [r for r in rows if r[3] == s]
        mine.sort(key=lambda r: (hashlib.md5(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or -1, size(r[1])))
        whole = math.floor(target[s] / totals[s]) if totals[s] else 0
        rest, run = target[s] - whole * totals[s], 0
        for r in mine:
            run += size(r[1])
            times = whole + int(rest > 0 and run - size(r[1]) / 2 <= rest)
            out += [r] * (times if size(r[1]) else 1)
    return out


def test_every_stage_decides_as_the_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, DOC).repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    for (name, stage), plain in zip(pipeline.STAGES[:-1], (language_stage, exact_stage, near_stage, mix_stage)):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = plain(rows)
        assert sorted(map(key, (tuple(r) for r in docs.collect()))) == sorted(map(key, rows)), name
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((key(r)[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    again = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_sha256) for r in again) == sorted((-1 if r.doc_id is None else r.doc_id, r.ids_sha256) for r in got)

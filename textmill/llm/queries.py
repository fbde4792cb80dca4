"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textmill.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.warc import captures, resolve_revisits

    return resolve_revisits(captures(table(spark, sf_dir, "pages")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.language import identify_pages

    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.stream_dedup import stream_dedup

    return stream_dedup(table(spark, sf_dir, "documents")).drop("file", "row")


def op7_bpe_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.embedding_dedup import projection_dedup

    return projection_dedup(table(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents")).drop("text_hash", "keep_hash")


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.turn_trie import turn_trie

    return turn_trie(table(spark, sf_dir, "conversations"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.clustering import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings")).drop("n_compared")


def op13_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_token_files, op3_warc_revisits, op4_language_id, op5_toxicity, op6_stream_dedup, op7_bpe_dp, op8_embedding_dedup,
        op9_mix_sources, op10_ngram_join, op11_turn_trie, op12_centroid_clusters, op13_jump_shards,
    )
}


def _crc32(codes: str) -> str:
    """SQL for the CRC-32 of a list of byte codes: each code goes in at once, then bit by bit (-1)."""
    steps = f"flatten(list_transform({codes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, c: CASE WHEN c >= 0 THEN xor(a, c) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


def _shard_sql(shards: int = 8) -> str:
    """The jumps of each key, one step after the other; a key makes shards + 1 at most."""
    sizes = "CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS code"
    jumps = ["j0 AS (SELECT DISTINCT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k, 0::HUGEINT AS cut, 0::HUGEINT AS shard, 0::HUGEINT AS grown FROM documents)"]
    for i in range(shards + 1):
        jumps.append(f"""
            k{i} AS (SELECT doc_id, cut, CASE WHEN cut < {shards} THEN cut ELSE shard END AS shard, CASE WHEN cut <= {shards} THEN cut ELSE grown END AS grown,
                   (k * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM j{i}),
            j{i + 1} AS (SELECT doc_id, k, CASE WHEN cut > {shards} THEN cut ELSE floor((cut + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE))::HUGEINT END AS cut, shard, grown FROM k{i})""")
    return f"""
        WITH sized AS (SELECT doc_id, {sizes} FROM documents),
        rests AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, c: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY b) AS rest FROM range(256) t(b)),
        summed AS (SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(code, '..'), lambda x: CAST('0x' || x AS BIGINT))),
            lambda a, c: xor(rest[(xor(a, c) & 255) + 1], a >> 8)), 4294967295) AS BIGINT) AS text_crc32 FROM sized, rests),
        {",".join(jumps)}
        SELECT s.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, CAST(grown AS INT) AS grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
        FROM summed s JOIN j{shards + 1} j ON s.doc_id IS NOT DISTINCT FROM j.doc_id
    """


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """A step of assignment and one of means for each round, over one row for each component."""
    out = [
        """
        kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS INT) AS cluster, x AS c FROM kept ORDER BY cluster LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        out.append(f"""
        a{r} AS MATERIALIZED (
            SELECT vec_id, x, (m).cluster AS cluster, (m).d AS distance FROM (
                SELECT vec_id, x, min({{'d': CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'cluster': cluster}}) AS m
                FROM kept, c{r} GROUP BY vec_id, x))""")
        if r < rounds:
            out.append(f"""
        m{r} AS MATERIALIZED (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
                SELECT cluster, i, CAST(sum(x[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{r}, unnest(range(1, 65)) t(i) GROUP BY cluster, i)
            GROUP BY cluster),
        c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return f"""
        WITH {",".join(out)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)
    """

_SHAPE = r"'(?i)^\s*https?://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)(:[0-9]+)?([^?#]*)(\?[^#]*)?'"
_TRACKING = r"'(?i)(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*'"

ORACLE_SQL: dict[str, str] = {
    "op11_turn_trie": rf"""
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
            SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base, {_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: unicode(ch))")} % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM turns)),
        moved AS (
            SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
            UNION ALL
            SELECT c.conv_id, c.h + t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
        keyed AS (
            SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY place) FILTER (WHERE place IS NOT NULL) AS ids,
                   list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY place) FILTER (WHERE place IS NOT NULL) AS words
            FROM convs LEFT JOIN moved USING (conv_id) GROUP BY conv_id),
        prefixes AS (
            SELECT conv_id, d, coalesce(array_to_string(ids[1:d], ''), '') AS node, words[d] AS words, d = coalesce(len(ids), 0) AS ends
            FROM keyed, unnest(range(0, coalesce(len(ids), 0) + 1)) u(d)),
        nodes AS (
            SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * max(words) END AS own,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
            FROM prefixes GROUP BY node, d),
        kids AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        whole AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
        below AS (
            SELECT left(node, 32 * a) AS node, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
            FROM whole, unnest(range(0, depth + 1)) u(a) GROUP BY ALL)
        SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
        FROM whole w JOIN below b USING (node) LEFT JOIN whole p ON w.depth > 0 AND p.node = left(w.node, 32 * (w.depth - 1))
    """,
    "op12_centroid_clusters": _cluster_sql(),
    "op13_jump_shards": _shard_sql(),
    "op3_warc_revisits": f"""
        WITH parts AS (
            SELECT page_id, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n,
                   regexp_extract(url, {_SHAPE}, 1) AS host, regexp_extract(url, {_SHAPE}, 2) AS port,
                   regexp_replace(regexp_extract(url, {_SHAPE}, 3), '/+$', '') AS path,
                   regexp_replace(regexp_replace(substr(regexp_extract(url, {_SHAPE}, 4), 2), {_TRACKING}, '', 'g'), '^&', '') AS query
            FROM pages),
        page AS (
            SELECT page_id, digest, n, page_id * 3600 AS moment, page_id % 5 AS which,
                   CASE WHEN host <> '' THEN lower(host) || CASE WHEN port IN (':80', ':443') THEN '' ELSE port END || path
                        || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key FROM parts),
        revisits AS (
            SELECT *, page_id * 3 + 1 AS record_id, moment + 1800 AS ts FROM page
            UNION ALL SELECT *, page_id * 3 + 2, moment - 1800 FROM page),
        tagged AS (
            SELECT *, CASE which WHEN 0 THEN '"other"' WHEN 1 THEN 'W/"' || digest || '"' WHEN 3 THEN '"' || digest || '"' END AS tag FROM revisits),
        found AS (
            SELECT r.*, f.page_id AS f_page, f.digest AS f_digest, f.n AS f_n, f.moment AS f_moment
            FROM tagged r ASOF LEFT JOIN page f ON r.url_key = f.url_key AND r.ts > f.moment),
        judged AS (
            SELECT *, CASE WHEN f_page IS NULL THEN 'orphan' WHEN which = 0 THEN 'mismatch' WHEN which = 4 THEN 'unverified'
                WHEN which = 2 THEN CASE WHEN f_moment = moment THEN 'resolved' ELSE 'mismatch' END
                WHEN digest = f_digest THEN 'resolved' ELSE 'mismatch' END AS state FROM found)
        SELECT record_id, url_key, f_page * 3 AS refers_to, state,
            CASE WHEN state IN ('resolved', 'unverified') THEN f_digest END AS payload_digest,
            'cache-control: max-age=' || page_id % 7 || chr(10) || CASE WHEN state IN ('resolved', 'unverified')
                THEN 'content-length: ' || f_n || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || ts || chr(10)
                    || 'etag: ' || coalesce(tag, '"' || f_digest || '"') || chr(10) || 'last-modified: ' || f_moment
                ELSE 'connection: close' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts
                    || CASE WHEN tag IS NOT NULL THEN chr(10) || 'etag: ' || tag WHEN which = 2 THEN chr(10) || 'last-modified: ' || moment ELSE '' END END AS headers
        FROM judged
    """,
    "op6_stream_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_mix_sources": """
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                   md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
            FROM documents),
        totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
                   source_size * 3.0::DOUBLE AS cap FROM totals),
        levels AS (
            SELECT *, ((SELECT sum(source_size) FROM totals) - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM ranked WINDOW r AS (ORDER BY cap / weight, source ASC NULLS LAST)),
        water AS (SELECT max(level) AS water FROM levels WHERE level <= cap / weight),
        targets AS (
            SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target
            FROM levels, water),
        parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
        runs AS (
            SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS run
            FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               CAST((whole + CASE WHEN rest > 0 AND run - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
        FROM runs
    """,
}

"""Exact nearest vectors with most of the index left out by the triangle inequality.

Vectors go to the nearest of a few pivots and, within its cluster, into blocks of neighbours by their distance
from it. A question that is d away from a pivot is at least d - high and low - d away from every vector of a block
whose distances lie in [low, high]. A first round searches the most promising block of each question; its k-th
distance then bounds the answer, and a second round searches only blocks that may hold something nearer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.order import in_ranges
from textmill.sources.tables import scratch_dir

#: Pivots, which every task holds; vectors of a block (a power of two), and questions that meet a block in one task.
PIVOTS, BLOCK_BITS, QUESTIONS = 256, 12, 2_048
#: Squared distances that differ by less may be equal when rounded; so may distances, by their vectors' length.
SLACK = 1e-5


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False)
    if len(x) != dims * len(column):
        raise ValueError(f"a vector has not the index's {dims} components")
    return x.reshape(-1, dims).astype(np.float64)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)))


class BlockedIndex:
    """An index of (chunk_id, embedding) in blocks around pivots; only the pivots' table is on the driver."""

    def __init__(self, index: DataFrame, pivots: int = PIVOTS):
        #: Floats stay floats on disk and between tasks; they are compared as doubles.
        self.number = "float" if index.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
        rows = index.select("chunk_id", F.col("embedding").cast(f"array<{self.number}>").alias("v")).where("size(v) > 0")
        rows = _kept(rows, "index")  # pivots, ranges and blocks read it: the vectors are made once
        first = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).collect()
        self.dims = len(first[0]["v"]) if first else 0
        self.pivots = np.array([r["v"] for r in first]).reshape(len(first), self.dims)
        self.kind = index.schema["chunk_id"].dataType.simpleString()
        if not first:
            return
        centres, dims = self.pivots, self.dims

        def nearest(batches):
            for batch in batches:
                d = distances(_vectors(batch.column(1), dims), centres)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=["chunk_id", "v", "cluster", "dist"])

        placed = in_ranges(rows.mapInArrow(nearest, f"chunk_id {self.kind}, v array<{self.number}>, cluster int, dist double"), ["dist"], ("cluster",))
        self.vectors = placed.withColumn("cell", F.shiftright("__id", BLOCK_BITS)).drop("__id", "__part")
        blocks = self.vectors.groupBy("cluster", "cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
        self.blocks = _kept(blocks, "blocks")
        found = self.blocks.groupBy("cluster").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
        self.cluster = np.array([r["cluster"] for r in found], np.int64)
        self.n, self.low, self.high = (np.array([r[c] for r in found], float) for c in ("n", "low", "high"))
        self.reach = float((np.sqrt((centres[self.cluster] ** 2).sum(axis=1)) + self.high).max())

    def probes(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, cluster, d, bound, slack) for the clusters that may hold one of the k nearest; bound is never below
        the k-th distance, slack covers the rounding of distances."""
        kind = queries.schema["query_id"].dataType.simpleString()
        centres, cluster, n, low, high, dims, reach = self.pivots[self.cluster], self.cluster, self.n, self.low, self.high, self.dims, self.reach

        def run(batches):
            for batch in batches:
                x = _vectors(batch.column(1), dims)
                d = distances(x, centres)
                slack = SLACK * (1 + reach + np.sqrt((x * x).sum(axis=1)))
                far = d + high
                order = np.argsort(far, axis=1)
                enough = np.cumsum(n[order], axis=1) >= k
                place = np.where(enough.any(axis=1), enough.argmax(axis=1), len(n) - 1)
                bound = np.where(enough.any(axis=1), np.take_along_axis(far, np.take_along_axis(order, place[:, None], 1), 1)[:, 0], np.inf)
                q, c = np.nonzero(np.maximum(d - high, low - d) <= (bound + slack)[:, None])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), pa.array(cluster[c].astype(np.int32)), pa.array(d[q, c]), pa.array(bound[q]), pa.array(slack[q])], names=["query_id", "cluster", "d", "bound", "slack"])

        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("v")).where("size(v) > 0")
        return asked.mapInArrow(run, f"query_id {kind}, cluster int, d double, bound double, slack double")

    def search(self, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, kth): squared distances of the k nearest of each question in each of its
        blocks, pairs(query_id, cluster, cell), ties included; kth is the k-th of the block, if it has so many."""
        kind, dims = queries.schema["query_id"].dataType.simpleString(), self.dims
        load = pairs.groupBy("cluster", "cell").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("parts"))
        asked = pairs.join(load, ["cluster", "cell"]).withColumn("part", F.expr("pmod(xxhash64(query_id), parts)").cast("int"))
        asked = asked.join(queries.select("query_id", F.col("query").cast("array<double>").alias("v")), "query_id")
        none = lambda kind: F.lit(None).cast(kind)
        left = asked.select("cluster", "cell", "part", "query_id", none(self.kind).alias("chunk_id"), F.col("v").alias("q"), none(f"array<{self.number}>").alias("v"))
        held = self.vectors.join(load, ["cluster", "cell"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        right = held.select("cluster", "cell", "part", none(kind).alias("query_id"), "chunk_id", none("array<double>").alias("q"), "v")

        def run(group: pa.Table) -> pa.Table:
            asks, own = group.filter(group.column("q").is_valid()), group.filter(group.column("v").is_valid())
            q, x = (_vectors(c.combine_chunks(), dims) for c in (asks.column("q"), own.column("v")))
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]  # a part may have no question
            for at in range(0, len(q), 256):
                rows = distances(q[at : at + 256], x) ** 2
                last = np.sort(np.partition(rows, min(k, rows.shape[1]) - 1, axis=1)[:, :k], axis=1)[:, -1]
                r, c = np.nonzero(rows <= last[:, None] + SLACK)
                kth = last[r] if rows.shape[1] >= k else np.full(len(r), np.inf)
                found.append((at + r, c, rows[r, c], kth))
            r, c, score, kth = (np.concatenate(part) for part in zip(*found))
            return pa.table([asks.column("query_id").take(pa.array(r)), own.column("chunk_id").take(pa.array(c)), pa.array(score), pa.array(kth)], names=["query_id", "chunk_id", "score", "kth"])

        return left.union(right).groupBy("cluster", "cell", "part").applyInArrow(run, f"query_id {kind}, chunk_id {self.kind}, score double, kth double")


def nearest_pairs(index: BlockedIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score) with the k nearest of each question, ties and more included; and the pairs of
    questions and blocks that were searched, (query_id, cluster, cell)."""
    probes = index.probes(queries, k)
    low = F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d"), F.lit(0.0)).alias("least")
    pairs = probes.join(index.blocks, "cluster").select("query_id", "cluster", "cell", "d", "bound", "slack", low)
    pairs = _kept(pairs.where("least <= bound + slack"), "pairs")
    best = F.min(F.struct("least", "d", "cluster", "cell")).alias("b")
    home = _kept(pairs.groupBy("query_id").agg(best, F.min("bound").alias("bound")).select("query_id", "b.cluster", "b.cell", "bound"), "home")
    near = _kept(index.search(queries, home.select("query_id", "cluster", "cell"), k), "near")
    known = near.groupBy("query_id").agg(F.min(F.sqrt(F.col("kth") + SLACK)).alias("kth"))
    limit = home.join(known, "query_id").select("query_id", F.col("cluster").alias("c"), F.col("cell").alias("e"), F.least("bound", "kth").alias("limit"))
    rest = pairs.join(limit, "query_id").where("NOT (cluster = c AND cell = e) AND least <= limit + slack").select("query_id", "cluster", "cell")
    rest = _kept(rest, "rest")
    more = index.search(queries, rest, k)
    return near.union(more).select("query_id", "chunk_id", "score"), home.select("query_id", "cluster", "cell").union(rest)


def searched_share(index: BlockedIndex, queries: DataFrame, k: int) -> float:
    """The share of all pairs of questions and vectors that a search compares."""
    _, pairs = nearest_pairs(index, queries, k)
    done = pairs.join(index.blocks, ["cluster", "cell"]).agg(F.sum("n")).first()[0] or 0
    every = index.blocks.agg(F.sum("n")).first()[0] * queries.where("size(query) > 0").count()
    return done / max(1, every)


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the k nearest of index(chunk_id, embedding) by squared L2 for each of
    queries(query_id, query), ties by chunk_id. Exact; null and empty vectors and questions have no rows. All vectors
    must have the same length. The work that the bounds save depends on how the vectors cluster."""
    blocked = BlockedIndex(index)
    if not len(blocked.pivots):
        empty = queries.where("false").select("query_id").join(index.select("chunk_id").where("false"))
        return empty.withColumn("distance", F.lit(0.0)).withColumn("rank", F.lit(1))
    near, _ = nearest_pairs(blocked, queries, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return near.select("query_id", "chunk_id", F.round("score", digits).alias("distance")).withColumn("rank", rank).where(F.col("rank") <= k)

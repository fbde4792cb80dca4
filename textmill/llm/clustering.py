"""Centroid clustering in integers, with centroids ruled out in a rotated space.

Vectors become integers once. The principal axes of all vectors give a rotation; of each vector the table
keeps the integers, its leading rotated coordinates and the norm of the rest. The distance of two vectors is
at least that of their leading coordinates plus the squared difference of the two rest norms, so most
centroids are ruled out by a few multiplications, and the survivors are compared exactly in integers. A
round sends the centroids out and gets sums for each centroid back; both are k times dims numbers,
however many vectors there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import release, stage

#: Largest integer component: squared distances of up to 128 such components fit in 64 bits.
MOST = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x array<int>) of the vectors with dims finite components: x = floor(scale * component)."""
    v = F.col("embedding").cast("array<double>")
    good = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(c * float(scale)))
    fits = F.forall(whole, lambda c: F.abs(c) <= MOST)
    kept = vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fits, whole).alias("x"))
    return kept.withColumn("x", F.coalesce("x", F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}"))).cast("array<int>"))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _totals(parts: DataFrame, by: list[str], kind: str) -> list:
    """Sums of the arrays `sums` place by place: (by..., pos, total) rows."""
    each = parts.select(*by, F.posexplode("sums").alias("pos", "value"))
    return each.groupBy(*by, "pos").agg(F.sum(F.col("value").cast(kind)).alias("total")).collect()


def principal_axes(ints: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthonormal axes, most variance first, from sums of products over all vectors."""

    def run(batches):
        n, total, gram = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = _rows(batch.column(0), dims).astype(np.float64)
            n, total, gram = n + len(x), total + x.sum(axis=0), gram + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([n], total, gram.ravel())).tolist()], pa.list_(pa.float64()))], names=["sums"])

    found = np.zeros(1 + dims + dims * dims)
    for r in _totals(ints.select("x").mapInArrow(run, "sums array<double>"), [], "double"):
        found[r["pos"]] = r["total"]
    n = max(found[0], 1.0)
    mean = found[1 : dims + 1] / n
    spread = found[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean)
    return mean, np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]


def rotate(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The leading rotated coordinates of each row and the norm of its rest."""
    away = x - mean
    head = away @ axes
    rest = np.sqrt(((away - head @ axes.T) ** 2).sum(axis=1))
    return np.column_stack((head, rest))


def nearest(x: np.ndarray, short: np.ndarray, centroids: np.ndarray, centroids_short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids compared in integers) for each row of x; short: rotate() of it.

    The bound of head and rest norm is a distance in one dimension more, so it is never above the true one;
    a slack of a billionth of the squared norms covers the rounding. Ties go to the smaller number.
    """
    n, k = len(x), len(centroids)
    lower = np.empty((n, k))
    for j in range(k):
        lower[:, j] = ((short - centroids_short[j]) ** 2).sum(axis=1)
    lower -= 1e-9 * ((short**2).sum(axis=1)[:, None] + (centroids_short**2).sum(axis=1)[None, :] + 1.0)
    order = np.argsort(lower, axis=1, kind="stable")
    best, cluster, tried = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int32), np.zeros(n, np.int32)
    live = np.arange(n)
    for rank in range(k):
        j = order[live, rank]
        still = lower[live, j] <= best[live]
        live, j = live[still], j[still]
        if not len(live):
            break
        d = ((x[live] - centroids[j]) ** 2).sum(axis=1)
        tried[live] += 1
        better = (d < best[live]) | ((d == best[live]) & (j < cluster[live]))
        best[live[better]], cluster[live[better]] = d[better], j[better]
    return cluster, best, tried


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, lead: int = 16) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_compared) of vectors(vec_id, embedding).

    Only vectors with exactly dims components, all finite, are kept; a component beyond MOST / scale raises an
    error, as its distances don't fit in a long. Centroids start as the k vectors with the smallest SHA-256
    of `seed:vec_id` (`seed:null` without an id; of equal ids the smaller vector), fewer if there are
    fewer vectors. Each round assigns all vectors and replaces every centroid that has any by the exact floor
    of their mean. Rounds after one that moves nothing are left out: they would change nothing. n_compared
    counts the centroids that the bound didn't rule out at the end. No vectors give no rows.
    """
    ints = integer_vectors(vectors, dims, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = ints.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    mean, axes = principal_axes(ints, dims)
    axes = np.ascontiguousarray(axes[:, :lead])
    wide = axes.shape[1] + 1

    def shorten(batches):
        for batch in batches:
            x = _rows(batch.column(1), dims)
            short = rotate(x.astype(np.float64), mean, axes)
            packed = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (x.astype("<i4"), short.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], names=["vec_id", "x", "short"])

    rotated = stage(ints.select("vec_id", "x").mapInArrow(shorten, "vec_id long, x binary, short binary"), "rotated")

    def assigned(batch, at, centroids):
        x = _matrix(batch.column(at), "<i4", dims).astype(np.int64)
        return x, nearest(x, _matrix(batch.column(at + 1), "<f8", wide), centroids, rotate(centroids.astype(np.float64), mean, axes))

    def summed(centroids):
        def run(batches):
            sums = np.zeros((len(centroids), dims + 1), np.int64)
            for batch in batches:
                x, (cluster, _, _) = assigned(batch, 0, centroids)
                for j in np.unique(cluster):
                    mine = x[cluster == j]
                    sums[j, :dims] += mine.sum(axis=0)
                    sums[j, dims] += len(mine)
            found = np.flatnonzero(sums[:, dims])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(sums[found].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

        return run

    for _ in range(rounds if len(centroids) else 0):
        parts = rotated.select("x", "short").mapInArrow(summed(centroids), "cluster int, sums array<long>")
        totals = {(r["cluster"], r["pos"]): int(r["total"]) for r in _totals(parts, ["cluster"], "decimal(20,0)")}
        moved = np.array([[totals[j, i] // totals[j, dims] for i in range(dims)] if (j, dims) in totals else centroids[j].tolist() for j in range(len(centroids))], np.int64)
        if (moved == centroids).all():
            break
        centroids = moved

    def final(batches):
        for batch in batches:
            _, (cluster, distance, tried) = assigned(batch, 1, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance), pa.array(tried)], names=["vec_id", "cluster", "distance", "n_compared"])

    out = stage(rotated.mapInArrow(final, "vec_id long, cluster int, distance long, n_compared int"), "clusters")
    release(rotated)
    inertia = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster")) if values else F.lit(None).cast(kind)
    return out.select(
        "vec_id",
        "cluster",
        "distance",
        of([inertia.get(j, 0) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
        "n_compared",
    )

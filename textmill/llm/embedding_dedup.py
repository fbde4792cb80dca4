"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label by concatenated random hyperplane bits and numbers them. Blocks
of ``WINDOW`` neighbours are compared within themselves and with the next block, so every vector meets at
least WINDOW neighbours on either side. A label of at most WINDOW vectors is compared whole in
one pass. In a larger one, every vector gets so many passes that, by the bits' collision probability, a
pair at the threshold is missed by all of them with probability ``MISS``. How many bits a pair must share to
meet is measured in the first pass, at the vector's own place: where vectors share a direction or lie in
a cluster, hyperplanes part them less, cells are fuller, and more passes follow. The label's size sets the
least number. A vector so crowded that its passes would meet as many vectors as its label has is compared
with the whole label instead, in cells.

A block gives back no pairs but, for each vector, its number of links that no earlier pass has met, and one
edge to the smallest vector that links within the block reach; the edges of all passes are united. A
vector with ``FULL`` links or more may have others beyond its windows, so its links are counted again
over its whole component, in cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import components, release, stage

#: Neighbours in the order of a pass that a vector is compared with, at least, on either side.
WINDOW = 4_096
#: Probability that all passes of a label miss a pair at the threshold.
MISS = 0.002
#: A crowded vector is compared with its whole label if it needs more passes than MANY and they meet as many vectors,
#: or more than MOST, because every row carries its blocks of earlier passes.
MANY, MOST = 24, 256
#: Hyperplanes of a pass.
BITS = 62
#: Links from which on a vector's links are counted over its whole component, and vectors of a cell then.
FULL, CELL = 1_024, 8_192
#: Rows of one matrix product, and pairs looked at at once.
ROWS, PAIRS = 512, 65_536


def passes_for(bits, threshold: float):
    """Passes that miss a pair at the threshold with probability MISS, if a pair meets that shares so many bits."""
    same = 1 - math.acos(threshold) / math.pi  # a hyperplane has both vectors of a pair on one side
    return F.when(bits <= 0, 1).otherwise(F.ceil(F.lit(math.log(MISS)) / F.log(1 - F.pow(F.lit(same), bits)))).cast("int")


def passes_of(m, threshold: float):
    """Passes that a label of m vectors gets, as a column of column m, if each bit halves what a cell holds."""
    return F.when(m <= WINDOW, 1).otherwise(passes_for(F.log2(m / F.lit(float(WINDOW))), threshold))


def crowding(placed: DataFrame) -> DataFrame:
    """(rid, bits) of placed(rid, label, dim, key, block): the fewest leading bits whose cell lies within the
    blocks that the vector is compared with, so that whatever shares them is met."""
    at = ["label", "dim", "block"]
    starts = placed.groupBy(*at).agg(F.min("key").alias("start"))  # a row for each block of a label
    beside = lambda k, name: starts.select("label", "dim", (F.col("block") + k).alias("block"), F.col("start").alias(name))
    edges = starts.drop("start").join(beside(1, "below"), at, "left").join(beside(-2, "above"), at, "left")
    key = F.col("key")
    alike = lambda s: F.when(s.isNull(), 0).when(s == key, BITS + 1).otherwise(BITS + 1 - F.length(F.bin(key.bitwiseXOR(s))))
    return placed.join(edges, at).select("rid", F.greatest(alike(F.col("below")), alike(F.col("above"))).alias("bits"))


def unit(vectors) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.stack(vectors).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def signatures(seed: int, first: int = 0):
    """(pass, label, dim, key, rid) for the passes from the first on of every vector of (rid, label, embedding, passes)."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches):
        for batch in batches:
            vectors, passes = batch.column(2), batch.column(3).to_numpy()
            sizes = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = unit(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))
                for p in range(first, passes[at].max()):
                    some = np.flatnonzero(passes[at] > p)
                    n, rows = len(some), pa.array(at[some])
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.Generator(np.random.PCG64([seed, p, int(dim)])).standard_normal((dim, BITS))
                    key = ((x[some] @ planes[p, dim]) >= 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), batch.column(1).take(rows), pa.array(np.full(n, dim, np.int32)), pa.array(key), batch.column(0).take(rows)], names=["pass", "label", "dim", "key", "rid"])

    return run


def _numbered(batches):
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "idx"])
        at += n


def _merge(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a node's number) after the nodes a[i] and b[i] are joined; the smallest label stays."""
    while True:
        x, y = lab[a], lab[b]
        apart = x != y
        if not apart.any():
            return lab
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        to = np.arange(len(lab))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (up := to[to]).tobytes() != to.tobytes():
            to = up
        lab = to[lab]


def _hits(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Rows of x, (a, b) with a in left and b in right, whose cosine reaches the threshold, some at a time.
    Single precision decides where it can, double precision near the threshold."""
    single = x.astype(np.float32)
    slack = max(1e-4, x.shape[1] * 2.4e-7)
    for at in range(0, len(left), ROWS):
        rows = left[at : at + ROWS]
        cosine = single[rows] @ single[right].T
        i, j = np.nonzero(cosine >= threshold - slack)
        for k in range(0, len(i), PAIRS):
            u, v = i[k : k + PAIRS], j[k : k + PAIRS]
            a, b, near = rows[u], right[v], cosine[u, v] > threshold + slack
            close = np.flatnonzero(~near)
            near[close] = np.einsum("ij,ij->i", x[a[close]], x[b[close]]) >= threshold
            yield a[near], b[near]


def _compare(threshold: float):
    """(rid, links, low) of the vectors of a block, and of those of the next that link with it."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["pass", "label", "dim", "rid"], kind="stable", ignore_index=True)
        kind = pdf.groupby(["pass", "label", "dim"], sort=False).ngroup().to_numpy()
        rid, copies, own = (pdf[c].to_numpy() for c in ("rid", "copies", "own"))
        links, lab = np.zeros(len(rid), np.int64), np.arange(len(rid))
        cuts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
        for start, stop in zip(cuts, cuts[1:]):
            if stop - start < 2 or not own[start:stop].any():
                continue
            p = int(pdf["pass"].iat[start])
            met = np.stack(pdf["blocks"].iloc[start:stop].to_numpy()) if p else None  # blocks of the earlier passes
            x, mine = unit(pdf["embedding"].iloc[start:stop].to_numpy()), own[start:stop]
            for a, b in _hits(x, np.flatnonzero(mine), np.arange(stop - start), threshold):
                new = (a < b) | ~mine[b]
                if p:
                    new &= (np.abs(met[a] - met[b]) > 1).all(axis=1)
                a, b = a[new] + start, b[new] + start
                links += np.bincount(a, copies[b], len(rid)).astype(np.int64) + np.bincount(b, copies[a], len(rid)).astype(np.int64)
                lab = _merge(lab, a, b)
        hit = np.flatnonzero(links)
        return pd.DataFrame({"rid": rid[hit], "links": links[hit], "low": rid[lab[hit]]})

    return run


def _recount(threshold: float):
    """(rid, links) of the full vectors of one cell with all vectors of another cell of their component."""

    def run(pdf):
        import pandas as pd

        rid, copies, full = (pdf[c].to_numpy() for c in ("rid", "copies", "full"))
        links = np.zeros(len(rid), np.int64)
        for a, b in _hits(unit(pdf["embedding"].to_numpy()), np.flatnonzero(full), np.flatnonzero(~full), threshold):
            other = rid[a] != rid[b]
            links += np.bincount(a[other], copies[b[other]], len(rid)).astype(np.int64)
        return pd.DataFrame({"rid": rid[full], "links": links[full]})

    return run


def _meet(threshold: float):
    """(rid, links, low) of the crowded vectors of one cell with all vectors of another cell of their label."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["rid", "full"], kind="stable", ignore_index=True)
        rid, copies, full, crowded = (pdf[c].to_numpy() for c in ("rid", "copies", "full", "crowded"))
        links, lab = np.zeros(len(rid), np.int64), np.arange(len(rid))
        for a, b in _hits(unit(pdf["embedding"].to_numpy()), np.flatnonzero(full), np.flatnonzero(~full), threshold):
            other = rid[a] != rid[b]
            a, b = a[other], b[other]
            back = ~crowded[b]  # a crowded one counts this link in a cell of its own
            links += np.bincount(a, copies[b], len(rid)).astype(np.int64) + np.bincount(b[back], copies[a[back]], len(rid)).astype(np.int64)
            lab = _merge(lab, a, b)
        hit = np.flatnonzero(links)
        return pd.DataFrame({"rid": rid[hit], "links": links[hit], "low": rid[lab[hit]]})

    return run


def _celled(nodes: DataFrame, by: list[str], chosen: str) -> DataFrame:
    """Groups (by, i, j): the chosen vectors in cell i (full) and all vectors in cell j, for all cells of by."""
    size = nodes.join(nodes.where(chosen).select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.count("*").alias("m"), F.count(F.when(F.col(chosen), 1)).alias("f"))
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    size = size.select(*by, cells("m").alias("km"), cells("f").alias("kf"))
    cell = lambda k: F.expr(f"pmod(xxhash64(rid), {k})").cast("int")
    every = lambda k: F.explode(F.expr(f"sequence(0, {k} - 1)"))
    side = lambda df, i, j, flag: df.join(size, by).select(*by, i, j, "rid", "copies", "embedding", chosen, F.lit(flag).alias("full"))
    left = side(nodes.where(chosen), cell("kf").alias("i"), every("km").alias("j"), True)
    right = side(nodes, every("kf").alias("i"), cell("km").alias("j"), False)
    return left.union(right)


def _full_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(rid, full_links) of the vectors of nodes(rid, comp, links, crowded, copies, embedding) with FULL links or more."""
    nodes = nodes.withColumn("many", F.expr(f"links >= {FULL} AND NOT crowded"))
    counted = _celled(nodes, ["comp"], "many").groupBy("comp", "i", "j").applyInPandas(_recount(threshold), "rid long, links long")
    return counted.groupBy("rid").agg(F.sum("links").alias("full_links"))


def _in_blocks(keys: DataFrame, first: int) -> DataFrame:
    """keys(pass, label, dim, key, rid) in order, with the number of their block, from the first on."""
    order = ["pass", "label", "dim", "key", "rid"]
    keys = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "pass int, label long, dim int, key long, rid long, part int, idx long")
    keys = stage(keys, "passes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keys.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row for each partition
    placed = keys.join(F.broadcast(parts.select("part", "base")), "part").withColumn("block", F.expr(f"(base + idx) div {WINDOW} + {first}"))
    return placed.drop("part", "idx", "base")


def projection_dedup(vectors: DataFrame, threshold: float = 0.93, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Vectors link when labels are equal and their cosine in double precision reaches the threshold.
    Null, empty and zero vectors, those with null or non-finite components, a null label or a null
    vec_id link with nothing (n_links 0; component_id is the row's own vec_id). Equal vectors of one
    label are one node with its number of copies, so copies are counted but never paired; rows that
    share a vec_id count as rows each. Vectors of different lengths don't link. Pairs are found with
    the probability that the module's docstring tells, none below the threshold. Other columns are
    ignored.
    """
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    fine = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    nodes = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = stage(nodes.withColumn("rid", F.monotonically_increasing_id()), "vectors")

    nodes = nodes.withColumn("dim", F.size("embedding"))
    schema = "pass int, label long, dim int, key long, rid long"
    keyed = lambda df, first: df.select("rid", "label", "embedding", "passes").mapInArrow(signatures(seed, first), schema)
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("m"))
    begun = _in_blocks(keyed(nodes.withColumn("passes", F.lit(1)), 0), 0)
    large = sizes.where(f"m > {WINDOW}").select("label", "dim", "m", passes_of(F.col("m"), threshold).alias("least"))
    bits = crowding(begun.join(large.select("label", "dim"), ["label", "dim"], "left_semi"))
    plan = bits.select("rid", passes_for(F.col("bits"), threshold).alias("asked"))
    plan = nodes.select("rid", "label", "dim").join(large, ["label", "dim"]).join(plan, "rid").select("rid", "m", F.greatest("least", "asked").alias("passes"))
    plan = stage(plan.select("rid", "passes", F.expr(f"passes > {MOST} OR passes > {MANY} AND passes * {2 * WINDOW}L >= m").alias("crowded")), "plan")
    more = nodes.join(plan.where("passes > 1 AND NOT crowded"), "rid")
    later = _in_blocks(keyed(more, 1), nodes.count() // WINDOW + 3)
    crowd = plan.where("crowded").select("rid", "crowded")
    placed = begun.drop("key").join(crowd, "rid", "left_anti").unionByName(later.drop("key"))
    blocks = placed.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pass", "block"))).alias("p"))  # one entry for each pass
    sent = blocks.join(nodes.select("rid", "label", "dim", "copies", "embedding"), "rid")
    sent = sent.withColumn("blocks", F.transform("p", lambda s: s["block"])).withColumn("to", F.explode("p"))
    ahead = F.explode(F.array(F.struct(F.col("to.block").alias("block"), F.lit(True).alias("own")), F.struct((F.col("to.block") - 1).alias("block"), F.lit(False).alias("own"))))
    dealt = sent.select(F.col("to.pass").alias("pass"), "label", "dim", "rid", "copies", "embedding", F.slice("blocks", F.lit(1), F.col("to.pass")).alias("blocks"), ahead.alias("at"))
    dealt = dealt.select("at.block", "at.own", "pass", "label", "dim", "rid", "copies", "embedding", "blocks").where("block >= 0")
    pairs = "rid long, links long, low long"
    marked = nodes.join(crowd, "rid", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    whole = _celled(marked, ["label", "dim"], "crowded").groupBy("label", "dim", "i", "j").applyInPandas(_meet(threshold), pairs)
    found = stage(dealt.groupBy("block").applyInPandas(_compare(threshold), pairs).union(whole), "links")
    comp = components(found.select(F.col("rid").alias("a"), F.col("low").alias("b")))
    release(begun, later)

    counted = found.groupBy("rid").agg(F.sum("links").alias("links"))
    bare = nodes
    nodes = marked.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    nodes = stage(nodes.join(counted, "rid", "left").withColumn("links", F.coalesce("links", F.lit(0))), "vectors")
    release(bare, plan, comp, found)
    again = stage(_full_links(nodes, threshold), "links")
    names = nodes.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    known = nodes.join(names, "comp").join(again, "rid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("full_links", "links"))
    known = stage(known.select("label", "embedding", "component_id", "n_links"), "known")
    release(nodes, again)
    lone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("fine").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return linked.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

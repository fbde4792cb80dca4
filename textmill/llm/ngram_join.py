"""N-gram Jaccard join by grouped prefixes.

Two texts link when their sets of distinct word shingles have a Jaccard similarity of at least
``percent`` / 100. The join is exact but for chance collisions of 64-bit shingle values (see shingles.py):

1. shingles are counted over the whole corpus in packed form. In the order of every set those that
   occur once come first, then repeated ones (a bit map of fixed size), last the most frequent ones
   by count (a table of at most ``FREQUENT`` entries). Any one order gives right results; this one
   keeps shared passages out of the prefixes;
2. the first n - ceil(t n) + 1 shingles of a set of n are its prefix. Linked sets share a prefix
   shingle. Texts with equal sets are one node, nodes with equal prefix and size one group;
3. groups meet by prefix shingle. A first round compares each group with one leader of each
   shingle, and each member with its group, which joins nearly all copies in linear work;
4. a second round compares the groups of a shingle that are still apart with another leader, drawn
   for each shingle, so near copies that miss the first leader find one of its neighbours;
5. the last round pairs all groups that share a prefix shingle and aren't yet in one component,
   filters the pairs by size, position and parity map, expands them to members and verifies these.
   A parity map has a bit for each of 512 slots of the shingle values, set if the slot holds an odd
   number; two sets differ in at least as many shingles as their maps in bits, so a filter by it
   loses no link. Each entry carries the first EARLIER shared shingles before it, so most pairs meet
   at their first common shingle only. Lists of frequent shingles are split by size and in cells. No link between components is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import components, fresh, give_back, release, settings, stage, sweep, worker_model
from textmill.llm.shingles import text_sets

#: Entries of the table of frequent shingles and bits of the map of repeated ones, which are broadcast:
#: 8 and 16 MB at most. Past some 50 million repeated shingles the map fills up; lists then get longer,
#: results stay the same.
FREQUENT, REPEATED = 1 << 20, 1 << 27
_SLOT = np.uint32(32 - (REPEATED.bit_length() - 1))
#: A prefix shingle of so many texts is dealt out over several tasks.
HOT = 20_000
#: Groups of one shingle that one cell of the last round holds.
CELL = 1_000
#: Earlier shared shingles that a list entry carries in the last round.
EARLIER = 4
#: 64-bit words of a set's parity map.
WORDS = 8


def _planes(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _from_planes(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _pack(x: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed byte planes of their differences."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(_from_planes(b, dtype), dtype=dtype)


def _ranges(spark) -> int:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(6, (2 * n - 1).bit_length())


def _count_keys(ranges: int):
    shift = np.uint32(32 - (ranges.bit_length() - 1))

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")  # sorted runs: a merge
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.add.reduceat(counts, at, dtype=np.uint32)

    def run(batches):
        worker_model(("shingles",), lambda: None)
        parts, held, new, n = [], 0, [], 0

        def fold():
            nonlocal new, n, held
            if new:
                k, c = np.unique(np.concatenate(new), return_counts=True)
                if len(k):  # texts without words have no shingles
                    parts.append((k, c.astype(np.uint32)))
                held += len(k)
                new, n = [], 0

        def flush():
            if not parts:
                return None
            k, c = merged(parts)
            cut = np.searchsorted(k >> shift, np.arange(ranges + 1, dtype=np.uint32))
            rows = [(r, _pack(k[a:b]), zstandard.compress(c[a:b].tobytes(), 1)) for r, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "counts"])

        for batch in batches:
            for s in text_sets(batch.column(0)):
                new.append((s >> np.uint64(32)).astype(np.uint32))
                n += len(new[-1])
                if n > 1_000_000:
                    fold()
            if held > 4_000_000:
                yield flush()
                parts, held = [], 0
        fold()
        if (out := flush()) is not None:
            yield out
        del parts, new
        give_back()

    def most(pdf):
        import pandas as pd

        k, c = merged([(_unpack(a, np.uint32), np.frombuffer(zstandard.decompress(b), np.uint32)) for a, b in zip(pdf["keys"], pdf["counts"])])
        top = FREQUENT // ranges
        width = REPEATED // ranges
        map_ = np.zeros(width, bool)
        map_[(k[c >= 2] >> _SLOT).astype(np.int64) % width] = True
        keep = np.flatnonzero(c >= 4)
        if len(keep) > top:
            keep = np.sort(keep[np.argsort(-c[keep].astype(np.int64), kind="stable")[:top]])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "keys": [k[keep].tobytes()], "counts": [c[keep].tobytes()], "map": [zstandard.compress(np.packbits(map_).tobytes(), 1)]})

    return run, most


def frequent_keys(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper halves of the most frequent shingle values, ascending; in how many texts each is; and a map
    with a bit set for each 27-bit upper part of a value that more than one text has.

    Counts cover every text. All three have a fixed size at most, however large the corpus is.
    """
    ranges = _ranges(texts.sparkSession)
    run, most = _count_keys(ranges)
    packed = texts.mapInArrow(run, "part int, keys binary, counts binary")
    rows = packed.groupBy("part").applyInPandas(most, "part int, keys binary, counts binary, map binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows] or [np.empty(0, np.uint32)])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows] or [np.empty(0, np.uint32)])
    bits = np.zeros((ranges, REPEATED // ranges // 8), np.uint8)
    for r in rows:
        bits[r["part"]] = np.frombuffer(zstandard.decompress(r["map"]), np.uint8)
    order = np.argsort(keys)
    return keys[order], counts[order], bits.ravel()


def _parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lookup(frequent, s):
    """Count of each shingle if it is frequent, 1 if it is repeated, else 0."""
    keys, counts, bits = frequent
    k = (s >> np.uint64(32)).astype(np.uint32)
    slot = k >> _SLOT
    known = ((bits[slot >> np.uint32(3)] >> (7 - (slot & np.uint32(7))).astype(np.uint8)) & 1).astype(np.int64)
    if len(keys) == 0:
        return known
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    return np.where(keys[at] == k, counts[at].astype(np.int64), known)


def _prefixes(frequent, percent: int):
    def run(batches):
        worker_model(("shingles",), lambda: None)
        table = frequent.value
        for batch in batches:
            rows = []
            for s in text_sets(batch.column(1)):
                n = len(s)
                if n == 0:
                    rows.append((0, None, None, None, None))
                    continue
                order = np.lexsort((s, _lookup(table, s)))
                prefix = s[order[: n - (percent * n + 99) // 100 + 1]].tobytes()
                rows.append((n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), hashlib.blake2b(prefix + n.to_bytes(8, "little"), digest_size=16).digest(), prefix, _parity(s)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))))], names=["doc_id", "hash", "n", "digest", "pdigest", "prefix", "bits"])
        give_back()

    return run


def _postings(frequent, ranges: int):
    """Lists of (shingle, group, size, place) packed by range of the shingle; those of hot ones by group."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    names = ["part", "tok", "gid", "n", "pos"]

    def run(batches):
        table = frequent.value
        for batch in batches:
            gids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            i = 0
            prefixes = batch.column(2)
            while i < len(gids):
                j, total, toks = i, 0, []
                while j < len(gids) and total < 1_000_000:
                    toks.append(np.frombuffer(prefixes[j].as_py(), np.uint64))
                    total += len(toks[-1])
                    j += 1
                lens = np.array([len(t) for t in toks])
                tok = np.concatenate(toks)
                gid, n = np.repeat(gids[i:j], lens), np.repeat(sizes[i:j], lens)
                pos = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)
                hot = _lookup(table, tok) >= HOT
                part = np.where(hot, -1 - (mix_id(gid) % ranges).astype(np.int64), (tok >> shift).astype(np.int64))
                order = np.lexsort((tok, part))
                tok, gid, n, pos, part = tok[order], gid[order], n[order], pos[order], part[order]
                at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                ends = np.append(at[1:], len(part))
                cols = [[_pack(tok[a:b]) for a, b in zip(at, ends)]]
                cols += [[_planes(c[a:b].astype(t)) for a, b in zip(at, ends)] for c, t in ((gid, np.int64), (n, np.int32), (pos, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=names)
                i = j

    def shared(pdf):
        import pandas as pd

        tok = np.concatenate([_unpack(x, np.uint64) for x in pdf["tok"]])
        gid, n, pos = (np.concatenate([_from_planes(x, t) for x in pdf[c]]) for c, t in (("gid", np.int64), ("n", np.int32), ("pos", np.int32)))
        if pdf["part"].iloc[0] >= 0:
            order = np.argsort(tok)
            t = tok[order]
            same = np.concatenate(([False], t[1:] == t[:-1]))
            order = order[same | np.append(same[1:], False)]
            tok, gid, n, pos = tok[order], gid[order], n[order], pos[order]
        return pd.DataFrame({"tok": tok.view(np.int64), "gid": gid, "n": n, "pos": pos})

    return run, shared


def mix_id(x: np.ndarray) -> np.ndarray:
    from textmill.llm.shingles import mix

    return mix(x.astype(np.uint64))


def _verify(percent: int):
    def run(batches):
        last, set_a = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, ok = batch.column(2), []
            for i, set_b in enumerate(text_sets(batch.column(3))):
                if a[i] != last:
                    last, set_a = a[i], next(text_sets(texts.slice(i, 1)))
                at = np.minimum(np.searchsorted(set_a, set_b), len(set_a) - 1)
                both = int((set_a[at] == set_b).sum())
                ok.append(100 * both >= percent * (len(set_a) + len(set_b) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])
        give_back()

    return run


def _fits(na: str, nb: str, pa_: str, pb: str, percent: int) -> F.Column:
    """Sizes and places allow the overlap that the threshold asks for."""
    best = f"least({pa_}, {pb}) + 1 + least({na} - {pa_} - 1, {nb} - {pb} - 1)"
    return F.expr(f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) AND 100 * ({best}) >= {percent} * ({na} + {nb} - ({best}))")


#: Rows of an Arrow batch: a row may hold two texts.
BATCH = 1_000


def ngram_join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size, text_hash, keep_hash) for every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable by links, the row's own included; class_size
    counts the rows with the same shingle set. Null and empty texts have no shingles and link with
    nothing; a row without doc_id keeps its n_shingles, links with nothing and has no component_id.
    Rows that share a doc_id are told apart by their sets. text_hash is the 64-bit hash of the row's text,
    keep_hash the least one among the rows of the component that carry component_id. Columns other than
    the two are ignored.
    """
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH):
        return _joined(docs, percent)


def _joined(docs: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_keys(docs.select("text")))
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    rows = hashed.mapInArrow(_prefixes(frequent, percent), "doc_id long, hash long, n long, digest binary, pdigest binary, prefix binary, bits array<long>")
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "prefixes")
    able = rows.where("n > 0 AND doc_id IS NOT NULL")
    groups = able.groupBy("pdigest").agg(F.min(F.struct("rid", "n", "prefix")).alias("m")).select("pdigest", "m.*")
    groups = stage(groups.withColumnRenamed("rid", "gid"), "groups")
    nodes = able.groupBy("digest").agg(F.min(F.struct("rid", "doc_id", "pdigest", "bits")).alias("m"), F.min(F.struct("doc_id", "hash")).alias("least"), F.count("*").alias("class_size"))
    nodes = nodes.select("digest", "m.rid", "m.doc_id", "m.pdigest", "m.bits", "least", "class_size")
    nodes = stage(nodes.join(groups.select("pdigest", "gid", "n"), "pdigest").drop("pdigest"), "nodes")

    ranges = _ranges(spark)
    run, shared = _postings(frequent, ranges)
    packed = groups.select("gid", "n", "prefix").mapInArrow(run, "part int, tok binary, gid binary, n binary, pos binary")
    lists = stage(packed.groupBy("part").applyInPandas(shared, "tok long, gid long, n int, pos int"), "postings")
    release(groups)

    # texts that may have a link: in a shared list, or beside another set in their group
    wanted = lists.select("gid").distinct().union(nodes.where("rid <> gid").select("gid")).distinct()
    wanted = nodes.join(wanted, "gid", "left_semi").select("rid", "doc_id", "digest")
    # partitioned by doc_id already, so dropping repeated rows needs no shuffle
    texts = docs.where("doc_id IS NOT NULL").join(wanted, "doc_id").dropDuplicates(["doc_id", "rid", "digest", "text"])

    def same_set(batches):  # a doc_id may come with several texts
        for batch in batches:
            keep = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d.as_py() for s, d in zip(text_sets(batch.column(2)), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(2).filter(pa.array(keep))], names=["rid", "text"])

    texts = stage(texts.select("rid", "digest", "text").mapInArrow(same_set, "rid long, text string"), "texts")
    sweep(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        side = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
        both = side.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a long, b long")

    def merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
        """nodes with the components that links join made one; both tables are given back."""
        at = nodes.select("rid", "comp")
        between = links.join(at.toDF("a", "ca"), "a").join(at.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        top = components(between).toDF("comp", "top")
        out = stage(nodes.join(top, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top"), "nodes")
        release(nodes, links, top)
        sweep(spark)
        return out

    def apart(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Range of the members' components of each group; lists whose groups aren't all in one component."""
        span = nodes.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.when(F.count("*") == 1, F.min("bits")).alias("bits"))
        ranged = lists.join(span, "gid").withColumn("band", F.floor(F.log("n") / math.log(101 / percent)).cast("int"))
        per = ranged.groupBy("tok", "band").agg(F.count("*").alias("c"), F.min("low").alias("l"), F.max("high").alias("h"))
        bands = F.map_from_entries(F.collect_list(F.struct("band", "c"))).alias("bands")  # a shingle's sizes have a few dozen bands
        mixed = per.groupBy("tok").agg(F.sum("c").alias("c"), F.min("l").alias("l"), F.max("h").alias("h"), bands).where("l < h AND c > 1")
        return span, ranged.join(mixed.select("tok", "c", "bands"), "tok")

    # first round: one leader for each shingle, one for each group
    nodes = nodes.withColumn("comp", F.col("rid"))
    lead = lists.groupBy("tok").agg(F.min(F.struct("gid", "n", "pos")).alias("l"))
    stars = lists.join(lead, "tok").where("gid <> l.gid").where(_fits("n", "l.n", "pos", "l.pos", percent))
    stars = stars.select(F.col("l.gid").alias("a"), F.col("gid").alias("b"))
    inside = nodes.where("rid <> gid").select(F.col("gid").alias("a"), F.col("rid").alias("b"))
    nodes = merged(nodes, stage(verified(stars.union(inside).distinct()), "links"))

    # second round: another leader, drawn for each shingle
    _, open_lists = apart(nodes)
    open_lists = open_lists.drop("bits", "band", "bands")
    lead = open_lists.groupBy("tok").agg(F.min(F.struct(F.xxhash64("tok", "gid").alias("h"), "gid", "n", "pos", "low", "high")).alias("l"))
    stars = open_lists.join(lead, "tok").where("gid <> l.gid AND NOT (low = l.high AND high = l.low)").where(_fits("n", "l.n", "pos", "l.pos", percent))
    stars = stars.select(F.least("gid", "l.gid").alias("a"), F.greatest("gid", "l.gid").alias("b"))
    nodes = merged(nodes, stage(verified(stars.distinct()), "links"))

    # last round: all groups that share a shingle and are still apart
    span, open_lists = apart(nodes)
    own = Window.partitionBy("gid").orderBy("pos")  # the prefix of one set
    all_own = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = F.filter(F.array(*(F.nth_value("tok", i + 1).over(all_own) for i in range(EARLIER))), lambda x: x.isNotNull())
    open_lists = open_lists.withColumn("place", F.row_number().over(own)).withColumn("firsts", firsts)
    open_lists = open_lists.withColumn("prev", F.slice("firsts", F.lit(1), F.least(F.col("place") - 1, F.lit(EARLIER))))
    # sizes of linked sets are in one band or in neighbours; the lists of frequent shingles are dealt by bands, and
    # these in cells, so that each two cells that may hold a link meet once
    hot = F.col("c") > CELL
    cells = F.when(hot, F.transform_values("bands", lambda _, c: F.ceil(c / CELL).cast("int"))).otherwise(F.create_map(F.lit(0), F.lit(1)))
    open_lists = open_lists.withColumn("cells", cells).withColumn("band", F.when(hot, F.col("band")).otherwise(0))
    open_lists = open_lists.withColumn("k", F.try_element_at("cells", F.col("band"))).withColumn("own", F.expr("pmod(xxhash64(gid), k)").cast("int"))
    up, down = (F.try_element_at("cells", F.col("band") + d) for d in (1, -1))
    none = F.array().cast("array<struct<band:int,step:int,i:int,j:int>>")
    place = lambda band, step, i, j: F.struct(band.cast("int").alias("band"), F.lit(step).alias("step"), i.alias("i"), j.alias("j"))
    all_of = lambda n, make: F.when(n.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(none)
    own, band = F.col("own"), F.col("band")
    first_of = F.concat(F.transform(F.sequence(own, F.col("k") - 1), lambda j: place(band, 0, own, j)), all_of(up, lambda j: place(band, 1, own, j)))
    second_of = F.concat(F.transform(F.sequence(F.lit(0), own), lambda i: place(band, 0, i, own)), all_of(down, lambda i: place(band - 1, 1, i, own)))
    side = lambda places, s: open_lists.select("tok", *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "pos", "low", "high", "bits", "prev")), F.explode(places).alias("at"))
    met = side(first_of, "a").join(side(second_of, "b"), ["tok", "at"])
    met = met.where("gid_a <> gid_b AND (at.step = 1 OR at.i < at.j OR gid_a < gid_b) AND NOT (low_a = high_b AND high_a = low_b)")
    met = met.where(_fits("n_a", "n_b", "pos_a", "pos_b", percent))
    differ = " + ".join(f"bit_count(bits_a[{i}] ^ bits_b[{i}])" for i in range(WORDS))
    met = met.where("NOT arrays_overlap(prev_a, prev_b)")
    # groups of several sets have no one map
    met = met.where(f"bits_a IS NULL OR bits_b IS NULL OR ({differ}) * {100 + percent} <= {100 - percent} * (n_a + n_b)")
    met = met.select(F.least("gid_a", "gid_b").alias("gid_a"), F.greatest("gid_a", "gid_b").alias("gid_b"))
    met = met.union(span.where("low < high").select("gid", "gid")).distinct()
    member = nodes.select("gid", "rid", "comp")
    pairs = (
        met.join(member.toDF("gid_a", "a", "comp_a"), "gid_a")
        .join(member.toDF("gid_b", "b", "comp_b"), "gid_b")
        .where("comp_a <> comp_b AND (gid_a <> gid_b OR a < b)")
        .select("a", "b")
    )
    nodes = merged(nodes, stage(verified(pairs), "links"))
    named = nodes.groupBy("comp").agg(F.min("least").alias("keep"))
    known = stage(nodes.join(named, "comp").select("digest", "keep", "class_size"), "classes")
    release(lists, texts, nodes)
    sweep(spark)
    out = rows.select("doc_id", "hash", "n", "digest").join(known, "digest", "left")
    with_id = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(with_id, F.coalesce("keep.doc_id", "doc_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.col("hash").alias("text_hash"),
        F.when(with_id, F.coalesce("keep.hash", "hash")).alias("keep_hash"),
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of every component: the smallest doc_id, and of several texts under that id the one with
    the least hash. Rows without doc_id or without words stay; equal rows stay or go together."""
    found = ngram_join(docs, percent)
    row, digest = fresh(docs, "lost_id"), fresh(docs, "lost_hash")
    lost = found.where("n_shingles > 0 AND (component_id <> doc_id OR keep_hash <> text_hash)").select(F.col("doc_id").alias(row), F.col("text_hash").alias(digest)).distinct()
    return docs.join(lost, (docs["doc_id"].cast("long") == F.col(row)) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col(digest)), "left_anti")

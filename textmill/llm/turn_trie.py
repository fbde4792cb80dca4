"""The prefix trie of conversations, built as adaptive radix trees over turn ids.

A turn's id is 16 bytes of the SHA-256 of its role and text; a conversation's key is its ids in order. Keys
are dealt in ranges and sorted, so the conversations below a node of the trie are neighbours. Each task
takes its keys in blocks of bounded size and builds a radix tree of each block. A node that holds neither
the first nor the last key of its block lies in that block alone and is finished there. The others, two
paths for each block, are open: their counts are added up over the blocks, and what lies below them is
a sum over neighbouring paths, by prefix sums over one row for each path.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import settings, stage
from textmill.llm.radix import RadixTree, unit_nodes

#: Bytes of a turn's id.
WIDTH = 16
#: Conversations and bytes of keys in a block.
BLOCK, BLOCK_BYTES = 20_000, 16_000_000
#: Characters of a word.
WORD = r"[^\x20\x09-\x0D]+"
NODE = "kind string, nid binary, parent binary, conv_id long, parent_conv_id long, depth long, n long, children long, leaves long, saved long, weight long, low long, high long, ends string"
_FIELDS = [f.split(" ")[0] for f in NODE.split(", ")]
_TYPES = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[f.split(" ")[1]] for f in NODE.split(", ")]


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the one that it is rebuilt on: 0 to 3 by its number's CRC-32."""
    return (F.crc32(conv_id.cast("string")) % 4).cast("int")


def rebuilt(conversations: DataFrame, every: int = 20) -> DataFrame:
    """(conv_id, key, words): each conversation's turn ids back to back and the words of each turn's text.

    The first turns come from the conversation whose number is the next multiple of `every` below. Turns
    are in the order of turn (null first), then role and id. One shuffle by that multiple brings a
    conversation's turns together with those of its base; texts stay behind.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    own, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    base = own - F.pmod(own, F.lit(every))
    words = F.regexp_count(text, F.lit(WORD)).alias("words")
    turns = conversations.where("conv_id IS NOT NULL").select(base.alias("base"), own.alias("conv_id"), F.struct(turn.isNotNull().alias("given"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"), digest.alias("id"), words).alias("t"))
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    first = whole.where("conv_id = base").select("base", F.slice("turns", 1, 3).alias("first"))
    taken = shared_turns(F.col("conv_id"))
    rest = F.slice("turns", taken + 1, F.greatest(F.size("turns") - taken, F.lit(0)))
    seq = F.concat(F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), taken), rest)
    joined = whole.join(first, "base", "left").select("conv_id", seq.alias("seq"))
    ids = F.array_join(F.transform("seq", lambda t: t["id"]), "")
    return joined.select("conv_id", F.unhex(ids).alias("key"), F.transform("seq", lambda t: t["words"]).alias("words"))


def _blocks(batches):
    """(numbers, keys, words) of neighbouring conversations, of bounded size."""
    numbers, keys, words, held = [], [], [], 0
    for batch in batches:
        for number, key, w in zip(*(c.to_pylist() for c in batch.columns)):
            if len(keys) == BLOCK or (keys and held + len(key) > BLOCK_BYTES):
                yield numbers, keys, words
                numbers, keys, words, held = [], [], [], 0
            numbers.append(number)
            keys.append(key)
            words.append(w)
            held += len(key)
    if keys:
        yield numbers, keys, words


def _digests(key: bytes) -> list[bytes]:
    """A digest of each prefix of whole turns, the empty one first."""
    state = hashlib.blake2b(digest_size=WIDTH)
    out = [state.digest()]
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        out.append(state.digest())
    return out


def _block_rows(numbers: list[int], keys: list[bytes], words: list[list[int]], place: int) -> list[list]:
    """Rows of NODE for the trie of one block: finished nodes (kind `done`), open ones, and ends of open ones.

    numbers ascend among equal keys. place and place + 1 are the places of the first and last key's path.
    """
    tree, last = RadixTree(), len(keys) - 1
    for member, key in enumerate(keys):
        tree.insert(key, member)
    names = _digests(keys[0]), _digests(keys[last])
    least, rows, waiting = {}, [], {}

    def name(node, depth):
        return names[0 if node.low == 0 else 1][depth]

    def is_open(low, high):
        return low == 0 or high == last

    for node, children in unit_nodes(tree, WIDTH, lambda member, depth: words[member][depth - 1], is_open):
        # the smallest number below: of the ends, or of a child
        number = min([*(numbers[m] for m in node.ends[:1]), *(least.pop(id(c)) for c in children)])
        least[id(node)] = number
        ends, weight = [numbers[m] for m in node.ends], words[node.low][node.depth - 1] if node.depth else 0
        if is_open(node.low, node.high):
            for c in children:
                if (row := waiting.pop(id(c), None)) is not None:
                    row[2] = name(node, node.depth)
            parent = name(node, node.depth - 1) if node.depth else None
            low, high = place + (node.low != 0), place + (node.high == last)
            rows.append(["open", name(node, node.depth), parent, number, None, node.depth, node.high - node.low + 1, node.closed, node.leaves, node.saved, weight, low, high, None])
            for at in range(0, len(ends), 4096):
                rows.append(["ends", name(node, node.depth), None, ends[at], None, node.depth, None, None, None, None, None, place, None, ",".join(map(str, ends[at : at + 4096]))])
        else:
            for c in children:
                waiting.pop(id(c))[4] = number
            digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
            waiting[id(node)] = row = ["done", None, None, number, None, node.depth, node.high - node.low + 1, node.kids, node.leaves, node.saved, None, None, None, digest]
            rows.append(row)
    return rows


def _tries(batches):
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 33
    for numbers, keys, words in _blocks(batches):
        rows = _block_rows(numbers, keys, words, place)
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), _TYPES)], names=_FIELDS)
        place += 2


def _joined_digests(batches):
    """(nid, digest): SHA-256 of each node's ends, which come in order and in pieces; only its state is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for nid, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if nid == now:
                state.update(b"," + piece.encode())
                continue
            if now is not None:
                done.append((now, state.hexdigest()))
            now, state = nid, hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["nid", "digest"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["nid", "digest"])


def trie_nodes(keyed: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the nodes of
    the trie of keyed(conv_id, key, words); see turn_trie."""
    spark = keyed.sparkSession
    ordered = keyed.select("conv_id", "key", "words").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    nodes = stage(ordered.mapInArrow(_tries, NODE), "trie")

    parts = nodes.where("kind = 'open'")
    summed = parts.groupBy("nid").agg(
        F.min("parent").alias("parent"),
        F.min("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")),
        F.min("weight").alias("weight"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    kids = summed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("nid")).agg(F.count("*").alias("kids"))
    merged = summed.join(kids, "nid", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).drop("kids")
    merged = merged.withColumn("leaves", F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0))
    merged = stage(merged.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("weight")), "open")

    # a node stands on the first path that holds it: below it are the deeper nodes of that path, and all
    # that stand on the later paths up to the last that holds it
    deeper = Window.partitionBy("low").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paths = merged.select(F.explode(F.array("low", "high")).alias("path")).distinct()
    own = merged.groupBy(F.col("low").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    upto = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # two rows for each block
    run = paths.join(own, "path", "left").select("path", *(F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in ("l", "s")))
    total = merged.withColumn("leaves", F.sum("leaves").over(deeper)).withColumn("saved", F.sum("saved").over(deeper))
    total = total.join(run.toDF("low", "l0", "s0"), "low").join(run.toDF("high", "l1", "s1"), "high")

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=256):  # a piece has up to 4,096 numbers
        pieces = nodes.where("kind = 'ends'").select("nid", "ends", "conv_id").repartition("nid").sortWithinPartitions("nid", "conv_id")
        digests = stage(pieces.select("nid", "ends").mapInArrow(_joined_digests, "nid binary, digest string"), "ends")
    above = merged.select(F.col("nid").alias("parent"), F.col("conv_id").alias("above"))
    opened = total.join(digests, "nid", "left").join(above, "parent", "left")
    opened = opened.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n", "children", (F.col("leaves") + F.col("l1") - F.col("l0")).alias("leaves"), (F.col("saved") + F.col("s1") - F.col("s0")).alias("saved"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends"))
    done = nodes.where("kind = 'done'")
    top = done.where("parent IS NOT NULL").drop("parent_conv_id").join(above.withColumnRenamed("above", "parent_conv_id"), "parent")
    names = ["conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "ends"]
    out = opened.select(names).union(done.where("parent IS NULL").select(names)).union(top.select(names))
    return out.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_trie(conversations: DataFrame, every: int = 20) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each
    different sequence of first turns of the rebuilt conversations(conv_id, turn, role, text).

    See rebuilt() for what a rebuilt conversation is. conv_id is the node's smallest member, n_leaves counts
    the childless nodes of its subtree, saved_tokens adds up (n_convs - 1) times the words of a node's last
    text over the subtree; ends_sha256 is the digest of the decimal numbers of the conversations that end
    there. Null roles and texts are empty; null turns come first, equal turns by role and id; repeated rows are
    turns of their own. Negative numbers have the multiple below them as base. Rows without conv_id are
    left out, other columns are ignored, and an empty table gives no rows. A conversation is one row of
    16 bytes for each turn; nothing else holds what grows with the table.
    """
    return trie_nodes(rebuilt(conversations, every))

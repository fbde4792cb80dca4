"""Token-ID files: flat unsigned integers beside 64-bit document offsets.

A shard is three flat little-endian files in a folder that the executors share:

* ``NAME.ids``: the token ids of its documents, back to back, unsigned 16 or 32 bits wide;
* ``NAME.off``: n + 1 signed 64-bit offsets into the ids, counted in tokens, from 0;
* ``NAME.doc``: n signed 64-bit doc_ids (0 for the leading documents without one).

Documents ascend by doc_id within shards and across them, by the number of their partition. A manifest table (Parquet) lists the shards that
succeeded, so files of failed or repeated tasks are never read. A shard's base, the number of tokens
before it, is a prefix sum over the manifest. Readers map local files into memory and read others in
one piece each.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.bpe import byte_alphabet
from textmill.llm.common import work_dir, worker_model

#: Blanks outside ASCII. Fixed values.
_WIDE_GAP = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_GAPS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")
#: Characters whose classes the splitting pattern needs and no Unicode version has changed.
_SETTLED = re.compile(r"[\n\0]?[\x21-\x7e\xa1-\xac\xae-\u024f\u2010-\u2027\u2030-\u205e]+").fullmatch
#: Pieces and words that an encoder remembers at most; then it forgets all.
REMEMBERED = 400_000
_SWAPPED = sys.byteorder == "big"
MANIFEST = "part int, shard string, n_null long, n_docs long, n_tokens long, width int"


class ByteBpe:
    """The tokenizers library's encoder with a bounded memory of what its model made of each piece.

    In texts whose gaps are single blanks or line ends, no token crosses from one piece (a blank or
    line end and what follows up to the next) to another. So the new pieces of a batch are split in one
    go, and each different word goes to the library's model once while it is remembered. Other texts
    go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = regex.compile(public_pattern()).findall
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if _SWAPPED:
            out.byteswap()
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():  # printed characters stand for themselves
            shown = word.replace(" ", self.alphabet[32]).replace("\n", self.alphabet[10])
        else:
            shown = word.encode().decode("latin-1").translate(self.alphabet)
        self.known[word] = out = self.bytes([t.id for t in self.tokenize(shown)])
        return out

    def _library(self, text: str) -> bytes:
        return self.bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: set[str]) -> None:
        """Pieces without their blank; those after a line end start with it, those at a text's start with \\0."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        after: dict[str, list[str]] = {" ": [], "\n": []}
        for p in pieces:
            if not _SETTLED(p):
                self.pieces[p] = self._library(p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p)
            elif p[0] == "\0":
                self.pieces[p] = b"".join([self.known.get(w) or self._word(w) for w in self.words(p[1:])])
            else:
                after["\n" if p[0] == "\n" else " "].append(p)
        for mark, group in after.items():
            if not group:
                continue
            found = self.words("".join(group) if mark == "\n" else " " + " ".join(group))
            parts = [self.known.get(w) or self._word(w) for w in found]
            starts = [i for i, w in enumerate(found) if w[0] == mark]
            for p, i, j in zip(group, starts, [*starts[1:], len(parts)], strict=True):
                self.pieces[p] = parts[i] if j == i + 1 else b"".join(parts[i:j])

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of each text and the end id, as little-endian bytes."""
        cut: list[list[str] | None] = []
        for text in texts:
            plain = text and not any(g in text for g in _GAPS) and not text[0].isspace() and not text[-1].isspace()
            plain = plain and "\0" not in text  # the mark below
            plain = plain and (text.isascii() or not _WIDE_GAP(text)) and not any(x in text for x in self.special)
            cut.append(("\0" + text.replace("\n", " \n")).split(" ") if plain else None)
        new = set().union(*(c for c in cut if c)).difference(self.pieces)
        if new:
            if len(self.pieces) + len(new) > REMEMBERED:  # what is forgotten may be needed here
                self.pieces.clear()
                new = set().union(*(c for c in cut if c))
            self._learn(new)
        known = self.pieces
        return [(b"".join([known[p] for p in c]) if c else self._library(t)) + end for t, c in zip(texts, cut)]


def public_pattern() -> str:
    """How byte-level tokenizers split a text before the merges. Fixed value."""
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoder(path: str) -> ByteBpe:
    return worker_model(("byte_bpe", path), lambda: ByteBpe(path))


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def write_token_files(docs: DataFrame, folder: str, path: str, end: int = 0) -> DataFrame:
    """Encode docs(doc_id, text) with the tokenizers file at path and write shards below folder.

    Returns the manifest. One shuffle brings the texts into ascending order of doc_id; a null text is
    empty, null doc_ids come first; rows with equal doc_id come in the order of their texts' hash. Equal
    rows, however many, are told apart by their place in the input, so no range is bound to one task.
    """

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        coder, name = _encoder(path), f"shard-{part:06d}-{uuid.uuid4().hex}"
        tail = coder.bytes([end])
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        ids = None
        counts, docs_seen, n_null = [], [], 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(keys), 512):
                coded = coder.encode([t or "" for t in texts.slice(at, 512).to_pylist()], tail)
                if ids is None:
                    ids = fs.open_output_stream(f"{base}/{name}.ids")
                ids.write(b"".join(coded))
                counts += [len(c) // coder.width for c in coded]
            n_null += keys.null_count
            docs_seen.append(keys.fill_null(0).to_numpy())
        if ids is None:
            return
        ids.close()
        seen = np.concatenate(docs_seen).astype("<i8")
        offsets = np.concatenate(([0], np.cumsum(counts))).astype("<i8")
        for kind, data in (("off", offsets), ("doc", seen)):
            with fs.open_output_stream(f"{base}/{name}.{kind}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": [name], "n_null": [n_null], "n_docs": [len(seen)], "n_tokens": [int(offsets[-1])], "width": pa.array([coder.width], pa.int32())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("place").asc()]
    manifest = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, read back from them.

    start counts the ids of all documents before; ids_crc32 is the CRC-32 of the ids as little-endian
    unsigned 32-bit integers.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = based.repartition(shards, F.col("shard")).select("shard", "base", "n_null", "n_docs", "n_tokens", "width")

    def run(batches):
        fs, base = _open(folder)

        def load(name, dtype):
            file = f"{base}/{name}"
            if isinstance(fs, pyarrow.fs.LocalFileSystem):
                return np.memmap(file, dtype, "r") if fs.get_file_info(file).size else np.empty(0, dtype)
            with fs.open_input_file(file) as f:
                return np.frombuffer(f.read(), dtype)

        for batch in batches:
            for r in batch.to_pylist():
                ids, off, doc = load(r["shard"] + ".ids", f"<u{r['width']}"), load(r["shard"] + ".off", "<i8"), load(r["shard"] + ".doc", "<i8")
                if len(off) != r["n_docs"] + 1 or len(doc) != r["n_docs"] or len(ids) != r["n_tokens"] or off[-1] != len(ids):
                    raise OSError(f"{r['shard']} is damaged")
                for a in range(0, len(doc), 4096):
                    b = min(a + 4096, len(doc))
                    crc = [zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    null = np.arange(a, b) < r["n_null"]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[a:b], mask=null), pa.array(r["base"] + off[a:b]), pa.array(np.diff(off[a : b + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    folder = work_dir(docs.sparkSession, "tokens")
    write_token_files(docs, folder, path, end)
    return read_token_files(docs.sparkSession, folder)

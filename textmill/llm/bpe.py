"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word, BPE's result ends in one certain token. It is the one among the vocabulary's
tokens that end there whose pair with the last token of the remaining, shorter prefix is left as it is by
the merges. An automaton over the whole vocabulary lists the tokens that end at a place (Aho-Corasick's,
whose suffix links do here what a suffix automaton's do). Each prefix keeps its token; following the
back-pointers from the word's end gives BPE's exact ids.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import Remembered, worker_model

#: In texts of these characters only, Python's lower() and split() do what the tokenizer's normalizer does.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡-¬®-įı-ž–-…]*").fullmatch


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.alphabet = byte_alphabet()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        # rank of the merge that makes a token, and its halves; single symbols have rank -1
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair_rank[x, y] = r
            self.rank[z], self.halves[z] = r, (x, y)
        self._fits: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        whole: set[int] = set()
        for token in sorted(self.ids.values(), key=lambda t: self.rank.get(t, -1)):
            if token not in self.halves:
                if len(self._symbols(self.tokens[token])) != 1:
                    continue
            elif not (set(self.halves[token]) <= whole and self._fit(*self.halves[token], below=self.rank[token])):
                continue  # BPE never yields this token
            whole.add(token)
            s = self._symbols(self.tokens[token])
            self._automaton.add_word(s, (len(s), token))
        self._automaton.make_automaton()
        self.pieces = Remembered(self._piece, 200_000, 200_000)
        self.tokenizer = None
        self.path = path

    def _symbols(self, token: str) -> str:
        """The token as one character for each symbol; a word's last symbol has a character of its own."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(0xF0000 + ord(token[-1]))
        return token

    def _fit(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging the symbols of both tokens leaves just the two (before the merge `below`).

        Undo the merges on either side of the border from the last to the first, and look whether the
        two pieces that then meet would have been merged earlier than what undid them.
        """
        limit = len(self.pair_rank) if below is None else below
        while True:
            met = self.pair_rank.get((left, right))
            if met is not None and met < limit:
                return False
            rl, rr = self.rank.get(left, -1), self.rank.get(right, -1)
            if rl < 0 and rr < 0:
                return True
            # the later merge is undone first; of equal merges the left one was done first
            if rl > rr:
                limit, left = rl, self.halves[left][1]
            else:
                limit, right = rr + 1, self.halves[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word given in byte characters.

        size[e] and last[e] hold length and id of the unique last token of the prefix that ends at e.
        """
        n = len(word)
        size, last, known = [0] * (n + 1), [0] * (n + 1), self._fits
        for at, (k, token) in self._automaton.iter(word[:-1] + chr(0xF0000 + ord(word[-1])) if self.end else word):
            end = at + 1
            if size[end]:
                continue
            start = end - k
            if start:
                if not size[start]:
                    continue
                pair = (last[start], token)
                fit = known.get(pair)
                if fit is None:
                    if len(known) > 300_000:
                        known.clear()
                    fit = known[pair] = self._fit(*pair)
                if not fit:
                    continue
            size[end], last[end] = k, token
        out, end = [], n
        while end:
            if not size[end]:
                raise ValueError(f"no token ends at {end} of {word!r}")
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def _pieces(self, text: str):
        """Words of a text in byte characters; special tokens as ids."""
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                if self.tokenizer is None:
                    from tokenizers import Tokenizer

                    self.tokenizer = Tokenizer.from_file(self.path)
                normal = self.tokenizer.normalizer.normalize_str(part)
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    yield word

    def encode(self, text: str) -> list[int]:
        out = []
        for p in self._pieces(text):
            out += [p] if isinstance(p, int) else self.encode_word(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens joined by a space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def strings(self, ids: list[int]) -> str:
        return " ".join(map(str, ids)) + "\0" + " ".join([self.tokens[i] for i in ids])

    def _piece(self, piece: str) -> str:
        """strings() of a blank-separated piece of lower-case text."""
        words = self.pattern.findall(piece)
        if words == [piece]:
            return self.strings(self.encode_word(piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))))
        parts = "\0".join([self.pieces[w] for w in words]).split("\0")
        return " ".join(parts[::2]) + "\0" + " ".join(parts[1::2])

    def joined(self, text: str) -> tuple[str, str]:
        """(ids joined by spaces, decoded text)."""
        if _PLAIN(text) and (self.split_special is None or "<|" not in text):
            found = map(self.pieces.__getitem__, text.lower().split())
        else:
            found = (self.strings([p] if isinstance(p, int) else self.encode_word(p)) for p in self._pieces(text))
        parts = "\0".join(found).split("\0")
        return " ".join(parts[::2]), " ".join(parts[1::2])


def _model(path: str) -> WordBpe:
    return worker_model(("word_bpe", path), lambda: WordBpe(path))


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs(doc_id, text).

    Ids are those of the tokenizers library for the file at path with add_special_tokens=False and no
    truncation or padding; special tokens' strings in a text become their ids. A null text is empty
    and has no tokens. The work is narrow: no shuffle. The path must exist on every executor.
    """

    def run(batches):
        model = _model(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids, decoded = model.joined(text.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) with the ids themselves."""

    def run(batches):
        model = _model(path)
        for batch in batches:
            ids = [model.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")

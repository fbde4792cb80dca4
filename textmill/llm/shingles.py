"""Word shingles of whole Arrow batches with numpy: no Python object per word.

Words are the runs of bytes other than space and 0x09-0x0D of the UTF-8 text, A-Z lower-cased. A
word's value is a polynomial over its bytes modulo 2**64, taken from one running sum; that of a word
of more than LONG bytes is its BLAKE2b digest, because such polynomials have known collisions between
long words of a certain build (from some 1,000 bytes on). A shingle's value mixes the values of its words.
Equal shingles have equal values; two different ones share a 64-bit value by chance only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the temporary arrays to a few tens of MB.
CHUNK = 1 << 20
WIDTH = 5
#: Words of more bytes have a digest as their value.
LONG = 32
_BASE = np.uint64(0x9E3779B97F4A7C0B)  # odd and 3 modulo 4
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_STEP = mix(np.arange(901, 901 + WIDTH, dtype=np.uint64)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, key: str, n: int) -> np.ndarray:
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        out[0] = 1
        _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key][:n]


def _chunk_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle values of each text; data holds the texts back to back."""
    docs = len(offsets) - 1
    n = len(data)
    empty = np.empty(0, np.uint64)
    if n == 0:
        return [empty] * docs
    word = ~_GAP[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(word & ~before)
    if len(starts) == 0:
        return [empty] * docs
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_table(_BASE, "up", n), out=total[1:], dtype=np.uint64)
    words = mix((total[ends] - total[starts]) * _power_table(_INVERSE, "down", n)[starts])
    for k in np.flatnonzero(ends - starts > LONG):
        words[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes().lower(), digest_size=8).digest(), "little")
    at = np.searchsorted(starts, offsets)  # words before each text
    if len(words) >= WIDTH:
        spans = sum(words[k : len(words) - WIDTH + 1 + k] * _STEP[k] for k in range(WIDTH))
        spans = mix(spans)
    else:
        spans = empty
    out = []
    for i in range(docs):
        a, b = at[i], at[i + 1]
        if b - a >= WIDTH:
            s = np.sort(spans[a : b - WIDTH + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            part = (words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([part], np.uint64)))
        else:
            out.append(empty)
    return out


def text_sets(texts: pa.Array):
    """Yields the sorted distinct shingle values of each text of an Arrow string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    nulls = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        for k, s in enumerate(_chunk_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
            yield np.empty(0, np.uint64) if nulls is not None and nulls[i + k] else s
        i = j

"""Vectorised word hashing over Arrow string columns.

The Python side of an operator receives Arrow batches.  The functions here hash every word of a
batch with a handful of numpy passes over the raw UTF-8 buffer, so that no Python object is made
per word.

A *word* is a maximal run of ASCII letters and digits or of non-ASCII characters; everything else
(white space, ASCII punctuation, control characters) separates words.  Words are compared without
case: every character whose lower-case form has as many bytes is folded, so that byte offsets
stay those of the given text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Arrays of a chunk take some 80 times its bytes in a worker, at most: workers count as executor memory.
CHUNK_BYTES = 1 << 18

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FOLD_ASCII = np.arange(256, dtype=np.uint8)
_FOLD_ASCII[65:91] += 32


def _fold_table() -> np.ndarray:
    table = np.arange(1 << 16, dtype=np.uint16)
    for cp in (*range(0x80, 0xD800), *range(0xE000, 1 << 16)):
        low = chr(cp).lower()
        if len(low) == 1 and len(low.encode()) == len(chr(cp).encode()):
            table[cp] = ord(low)
    return table


_fold: dict[str, np.ndarray] = {}


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, byte for byte."""
    out = _FOLD_ASCII[data]
    if len(data) and data.max() >= 0xC3:
        if "table" not in _fold:
            _fold["table"] = _fold_table()
        table = _fold["table"]
        i = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        i = i[i + 1 < len(data)]
        cp = table[((data[i] & 0x1F).astype(np.uint16) << 6) | (data[i + 1] & 0x3F)]
        out[i], out[i + 1] = 0xC0 | (cp >> 6), 0x80 | (cp & 0x3F)
        i = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
        i = i[i + 2 < len(data)]
        if len(i):
            b = [data[i + j].astype(np.uint16) & (0x0F if j == 0 else 0x3F) for j in range(3)]
            cp = table[(b[0] << 12) | (b[1] << 6) | b[2]]
            out[i], out[i + 1], out[i + 2] = 0xE0 | (cp >> 12), 0x80 | ((cp >> 6) & 0x3F), 0x80 | (cp & 0x3F)
    return out


def char_offsets(data: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte, for every byte and the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for name, base in (("up", _MULT), ("down", _INV)):
            table = np.empty(size, np.uint64)
            table[0] = 1
            table[1:] = base
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of consecutive texts: hash, byte range in ``data``, and where each text's words lie."""

    first: int  # index in the batch of the first text
    data: np.ndarray  # bytes of all texts of the chunk
    hash: np.ndarray  # uint64 per word
    start: np.ndarray  # first byte of each word in data
    end: np.ndarray  # byte after each word in data
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i + 1]
    offsets: np.ndarray  # text i has the bytes offsets[i]:offsets[i + 1]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and the bounds of each text's runs.

        A text of fewer than k words, but at least one, has a single run of all its words."""
        n = np.diff(self.bounds)
        out = np.maximum(n - k + 1, (n > 0).astype(n.dtype))
        bounds = np.concatenate([[0], np.cumsum(out)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.bounds[:-1], out)
        h = self.hash * _STEP[0]
        acc = h[at] if len(at) else h[:0]
        last = np.repeat(self.bounds[1:], out)
        for j in range(1, k):
            nxt = at + j
            ok = nxt < last
            term = mix(self.hash[np.where(ok, nxt, 0)] ^ _STEP[j]) * _STEP[j] if len(at) else h[:0]
            acc = acc + np.where(ok, term, np.uint64(0))
        return mix(acc), bounds


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n, bufs = len(column), column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def words(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a column of texts, in chunks of whole texts of about chunk_bytes."""
    data, offsets = string_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, "right")) - 1)
        yield _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def _words(data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word ends where its text ends, also if the next text begins with a letter
    cuts = offsets[1:-1]
    if len(cuts) and len(data):
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[fold(data)] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Words(first, data, h, start, end, np.searchsorted(start, offsets, "left"), offsets)

"""Characters of Arrow string columns as numpy arrays, and edit distance by bit-parallel search."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np
import pyarrow as pa


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code point, byte place, row) of every character, and the bytes of the column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first, follow = data[lead].astype(np.uint32), np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    cp = first.copy()
    for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        i = np.flatnonzero((first >= low) & (first < high))
        value = first[i] & keep
        for k in range(1, more + 1):
            value = value << 6 | follow[lead[i] + k] & 0x3F
        cp[i] = value
    row = np.searchsorted(offsets - offsets[0], lead, "right") - 1
    return cp, lead, row, data


#: Shorter sequences are compared bit by bit at once.
_SHORT = 64


def _numbers(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences with equal elements as equal numbers."""
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    of: dict[Hashable, int] = {}
    return tuple(np.fromiter((of.setdefault(x, len(of)) for x in y), np.uint32, len(y)) for y in (a, b))


def _met(a: np.ndarray, b: np.ndarray) -> int | None:
    """The distance of a and the no shorter b, where bounds that take one pass over both meet.

    No fewer edits do than there are elements that only one of the two has, counted as often as they occur. No
    more are needed than elements differ in place, if both are as long; if all of a occurs in b in its order, as
    many as b is longer."""
    if len(a) == len(b):
        most = int(np.count_nonzero(a != b))
        values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        surplus = np.bincount(place[: len(a)], minlength=len(values)) - np.bincount(place[len(a) :], minlength=len(values))
        return most if int(surplus[surplus > 0].sum()) == most else None
    rest = iter(b.tolist())
    return len(b) - len(a) if all(x in rest for x in a.tolist()) else None


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two strings or lists: of long ones by bounds, where they meet; else a column of the
    matrix at a time as the bits of one integer (Myers, 1999, in the form of Hyyrö, 2003)."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(a) > _SHORT:
        x, y = _numbers(a, b)
        other = np.flatnonzero(x != y[: len(x)])
        head = int(other[0]) if len(other) else len(x)
        other = np.flatnonzero(x[head:][::-1] != y[head:][::-1][: len(x) - head])
        tail = int(other[0]) if len(other) else len(x) - head
        x, y, a, b = (z[head : len(z) - tail] for z in (x, y, a, b))
        if (found := _met(x, y)) is not None:
            return found
    if len(a) > len(b):
        a, b = b, a
    head, most = 0, len(a)
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(a):
        return len(b)
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    plus, minus = every, 0
    for x in b:
        equal = places.get(x, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        more, less = minus | every & ~(across | plus), plus & across
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more, less = more << 1 | 1, less << 1
        plus, minus = (less | ~(down | more)) & every, more & down & every
    return score

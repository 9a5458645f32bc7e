"""Substring dedup: MinHash banding over paragraphs whose place follows from their content.

Passages that documents share rarely are lines of their own, so a *paragraph* here is a run of 24
words that begins at an anchor, and anchors are chosen by winnowing (Schleimer et al., 2003): of every
26 neighbouring word trigrams the least by hash.  A passage of 50 words thus has the same paragraph
in every document that holds it, wherever it begins.

Paragraphs are sets of word pairs.  Bands of 4 MinHash values are tuned for recall: as many as it takes
for two paragraphs that just reach the threshold to collide with a probability of 0.95.  A Jaccard
similarity of 0.7 means 19 of 23 pairs, which is what two edited words leave; that gives 11 bands and a
probability of 0.955, and of 0.9995 for one edited word.  Paragraphs that collide in a band form a star around the first of them;
pairs within one document do not count.  The first of a star is compared with all others by exact
Jaccard, then the first of those that it isn't similar to with all others, and so on.  Similar
paragraphs, and equal ones, are clustered by connected components, and all of a cluster goes but what
its least document has.

A paragraph is only where a repetition is looked for; what goes is the whole *stretch* that a document
has in common with an earlier one.  Where a run of equal paragraphs begins and ends, the text is
followed word by word along the document before it that has the paragraph too, and every edited
paragraph is followed in both directions along the one it is similar to.  A stretch passes over one or
two edited words (replaced, added or left out) where the 4 words after them are equal again, and counts
from 20 words on.  The next anchor of an equal stretch always lies within the words that are followed
(48 beyond a paragraph); an edited one may be cut off where more than that lies between two common
paragraphs.  Up to 25 words at either end may stay where only a document further back has them too.

Defined cases: rows with a null doc_id or a null text, and texts of fewer than 24 words, have no
paragraphs and lose nothing.  Repeats within one document stay.  Rows that share a doc_id are one
document.  Other columns, of whatever name, are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .jaccard import _usable
from .runtime import Packer, discard, part_of, partitions, release, unpack, written
from .textvec import Words, char_offsets, mix, words

PARAGRAPH = 24
WINNOW = 26
ROWS = 4
RECALL = 0.95
THRESHOLD = 0.7
#: Words that are followed beyond a paragraph; words of the shortest stretch; equal words after an edit.
CONTEXT = 48
SHORTEST = 20
REJOIN = 4
#: (words of this text, words of the other) that an edit may take.
_EDITS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2))

#: A paragraph in a band (key: 48 bits of the band, 16 of the content) or by its content (key).
_PLACE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("size", "<u4")])
_BAND_BITS = 16
#: Bands are grouped in so many pieces, by the first bits of their key.
_PIECE_BITS = 3
_TOP = np.uint64((1 << 64) - 1)
#: What is followed: an edited paragraph with all around it, or the words before or after an equal one.
_NEAR, _BEFORE, _AFTER = 0, 1, 2


def tuned(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of so many rows in which paragraphs at the threshold collide with that probability."""
    n = PARAGRAPH - 1
    common = np.ceil(2 * n * threshold / (1 + threshold) - 1e-9)
    missed = 1 - (common / (2 * n - common)) ** rows
    return int(np.ceil(np.log(1 - recall) / np.log(missed))) if missed > 0 else 1


def _seed(i: int) -> np.uint64:
    return mix(np.array([i + 1], np.uint64))[0] | np.uint64(1)


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op over every run of w values, by doubling."""
    length = 1
    while length * 2 <= w:
        x = op(x[:-length], x[length:])
        length *= 2
    return op(x[: len(x) - (w - length)], x[w - length :]) if w > length else x


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every paragraph of a chunk: anchors that have 24 words after them."""
    s, b = w.shingles(3)
    texts, n = len(b) - 1, np.diff(b)
    pad = WINNOW - 1
    at = np.arange(len(s)) + np.repeat((2 * np.arange(texts) + 1) * pad, n)
    line = np.full(len(s) + 2 * texts * pad, _TOP)
    line[at] = s
    if len(line) < 2 * WINNOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding(np.minimum, line, WINNOW)
    least[least == _TOP] = 0
    most = sliding(np.maximum, least, WINNOW)
    # the runs that hold position i begin at i - 25 ... i, and every text has 25 fillers before it
    chosen = np.flatnonzero(s == most[at - pad])
    text = np.repeat(np.arange(texts), n)[chosen]
    word = chosen - b[text] + w.bounds[text]
    fits = word + PARAGRAPH <= w.bounds[text + 1]
    return text[fits], word[fits]


def _pair_hashes(w: Words) -> np.ndarray:
    """Hash of each word with its successor in the chunk."""
    h = w.hash
    return mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + mix(h[1:] ^ np.uint64(0xA0761D6478BD642F))) if len(h) > 1 else h[:0]


def _content(w: Words, first: np.ndarray) -> np.ndarray:
    """64-bit identity of the 24 words from each given word on."""
    acc = np.zeros(len(first), np.uint64)
    for j in range(PARAGRAPH):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + w.hash[first + j]
        acc ^= acc >> np.uint64(29)
    return mix(acc).view(np.int64)


def _bands(w: Words, first: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Key of each paragraph in each band, without the lowest bits: bands that fall together only add
    candidates."""
    pairs, out = _pair_hashes(w), np.empty((len(first), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(first), band + 1, np.uint64)
        for r in range(rows):
            least = sliding(np.minimum, pairs * _seed(band * rows + r), PARAGRAPH - 1)
            key = mix(key ^ least[first]) * np.uint64(0x9FB21C651E98DF25)
        out[:, band] = key
    return out & ~np.uint64((1 << _BAND_BITS) - 1)


def _found(column: pa.Array) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    for w in words(column):
        text, first = paragraphs(w)
        if len(first):
            yield w, text, first, _content(w, first)


def _around(w: Words, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (0: none) and outer ends, in characters from the paragraph's start, of the words before each
    given one, backwards, and of those from it on; after these ends, where its next two words begin."""
    step = np.r_[-1 - np.arange(CONTEXT), np.arange(PARAGRAPH + CONTEXT)]
    at = first[:, None] + step
    inside = (at >= w.bounds[text][:, None]) & (at < w.bounds[text + 1][:, None])
    at = np.where(inside, at, first[:, None])
    hashes = np.where(inside, (w.hash >> np.uint64(32)).astype(np.uint32)[at] | np.uint32(1), np.uint32(0))
    chars = char_offsets(w.data)
    begin = chars[w.start[first]][:, None]
    edge = np.where(step < 0, begin - chars[w.start[at]], chars[w.end[at]] - begin)
    second = chars[w.start[at[:, CONTEXT + 1 : CONTEXT + 3]]] - begin
    return hashes, np.hstack([edge, second]).astype(np.uint32)


def _follow(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each line of a that the line of b has as well, edits included, and how many of them are
    edited ones at its begin."""
    width = a.shape[1]
    pad = np.zeros((len(a), 2 + REJOIN), np.uint32)
    a, b = np.hstack([a, pad]), np.hstack([b, pad])
    x, y, lead, live = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        word = a[live, x[live]]
        same = (word != 0) & (word == b[live, y[live]])
        on, stuck = live[same], live[~same]
        x[on] += 1
        y[on] += 1
        on = [on]
        for dx, dy in _EDITS:
            good = stuck
            for k in range(REJOIN):
                word = a[good, x[good] + dx + k]
                good = good[(word != 0) & (word == b[good, y[good] + dy + k])]
            lead[good[x[good] == 0]] = dx
            x[good] += dx + REJOIN
            y[good] += dy + REJOIN
            on.append(good)
            stuck = np.setdiff1d(stuck, good, assume_unique=True)
        live = np.concatenate(on)
        live = live[(x[live] < width) & (y[live] < width)]
    return x, lead


def equal_places(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Of rows with the content as key, those whose content has several places: unit is the first of
    them by document and place, prev the last one in an earlier document (at -1: there is none)."""
    key = np.sort(rows["key"])
    several = np.unique(key[1:][key[1:] == key[:-1]])
    i = np.searchsorted(several, rows["key"])
    i[i == len(several)] = 0
    rows = rows[several[i] == rows["key"]] if len(several) else rows[:0]
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["key"]))]
    other = np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["doc"][1:] != rows["doc"][:-1])][: len(rows)]
    rows = rows[other | np.r_[True, rows["at"][1:] != rows["at"][:-1]][: len(rows)]]
    head = np.r_[True, rows["key"][1:] != rows["key"][:-1]][: len(rows)]
    other = head | np.r_[True, rows["doc"][1:] != rows["doc"][:-1]][: len(rows)]
    alone = head & np.r_[head[1:], True][: len(rows)]
    row = np.arange(len(rows))
    unit = np.maximum.accumulate(np.where(head, row, 0))
    prev = np.maximum.accumulate(np.where(other, row, 0)) - 1
    at, doc = rows["at"].astype(np.int64), rows["doc"]
    none = prev < unit
    prev = np.maximum(prev, 0)
    out = {
        "unit_doc": doc[unit], "unit_at": at[unit], "prev_doc": doc[prev], "prev_at": np.where(none, -1, at[prev]), "doc_id": doc, "at": at, "end": at + rows["size"],
    }
    return {name: x[~alone] for name, x in out.items()}


def band_stars(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Of rows with bands as key: unit, the first paragraph of each band that holds several contents,
    and doc_id and at of each other content's first place, if that is in another document."""
    # a piece of the bands at a time: a worker's copies of all rows would be several times the group
    piece = (rows["key"] >> np.uint64(64 - _PIECE_BITS)).astype(np.uint8)
    found = [_stars_of_bands(rows[piece == k]) for k in range(1 << _PIECE_BITS)]
    unit_doc, unit_at, doc, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, doc, unit_at, unit_doc))
    unit_doc, unit_at, doc, at = (x[order] for x in (unit_doc, unit_at, doc, at))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (unit_doc[1:] != unit_doc[:-1]) | (unit_at[1:] != unit_at[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    return {"unit_doc": unit_doc[fresh], "unit_at": unit_at[fresh], "doc_id": doc[fresh], "at": at[fresh]}


def _stars_of_bands(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(unit_doc, unit_at, doc_id, at), with repeats."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    band = rows["key"] >> np.uint64(_BAND_BITS)
    same = np.r_[False, band[1:] == band[:-1]][: len(rows)]
    rows = rows[same | np.r_[same[1:], False][: len(rows)]]
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["key"]))]
    rows = rows[np.r_[True, rows["key"][1:] != rows["key"][:-1]][: len(rows)]]
    band = rows["key"] >> np.uint64(_BAND_BITS)
    order = np.lexsort((rows["at"], rows["doc"], band))
    rows, band = rows[order], band[order]
    head = np.maximum.accumulate(np.where(np.r_[True, band[1:] != band[:-1]][: len(rows)], np.arange(len(rows)), 0))
    keep = rows["doc"][head] != rows["doc"]
    hub, rows = rows[head[keep]], rows[keep]
    return hub["doc"], hub["at"].astype(np.int64), rows["doc"], rows["at"].astype(np.int64)


def _pairs_of(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word pairs of each paragraph in order, with 0 for repeated ones, and the number of distinct ones."""
    word = line[:, CONTEXT : CONTEXT + PARAGRAPH].astype(np.uint64)
    pairs = np.sort(word[:, :-1] << np.uint64(32) | word[:, 1:], axis=1)
    pairs[:, 1:][pairs[:, 1:] == pairs[:, :-1]] = 0
    return pairs, (pairs > 0).sum(axis=1)


def _similar(pairs: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    good = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        both = np.sort(np.hstack([pairs[a], pairs[b]]), axis=1)
        common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(axis=1)
        good[k : k + (1 << 14)] = common >= t * (n[a] + n[b] - common) - 1e-9
    return good


def _prefix_index(star: np.ndarray, pairs: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, bounds, rows): codes of the rarest word pairs of each row (-1: none), so many that of two
    rows of a star that reach t both have one in common; rows[bounds[c] : bounds[c + 1]] have code c."""
    row, col = np.nonzero(pairs)
    value = pairs[row, col]
    order = np.lexsort((value, star[row]))
    fresh = np.r_[True, (value[order][1:] != value[order][:-1]) | (star[row[order]][1:] != star[row[order]][:-1])][: len(order)]
    code = np.empty(len(row), np.int64)
    code[order] = np.cumsum(fresh) - 1
    count = np.bincount(code)
    order = np.lexsort((code, count[code], row))
    row, code = row[order], code[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (place < n[row] - np.ceil(t * n[row] - 1e-9) + 1) & (count[code] > 1)
    row, code, place = row[keep], code[keep], place[keep]
    prefix = np.full((len(star), int(place.max()) + 1 if len(place) else 1), -1)
    prefix[row, place] = code
    order = np.argsort(code, kind="stable")
    return prefix, np.searchsorted(code[order], np.arange(len(count) + 1)), row[order]


def similar_in_stars(star: np.ndarray, doc: np.ndarray, line: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of different documents' rows that reach t.  Rows are in order of star, the first first:
    it is compared with all others of its star, then the next one that is similar to none, and so on.  These
    later ones find the others by an index of the rarest word pairs, which loses none."""
    pairs, n = _pairs_of(line)
    row = np.arange(len(star))
    start = np.maximum.accumulate(np.where(np.r_[True, star[1:] != star[:-1]][: len(star)], row, 0))
    matched, out, index = np.zeros(len(star), bool), [], None
    a, b = start, row
    while len(a):
        ask = (a != b) & (doc[a] != doc[b])
        leaders, a, b = a, a[ask], b[ask]
        good = _similar(pairs, n, a, b, t)
        out.append((a[good], b[good]))
        matched[leaders] = True
        matched[b[good]] = True
        # the next leader of each star
        left = np.flatnonzero(~matched)
        if not len(left):
            break
        first = left[np.r_[True, start[left][1:] != start[left][:-1]]]
        prefix, bounds, rows = index = index or _prefix_index(star, pairs, n, t)
        leader, code = np.repeat(first, prefix.shape[1]), prefix[first].ravel()
        leader, code = leader[code >= 0], code[code >= 0]
        size = bounds[code + 1] - bounds[code]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[code], size)
        both = np.unique(np.repeat(leader, size) * len(star) + rows[at])
        # a leader without any other is done by itself
        a, b = np.r_[both // len(star), first], np.r_[both % len(star), first]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (row[:0], row[:0])


def _follow_all(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [_follow(a[k : k + (1 << 14)], b[k : k + (1 << 14)]) for k in range(0, len(a), 1 << 14)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_FOUND = "doc_id bigint, at bigint, end bigint, other_doc bigint, other_at bigint, first bigint, last bigint"


def _stretch_table(doc, at, end, other_doc, other_at, first, last) -> pa.Table:
    return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("doc_id", "at", "end", "other_doc", "other_at", "first", "last"), (doc, at, end, other_doc, other_at, first, last))})


def _ends(blobs: list, rows: np.ndarray, width: int) -> np.ndarray:
    """The character ends that lines carry, of the given rows."""
    flat = np.frombuffer(b"".join(blobs[i] for i in rows.tolist()), np.uint8).reshape(len(rows), 4, width)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(np.uint32)[:, :, 0].astype(np.int64)


def followed(group: pa.Table, t: float) -> pa.Table:
    """Of lines as stretches_of sends them: similar pairs with the later one's stretch (first, last), every
    paragraph of a pair once with itself as the other, and stretches beside equal paragraphs, without other."""
    kind, hub_doc, hub_at, doc, at, end = (group.column(c).to_numpy() for c in ("kind", "hub_doc", "hub_at", "doc_id", "at", "end"))
    lines, edges, out = group.column("line").to_pylist(), group.column("edges").to_pylist(), []
    for k in (_BEFORE, _AFTER):
        i = np.flatnonzero(kind == k)
        own = (doc[i] == hub_doc[i]) & (at[i] == hub_at[i])
        order = np.lexsort((at[i], doc[i], ~own, hub_at[i], hub_doc[i]))
        i, own = i[order], own[order]
        head = np.maximum.accumulate(np.where(np.r_[True, (hub_doc[i][1:] != hub_doc[i][:-1]) | (hub_at[i][1:] != hub_at[i][:-1])][: len(i)], np.arange(len(i)), 0))
        j = np.flatnonzero(~own & own[head])
        line = np.frombuffer(b"".join(lines[x] for x in i.tolist()), np.uint32).reshape(len(i), CONTEXT)
        n, _ = _follow_all(line[head[j]], line[j])
        one = i[head[j[n > 0]]]
        if len(one):
            far = _ends(edges, one, CONTEXT)[np.arange(len(one)), n[n > 0] - 1]
            first, last = (at[one] - far, end[one]) if k == _BEFORE else (at[one], at[one] + far)
            none = pa.nulls(len(one), pa.int64())
            out.append(_stretch_table(doc[one], at[one], none, none, none, first, last))
    i = np.flatnonzero(kind == _NEAR)
    i = i[np.lexsort((at[i], doc[i], hub_at[i], hub_doc[i]))]
    if len(i):
        star = np.cumsum(np.r_[True, (hub_doc[i][1:] != hub_doc[i][:-1]) | (hub_at[i][1:] != hub_at[i][:-1])])
        line = np.frombuffer(b"".join(lines[x] for x in i.tolist()), np.uint32).reshape(len(i), -1)
        a, b = similar_in_stars(star, doc[i], line, t)
        later = doc[i][b] > doc[i][a]
        a, b = np.where(later, a, b), np.where(later, b, a)
        back, ahead = np.ascontiguousarray(line[:, :CONTEXT]), np.ascontiguousarray(line[:, CONTEXT:])
        (n, _), (m, lead) = _follow_all(back[b], back[a]), _follow_all(ahead[b], ahead[a])
        n = np.where((n == 0) & (m > 0), -lead, n)
        long = (m > 0) & (n + m >= SHORTEST)
        a, b, n, m = i[a], i[b], np.where(long, n, 0), np.where(long, m, PARAGRAPH)
        if len(b):
            edge, row = _ends(edges, b, 2 * CONTEXT + PARAGRAPH + 2), np.arange(len(b))
            left = np.where(n > 0, edge[row, n - 1], np.where(n < 0, -edge[row, np.minimum(-3 - n, -1)], 0))
            right = edge[row, CONTEXT + m - 1]
            out.append(_stretch_table(doc[b], at[b], end[b], doc[a], at[a], at[b] - left, at[b] + right))
            # a paragraph may go by its cluster alone
            one = np.unique(a)
            none = pa.nulls(len(one), pa.int64())
            out.append(_stretch_table(doc[one], at[one], end[one], doc[one], at[one], none, none))
    release()
    return pa.concat_tables(out) if out else _stretch_table(*[pa.nulls(0, pa.int64())] * 7)


def places_of(texts: DataFrame, parts: int, bands: int) -> DataFrame:
    """Written table of the places of equal paragraphs (end is set) and of stars of bands (it is not)."""

    def scan(batches):
        by_band, by_content = Packer(parts, _PLACE, _BAND_BITS), Packer(parts, _PLACE, 0, parts)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for w, text, first, content in _found(batch.column("text")):
                chars = char_offsets(w.data)
                at = chars[w.start[first]] - chars[w.offsets[text]]
                size = chars[w.end[first + PARAGRAPH - 1]] - chars[w.start[first]]
                doc, content = ids[w.first + text], content.view(np.uint64)
                yield from by_content.add(content, doc=doc, at=at, size=size)
                keys = _bands(w, first, bands) | (content & np.uint64((1 << _BAND_BITS) - 1))[:, None]
                yield from by_band.add(keys.ravel(), doc=np.repeat(doc, bands), at=np.repeat(at, bands), size=0)
        yield from by_band.flush()
        yield from by_content.flush()
        release()

    names = ("unit_doc", "unit_at", "prev_doc", "prev_at", "doc_id", "at", "end")

    def lists(group: pa.Table) -> pa.Table:
        banded = group.column("part")[0].as_py() < parts
        rows = unpack(group.column("blob"), _PLACE)
        found = (band_stars if banded else equal_places)(rows)
        size = len(found["doc_id"])
        out = pa.table({c: pa.array(found[c], pa.int64()) if c in found else pa.nulls(size, pa.int64()) for c in names})
        del rows, found
        release()
        return out

    packed = texts.mapInArrow(scan, "part int, blob binary")
    return written(packed.groupBy("part").applyInArrow(lists, ", ".join(f"{c} bigint" for c in names)), "places")


def stretches_of(texts: DataFrame, equal: DataFrame, near: DataFrame, parts: int, t: float) -> DataFrame:
    """What followed() gives, as a written table."""
    own = Window.partitionBy("doc_id").orderBy("at", "end")
    repeats = equal.where("prev_at >= 0")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    left, right = F.coalesce(before < F.col("at"), F.lit(True)), F.coalesce(F.lead("at").over(own) > F.col("end"), F.lit(True))
    sides = F.filter(F.array(F.when(left, _BEFORE), F.when(right, _AFTER)), lambda k: k.isNotNull())
    edges = repeats.select("doc_id", "at", "prev_doc", "prev_at", sides.alias("kinds")).where("size(kinds) > 0").select("*", F.explode("kinds").alias("kind"))
    ask = F.struct(F.col("at").alias("at"), F.col("kind"), F.col("hub_doc"), F.col("hub_at"))
    mine = edges.select("doc_id", "at", "kind", F.col("doc_id").alias("hub_doc"), F.col("at").alias("hub_at"))
    theirs = edges.select(F.col("prev_doc").alias("doc_id"), F.col("prev_at").alias("at"), "kind", F.col("doc_id").alias("hub_doc"), F.col("at").alias("hub_at"))
    hubs = near.select(F.col("unit_doc").alias("doc_id"), F.col("unit_at").alias("at"), F.lit(_NEAR).alias("kind"), F.col("unit_doc").alias("hub_doc"), F.col("unit_at").alias("hub_at"))
    members = near.select("doc_id", "at", F.lit(_NEAR).alias("kind"), F.col("unit_doc").alias("hub_doc"), F.col("unit_at").alias("hub_at"))
    asked = mine.union(theirs).union(hubs).union(members).groupBy("doc_id").agg(F.collect_set(ask).alias("asked"))

    def contexts(batches):
        for batch in batches:
            ids, lists = batch.column("doc_id").to_numpy(), batch.column("asked")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at, kind, hub_doc, hub_at = (flat.field(c).to_numpy() for c in ("at", "kind", "hub_doc", "hub_at"))
            for w in words(batch.column("text")):
                i = np.arange(*np.searchsorted(owner, [w.first, w.first + len(w.bounds) - 1]))
                if not len(i) or not len(w.hash):
                    continue
                chars = char_offsets(w.data)
                text, begin = owner[i] - w.first, chars[w.start]
                place = chars[w.offsets[text]] + at[i]
                word = np.minimum(np.searchsorted(begin, place), len(begin) - 1)
                # rows that share a doc_id may have other paragraphs
                good = (begin[word] == place) & (word >= w.bounds[text]) & (word + PARAGRAPH <= w.bounds[text + 1])
                i, text, word = i[good], text[good], word[good]
                for k in range(0, len(i), 1 << 12):
                    s = slice(k, k + (1 << 12))
                    line, edge = _around(w, word[s], text[s])
                    yield _lines(i[s], ids[owner[i[s]]], at, kind, hub_doc, hub_at, line, edge, parts)
        release()

    schema = "part int, kind int, hub_doc bigint, hub_at bigint, doc_id bigint, at bigint, end bigint, line binary, edges binary"
    around = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(contexts, schema)
    return written(around.groupBy("part").applyInArrow(lambda group: followed(group, t), _FOUND), "stretches")


def _lines(i, doc, at, kind, hub_doc, hub_at, line, edge, parts: int) -> pa.RecordBatch:
    """Lines of the requests i: all words of edited paragraphs, else those of the side that is asked for.
    Ends go with the lines that may be cut."""
    at, kind, hub_doc, hub_at = at[i], kind[i], hub_doc[i], hub_at[i]
    end = at + edge[:, CONTEXT + PARAGRAPH - 1]
    side = {_NEAR: slice(None), _BEFORE: slice(0, CONTEXT), _AFTER: slice(CONTEXT + PARAGRAPH, 2 * CONTEXT + PARAGRAPH)}
    own = (doc == hub_doc) & (at == hub_at)
    blobs, ends = [None] * len(i), [None] * len(i)
    for k, s in side.items():
        rows = np.flatnonzero(kind == k)
        for r, x in zip(rows.tolist(), np.ascontiguousarray(line[rows, s])):
            blobs[r] = x.tobytes()
        rows = rows[~own[rows] if k == _NEAR else own[rows]]
        x = np.ascontiguousarray(edge[rows, s])
        planes = x.view(np.uint8).reshape(*x.shape, 4).transpose(0, 2, 1)
        for r, x in zip(rows.tolist(), planes):
            ends[r] = x.tobytes()
    part = part_of(mix(hub_doc.view(np.uint64)) ^ hub_at.astype(np.uint64), parts)
    columns = [pa.array(x) for x in (part, kind, hub_doc, hub_at, doc, at, end)]
    return pa.record_batch([*columns, pa.array(blobs, pa.binary()), pa.array(ends, pa.binary())], ["part", "kind", "hub_doc", "hub_at", "doc_id", "at", "end", "line", "edges"])


def repeated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Removals (doc_id, start, end, kept_doc_id, paragraphs): characters start to end (exclusive)
    of the document repeat what earlier documents hold; a span joins overlapping stretches,
    kept_doc_id is the least document of their clusters, and paragraphs says how many were joined."""
    parts, texts = partitions(docs.sparkSession, docs), _usable(docs)
    places = places_of(texts, parts, tuned(threshold))
    equal, near = places.where("end is not null"), places.where("end is null")
    found = stretches_of(texts, equal, near, parts, threshold)

    pairs = found.where("other_doc is not null and (other_doc <> doc_id or other_at <> at)")
    place = lambda doc, at: F.struct(F.col(doc).alias("doc"), F.col(at).alias("at"))
    linked = components(pairs.select(place("doc_id", "at").alias("a"), place("other_doc", "other_at").alias("b")), "clusters")
    root = linked.select(F.col("node.doc").alias("unit_doc"), F.col("node.at").alias("unit_at"), F.col("root.doc").alias("root"))

    kept = F.coalesce("root", "unit_doc")
    copies = equal.join(root, ["unit_doc", "unit_at"], "left").where(kept != F.col("doc_id")).select("doc_id", F.col("at").alias("start"), "end", kept.alias("kept"))
    # an edited paragraph goes by the stretches that it has, or whole if it is in its cluster by later ones alone
    node = found.where("other_doc is not null").groupBy(F.col("doc_id").alias("unit_doc"), F.col("at").alias("unit_at")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("end").alias("end"))
    edited = node.join(root, ["unit_doc", "unit_at"]).where("root <> unit_doc").select(
        F.col("unit_doc").alias("doc_id"), F.coalesce("first", "unit_at").alias("start"), F.coalesce("last", "end").alias("end"), F.col("root").alias("kept")
    )
    paragraphs = copies.union(edited).groupBy("doc_id", "start", "end").agg(F.min("kept").alias("kept"), F.lit(1).cast("bigint").alias("paragraphs"))
    # these begin or end with a paragraph that goes
    sides = found.where("other_doc is null").select("doc_id", F.col("first").alias("start"), F.col("last").alias("end"), F.lit(None).cast("bigint").alias("kept"), F.lit(0).cast("bigint").alias("paragraphs"))
    return _joined(paragraphs.union(sides))


def _joined(spans: DataFrame) -> DataFrame:
    own = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("span", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept").alias("kept_doc_id"), F.sum("paragraphs").alias("paragraphs")
    ).drop("span")


def without_repeats(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the repeated spans cut out of text, and n_chars following.  All rows stay, also those
    of which nothing is left; documents that lose nothing are returned as they are.  Columns may have
    any name."""
    names = docs.columns
    own = {name: f"c{i}" for i, name in enumerate(names)}
    rows = docs.toDF(*own.values())
    ident, text = F.col(own["doc_id"]), F.col(own["text"])
    spans = repeated(docs, threshold).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = rows.join(spans, ident.cast("bigint") == spans["doc_id"], "left")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.length(text).cast("bigint")))
    pieces = F.zip_with(begins, ends, lambda a, b: text.substr(a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int")))
    hit = F.col("spans").isNotNull()
    out = {name: F.col(c) for name, c in own.items()}
    out["text"] = F.when(hit, F.array_join(pieces, "")).otherwise(text)
    if "n_chars" in own:
        size = F.aggregate(pieces, F.lit(0), lambda n, x: n + F.length(x))
        out["n_chars"] = F.when(hit, size.cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*(x.alias(name) for name, x in out.items()))

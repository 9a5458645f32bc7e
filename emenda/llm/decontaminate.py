"""Benchmark decontamination with SimHash over item-sized windows.

A benchmark item of s words is compared with every window of s words of every document, and with the
whole text of a document that has fewer words.  Items and windows are weighted multisets of word pairs; a
pair weighs as much as it has letters.

* *Fingerprints.*  64-bit SimHash of the weighted pairs.  Windows take theirs from running sums.
* *Search.*  Fingerprints are cut into radius + 1 blocks; two within the radius agree in at least
  one block, so the index of the items' blocks misses none.
* *Verification.*  Candidates count if their exact weighted Jaccard similarity reaches ``threshold``.

A window can only reach the threshold if those of its pairs that occur in the benchmark weigh
threshold times as much as the lightest item of its size, so windows that don't are not
fingerprinted; that loses nothing.  SimHash is approximate: at a similarity of 0.7 a fingerprint lies
within the radius with a probability of about 0.93, at 0.8 of 0.99, and equal texts always do.

The benchmark is read in parts of about ``part_items`` items, each sent to all executors in its turn,
so what is broadcast at once is bounded whatever the benchmark's size; the documents are scanned once for
each part, so a benchmark of up to 100,000 items takes one scan.

Defined cases: documents with a null doc_id or a null text, and items with a null item_id, a null text
or no word, take no part.  Items of fewer than ``min_words`` words are too short for a similarity and
count where a document has them exactly; an item of one word is met by a document of that word alone.
Repeated item rows count once.  For every document and
item, the most similar window is given, of equals the first.  Other columns, of whatever name, are
ignored.  Empty tables give no rows.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import passed
from .textvec import Words, char_offsets, words

RADIUS = 17
THRESHOLD = 0.7
MIN_WORDS = 5
PART_ITEMS = 100_000

_TABLE = 1 << 20


def fingerprints(running: np.ndarray, first: np.ndarray, pairs: int) -> np.ndarray:
    """SimHash of the windows of ``pairs`` pairs that begin at first; running: sums by bit."""
    bits = running[first + pairs] > running[first]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def running_sums(pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Row i: for each bit, the weight of the first i pairs that have it less that of those that
    don't."""
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    out = np.zeros((len(pairs) + 1, 64), np.int64)
    np.cumsum((2 * bits - 1) * weights[:, None], axis=0, out=out[1:])
    return out


def pair_weights(w: Words, bounds: np.ndarray) -> np.ndarray:
    """Bytes of both words of each pair of w.shingles(2)."""
    size = w.end - w.start
    n = np.diff(w.bounds)
    out = np.diff(bounds)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - w.bounds[:-1], out)
    return size[at] + np.where(np.repeat(n, out) > 1, size[np.minimum(at + 1, len(size) - 1)], 0) if len(at) else np.zeros(0, np.int64)


def similarity(a: np.ndarray, aw: np.ndarray, b: np.ndarray, bw: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of pairs."""
    v, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(inv[: len(a)], aw, len(v))
    y = np.bincount(inv[len(a) :], bw, len(v))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Items by size, with the blocks of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str], radius: int, threshold: float, min_words: int = MIN_WORDS):
        self.radius = radius
        self.ids, self.pairs, self.weights, self.sizes, self.thresholds = [], [], [], [], []
        prints = []
        for w in words(pa.array(texts, pa.string())):
            s, b = w.shingles(2)
            weight = pair_weights(w, b)
            for i in range(len(b) - 1):
                size = int(w.bounds[i + 1] - w.bounds[i])
                if size:
                    p, v = s[b[i] : b[i + 1]], weight[b[i] : b[i + 1]]
                    self.ids.append(ids[w.first + i])
                    self.thresholds.append(threshold if size >= min_words else 1.0)
                    self.pairs.append(p)
                    self.weights.append(v)
                    self.sizes.append(size)
                    prints.append(fingerprints(running_sums(p, v), np.zeros(1, np.int64), len(p))[0])
        self.prints = np.array(prints, np.uint64)
        self.known = np.unique(np.concatenate(self.pairs)) if self.pairs else np.zeros(0, np.uint64)
        self.table = np.zeros(_TABLE, bool)
        self.table[(self.known & np.uint64(_TABLE - 1)).astype(np.int64)] = True
        cuts = np.round(np.linspace(0, 64, radius + 2)).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:])]
        # by the number of pairs of an item
        self.by_size: dict[int, dict] = {}
        length = np.array([len(p) for p in self.pairs], np.int64)
        for size in np.unique(length).tolist():
            items = np.flatnonzero(length == size)
            lists = []
            for shift, mask in self.blocks:
                value = self.prints[items] >> shift & mask
                order = np.argsort(value, kind="stable")
                lists.append((value[order], items[order]))
            self.by_size[size] = {"least": min(self.thresholds[i] * int(self.weights[i].sum()) for i in items) - 1e-9, "lists": lists}
        # sizes that differ by a quarter at most are looked for together at first
        self.bands: list[list[int]] = []
        for size in self.by_size:
            if self.bands and size <= 1.25 * self.bands[-1][0]:
                self.bands[-1].append(size)
            else:
                self.bands.append([size])

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        found = []
        for (shift, mask), (values, items) in zip(self.blocks, self.by_size[size]["lists"]):
            v = prints >> shift & mask
            lo, hi = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n = hi - lo
            win = np.repeat(np.arange(len(v)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(win * len(self.ids) + items[at])
        both = np.unique(np.concatenate(found))
        win, item = both // len(self.ids), both % len(self.ids)
        distance = np.bitwise_count(prints[win] ^ self.prints[item]).astype(np.int64)
        near = distance <= self.radius
        return win[near], item[near], distance[near]

    def known_pairs(self, s: np.ndarray) -> np.ndarray:
        hit = self.table[(s & np.uint64(_TABLE - 1)).astype(np.int64)]
        i = np.flatnonzero(hit)
        at = np.minimum(np.searchsorted(self.known, s[i]), len(self.known) - 1)
        hit[i] = self.known[at] == s[i]
        return hit

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item_id, first char, end char, distance, similarity) of the best window of each
        row and item."""
        if not self.ids:
            return
        for w in words(column):
            s, b = w.shingles(2)
            hit = self.known_pairs(s)
            weight = pair_weights(w, b)
            matched = np.zeros(len(s) + 1, np.int64)
            np.cumsum(np.where(hit, weight, 0), out=matched[1:])
            chars = None
            for t, found in self._best(s, weight, matched, b).items():
                for item, (sim, first, pairs, distance) in found.items():
                    chars = char_offsets(w.data) if chars is None else chars
                    a = w.bounds[t] + first - b[t]
                    z = min(a + pairs, w.bounds[t + 1] - 1)
                    base = chars[w.offsets[t]]
                    yield w.first + t, self.ids[item], int(chars[w.start[a]] - base), int(chars[w.end[z]] - base), distance, sim

    def _windows(self, matched: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(size, first pairs) of the windows whose known pairs weigh enough."""
        last = len(matched) - 1
        for band in self.bands:
            n = band[-1]
            least = min(self.by_size[size]["least"] for size in band)
            ahead = np.concatenate([matched[n:], np.full(min(n, last + 1), matched[-1])])[: last + 1]
            near = np.flatnonzero(ahead - matched >= least)
            if not len(near):
                continue
            end = b[np.searchsorted(b, near, "right").clip(max=len(b) - 1)]
            for size in band:
                fits = near[near + size <= end]
                first = fits[matched[fits + size] - matched[fits] >= self.by_size[size]["least"]]
                if len(first):
                    yield size, first

    def _best(self, pairs: np.ndarray, weight: np.ndarray, matched: np.ndarray, b: np.ndarray) -> dict[int, dict[int, tuple[float, int, int, int]]]:
        best: dict[int, dict[int, tuple[float, int, int, int]]] = {}

        def verify(text: int, f: int, n: int, item: int, distance: int) -> None:
            found = best.setdefault(text, {})
            sim = similarity(pairs[f : f + n], weight[f : f + n], self.pairs[item], self.weights[item])
            if sim >= self.thresholds[item] - 1e-12 and (item not in found or sim > found[item][0]):
                found[item] = (sim, f, n, distance)

        for size, first in self._windows(matched, b):
            # regions of neighbouring windows, so that sums are made where they are needed
            cuts = np.unique(np.r_[np.flatnonzero(np.r_[True, np.diff(first) > size, True]), np.arange(0, len(first), 4096)])
            prints = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                base, end = first[a], first[z - 1] + size
                prints.append(fingerprints(running_sums(pairs[base:end], weight[base:end]), first[a:z] - base, size))
            text = np.searchsorted(b, first, "right") - 1
            for win, item, distance in zip(*(x.tolist() for x in self.candidates(size, np.concatenate(prints)))):
                verify(int(text[win]), int(first[win]), size, item, distance)
        # texts that are shorter than an item are one window
        length, known = np.diff(b), matched[b[1:]] - matched[b[:-1]]
        for size, found in self.by_size.items():
            short = np.flatnonzero((length > 0) & (length < size) & (known >= found["least"]))
            prints = [fingerprints(running_sums(pairs[b[t] : b[t + 1]], weight[b[t] : b[t + 1]]), np.zeros(1, np.int64), int(length[t]))[0] for t in short.tolist()]
            if prints:
                for win, item, distance in zip(*(x.tolist() for x in self.candidates(size, np.array(prints, np.uint64)))):
                    verify(int(short[win]), int(b[short[win]]), int(length[short[win]]), item, distance)
        return best


def indexes(benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD, part_items: int = PART_ITEMS, min_words: int = MIN_WORDS) -> Iterator[Index]:
    """Indexes of the benchmark in parts of about part_items items."""
    items = (
        benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
        .where("item_id is not null and text is not null").distinct()
    )
    parts = -(-items.count() // part_items)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield Index([r.item_id for r in rows], [r.text for r in rows], radius, threshold, min_words)


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end, distance, similarity) of every document and item that it
    holds: the characters of the best window, the distance of the fingerprints, the similarity."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, start bigint, end bigint, distance bigint, similarity double"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")

    def part(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def search(batches):
            for batch in batches:
                rows = list(shared.value.search(batch.column("text")))
                if rows:
                    row, *cols = zip(*rows)
                    yield pa.record_batch(
                        [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.float64())],
                        ["doc_id", "item_id", "start", "end", "distance", "similarity"],
                    )

        return texts.mapInArrow(search, schema)

    found = [part(i) for i in indexes(benchmark, radius, threshold, min_words=min_words)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows with a null text stay."""
    spark = docs.sparkSession
    at = docs.columns.index("text")

    def part(rows: DataFrame, index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def keep(batches):
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[r[0] for r in shared.value.search(batch.column(at).cast(pa.string()))]] = False
                yield batch.filter(pa.array(good))

        return passed(rows, keep)

    return reduce(part, indexes(benchmark, radius, threshold, min_words=min_words), docs)

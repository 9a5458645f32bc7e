"""N-gram Jaccard join with set-relation skipping.

Every document is the set of its word n-grams, as 56-bit hashes.  All pairs of documents whose sets
have a Jaccard similarity of at least ``threshold`` are found exactly:

* *Order.*  N-grams are ordered from rare to common.  Document frequencies come from all documents,
  added up in a table of fixed size; any order gives right results, a better one shorter lists.  That
  table fills with the input, and then hides n-grams of a few hundred documents: these are counted one
  by one in a sample of the sets, and come last.
* *Index lists.*  Two sets that are similar enough share four n-grams (or, of small sets, all that
  they need) within prefixes that are as much longer.  Short lists of the prefix index count the
  n-grams that each pair shares.  Long lists are cut into blocks by size; within a block, entries
  whose position leaves too few n-grams to reach the overlap that even their best partner would
  need are skipped.  What remains of a block is recorded as a star around its least set, so a long
  list of n entries costs n.
* *Answers.*  The sets of a star are compared through their centre x.  A set's overlaps follow
  incrementally from those of x: |y & z| = |x| - |x-y| - |x-z| + |(x-y) & (x-z)| + |(y-x) & (z-x)|,
  so that highly similar sets cost as much as their differences.  A star whose members all belong
  to the star of its own centre's centre adds nothing and is skipped.  Where classes and numbers of
  links are asked for, pairs are counted block by block and never leave their task.

Documents with equal sets are one set throughout, so groups of copies cost no more than their rows.

Defined cases: rows with a null doc_id, a null text or a text without a word take no part.  Rows that
share a doc_id are one document.  A text of fewer than n words is one n-gram.  Other columns, of
whatever name, are ignored.  An empty table gives no rows.  Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import Packer, discard, part_of, partitions, release, unpack, written
from .textvec import mix, words

NGRAM = 3
THRESHOLD = 0.5

#: Counters of n-grams. They are shared by all n-grams, so the fewer they are the sooner a larger input hides
#: n-grams of some dozen documents, whose lists then give pairs of unlike documents.
_COUNTERS = 1 << 21
_BLOCKS = 16
_MASK = np.uint64((1 << 56) - 1)
_KEY = np.dtype([("key", "<u8")])
#: One of so many sets is a sample for frequent n-grams, which occur in so many of its sets at least;
#: so many of them at most, the most frequent, are told apart, by so many bits of their hash.
_SAMPLE = 8
_FREQUENT = 16
_MOST = 1 << 19
_SLOT_BITS = 23
_POSTING = np.dtype([("key", "<u8"), ("set", "<i8"), ("n", "<u4"), ("pos", "<u4")])
_DIRECT = 256
_SHARED = 4
#: Stars of so many members are compared set by set.
_FEW = 8


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct n-grams in order of hash) of every row with a word."""
    for w in words(column):
        s, b = w.shingles(n)
        s >>= np.uint64(8)
        for i in range(len(b) - 1):
            if b[i + 1] > b[i]:
                yield w.first + i, np.unique(s[b[i] : b[i + 1]])


def _set_id(x: np.ndarray) -> int:
    return int(np.add.reduce(mix(x)).astype(np.int64))


def _counter(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(35)).astype(np.int64)


def _usable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    )


def document_sets(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """Written table of one row per document (doc_id, set_id, n) and rows (block, counts) whose
    sums, decompressed, are the n-grams' document frequencies."""

    def scan(batches):
        counts = np.zeros(_COUNTERS, np.int32)
        for batch in batches:
            ids, rows, sets, sizes = batch.column("doc_id"), [], [], []
            for row, x in _sets(batch.column("text"), n):
                np.add.at(counts, _counter(x), 1)
                rows.append(row)
                sets.append(_set_id(x))
                sizes.append(len(x))
            none = pa.nulls(len(rows), pa.int32())
            yield pa.record_batch(
                [ids.take(pa.array(rows, pa.int64())), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), none, pa.nulls(len(rows), pa.binary())],
                ["doc_id", "set_id", "n", "block", "counts"],
            )
        release()
        if counts.any():
            blobs = [zlib.compress(b.tobytes(), 1) for b in np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(_BLOCKS, -1)]
            none = pa.nulls(_BLOCKS, pa.int64())
            yield pa.record_batch([none, none, none, pa.array(range(_BLOCKS), pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "set_id", "n", "block", "counts"])

    schema = "doc_id bigint, set_id bigint, n bigint, block int, counts binary"
    return written(_usable(docs).mapInArrow(scan, schema), "sets")


def _frequencies(table: DataFrame) -> np.ndarray:
    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_COUNTERS // _BLOCKS, np.uint32)
        for b in group.column("counts"):
            total += np.frombuffer(zlib.decompress(b.as_buffer()), np.uint16)
        return pa.table({"block": group.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = table.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    out = np.zeros((_BLOCKS, _COUNTERS // _BLOCKS), np.uint32)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()


def _ranks(counts: np.ndarray) -> np.ndarray:
    """High byte of an ordered n-gram, by counter: four steps for every doubling, under that of any frequent one."""
    return np.minimum(np.floor(4 * np.log2(counts + 1.0)), 127).astype(np.uint8)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(56 - _SLOT_BITS)).astype(np.int64)


def _late(docs: DataFrame, n: int) -> np.ndarray:
    """Rank of frequent n-grams by slot, over that of any counter; 0 of others."""
    parts = partitions(docs.sparkSession, docs)

    def keys(batches):
        pack = Packer(parts, _KEY)
        for batch in batches:
            for _, x in _sets(batch.column("text"), n):
                if _set_id(x) % _SAMPLE == 0:
                    yield from pack.add(x)
        yield from pack.flush()
        release()

    def frequent(group: pa.Table) -> pa.Table:
        key, count = np.unique(unpack(group.column("blob"), _KEY)["key"], return_counts=True)
        at = np.flatnonzero(count >= _FREQUENT)
        at = at[np.argsort(-count[at], kind="stable")[: max(1, _MOST // parts)]]
        rank = 128 + np.minimum(np.floor(4 * np.log2(count[at] + 1.0)), 127)
        release()
        return pa.table({"slot": pa.array(_slot(key[at]), pa.int32()), "rank": pa.array(rank, pa.int16())})

    found = _usable(docs).select("text").mapInArrow(keys, "part int, blob binary").groupBy("part").applyInArrow(frequent, "slot int, rank smallint").toArrow()
    out = np.zeros(1 << _SLOT_BITS, np.uint8)
    np.maximum.at(out, found.column("slot").to_numpy(), found.column("rank").to_numpy().astype(np.uint8))
    return out


def least_overlap(t: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap that sets of a and b elements need for a Jaccard similarity of t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def stars(key: np.ndarray, member: np.ndarray, n: np.ndarray, pos: np.ndarray, t: float, shared: int = 1, direct: int = _DIRECT) -> tuple[np.ndarray, ...]:
    """Edges (centre, member, seen, need, star) such that of two sets that reach t either a long list
    in which they meet gives them a common centre, by edges with star 1, or their own edge, with the
    lesser as its centre, has been seen as often as need says.  A centre is a member of its star."""
    order = np.lexsort((member, n, key))
    key, member, n, pos = key[order], member[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
    key, member, n, pos = key[fresh], member[fresh], n[fresh], pos[fresh]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    length = np.diff(cuts)
    hubs, members, needs, kinds = [], [], [], []
    slack = shared - 1
    # short lists: pair by pair
    of = np.repeat(length, length)
    small = np.flatnonzero((of > 1) & (of <= direct))
    k, m, z, p = key[small], member[small], n[small], pos[small]
    for d in range(1, direct):
        if len(k) <= d:
            break
        i = np.flatnonzero(k[d:] == k[:-d])
        if not len(i):
            break
        j = i + d
        need = least_overlap(t, z[i], z[j])
        ok = (z[i] >= t * z[j] - 1e-9) & (np.minimum(z[i] - p[i], z[j] - p[j]) >= need - slack)
        i, j = i[ok], j[ok]
        hubs.append(np.minimum(m[i], m[j]))
        members.append(np.maximum(m[i], m[j]))
        needs.append(np.minimum(need[ok], shared).astype(np.int64))
        kinds.append(np.zeros(len(i), np.int64))
    # long lists: blocks of two neighbouring size classes
    for c in np.flatnonzero(length > direct):
        s = slice(cuts[c], cuts[c + 1])
        m, z, p = member[s], n[s], pos[s]
        band = np.floor(np.log(z) / -np.log(t) + 1e-9).astype(np.int64) if t < 1 else z
        for b in np.unique(band):
            i = np.flatnonzero((band == b) | (band == b + 1))
            if b - 1 in band and not (band[i] == b + 1).any():
                continue  # all of it lies in the block before
            i = i[z[i] - p[i] >= least_overlap(t, z[i], np.maximum(z[i].min(), np.ceil(t * z[i] - 1e-9))) - slack]
            if len(i) > 1:
                hubs.append(np.full(len(i) - 1, m[i].min()))
                members.append(np.delete(m[i], m[i].argmin()))
                needs.append(np.ones(len(i) - 1, np.int64))
                kinds.append(np.ones(len(i) - 1, np.int64))
    if not hubs:
        return (np.zeros(0, np.int64),) * 5
    hub, mem, need, star = (np.concatenate(x) for x in (hubs, members, needs, kinds))
    order = np.lexsort((mem, hub))
    hub, mem, need, star = hub[order], mem[order], need[order], star[order]
    if not len(hub):
        return hub, mem, need, need, star
    first = np.flatnonzero(np.r_[True, (hub[1:] != hub[:-1]) | (mem[1:] != mem[:-1])])
    return hub[first], mem[first], np.diff(np.r_[first, len(hub)]), np.minimum.reduceat(need, first), np.maximum.reduceat(star, first)


def star_table(packed: DataFrame, dtype: np.dtype, t: float, shared: int = 1, direct: int = _DIRECT) -> DataFrame:
    """Distinct (hub, member, star) of all index lists that were packed as rows (part, blob); lists of
    more than direct entries become stars."""

    def lists(group: pa.Table) -> pa.Table:
        rows = unpack(group.column("blob"), dtype)
        found = stars(rows["key"], rows["set"], rows["n"], rows["pos"], t, shared, direct)
        del rows
        release()
        return pa.table(dict(zip(("hub", "member", "seen", "need", "star"), found)))

    edges = packed.groupBy("part").applyInArrow(lists, "hub bigint, member bigint, seen bigint, need bigint, star bigint")
    edges = edges.groupBy("hub", "member").agg(F.sum("seen").alias("seen"), F.min("need").alias("need"), F.max("star").alias("star"))
    return written(edges.where("seen >= need").select("hub", "member", "star"), "stars")


def needed_stars(edges: DataFrame) -> DataFrame:
    """(member, hubs) of as few stars as hold all pairs that edges stand for.

    The stars of roots, which are no other centre's member, stay.  The edge of a pair goes if the
    least centre of either end is a root with both in its star; the star of a long list goes if
    the root that is its centre's least centre has all its members."""
    inner = edges.select(F.col("member").alias("hub")).distinct()
    roots = edges.join(inner, "hub", "left_anti").select("hub", "member")
    rest = edges.join(inner, "hub", "left_semi")
    least = edges.groupBy("member").agg(F.min("hub").alias("least"))
    rest = rest.join(least.select(F.col("member").alias("hub"), F.col("least").alias("p")), "hub")
    one = roots.select(F.col("hub").alias("p"), "member", F.lit(True).alias("one"))
    two = roots.select(F.col("hub").alias("q"), F.col("member").alias("hub"), F.lit(True).alias("two"))
    rest = rest.join(least.withColumnRenamed("least", "q"), "member").join(two, ["q", "hub"], "left")
    rest = rest.join(one, ["p", "member"], "left").select("hub", "member", "star", "one", "two")
    bare = rest.where("star = 1").groupBy("hub").agg(F.count(F.when(F.col("one").isNull(), 1)).alias("missing")).where("missing > 0").select("hub", F.lit(True).alias("bare"))
    rest = rest.join(bare, "hub", "left").where("(star = 1 and bare) or (star = 0 and one is null and two is null)").select("hub", "member")
    kept = roots.union(rest)
    every = kept.union(kept.select("hub", F.col("hub").alias("member"))).distinct()
    return every.groupBy("member").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))


def verify(hub: int, ids: np.ndarray, sets: list[np.ndarray], hubs: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a < b, Jaccard) of a star's members that reach t and share no lesser centre."""
    order = np.argsort(ids)
    ids = ids[order]
    out = [(ids[i], ids[j], s) for i, j, s in _verified(hub, ids, [sets[i] for i in order], [hubs[i] for i in order], t)]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _verified(hub: int, ids: np.ndarray, sets: list[np.ndarray], hubs: list[np.ndarray], t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What verify gives, as places among the sorted ids and block by block."""
    n = np.array([len(s) for s in sets], np.int64)
    x = sets[min(int(np.searchsorted(ids, hub)), len(ids) - 1)]  # any centre is right, the hub is the cheapest
    minus, plus = [], []
    for s in sets:
        at = np.searchsorted(x, s)
        at[at == len(x)] = 0
        same = x[at] == s
        gone = np.ones(len(x), bool)
        gone[at[same]] = False
        minus.append(np.flatnonzero(gone))
        plus.append(s[~same])
    lost = np.array([len(d) for d in minus], np.int64)
    flat = np.concatenate(plus) if plus else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(ids)), [len(p) for p in plus])
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, owner = code[shared], owner[shared]
    column = np.concatenate([*minus, code + len(x)]) if minus else code
    owner = np.concatenate([np.repeat(np.arange(len(ids)), lost), owner])
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    column, owner = column[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
    width = int(column.max()) + 1 if len(column) else 0
    other = np.unique(np.concatenate([h[h < hub] for h in hubs])) if hubs else np.zeros(0, np.int64)
    lesser = np.zeros((len(ids), len(other)), np.float32)
    for i, h in enumerate(hubs):
        lesser[i, np.searchsorted(other, h[h < hub])] = 1
    step = 256

    def dense(i0: int, i1: int, c0: int, c1: int) -> np.ndarray:
        m = np.zeros((i1 - i0, c1 - c0), np.float32)
        c = column[bounds[i0] : bounds[i1]]
        o = owner[bounds[i0] : bounds[i1]] - i0
        k = (c >= c0) & (c < c1)
        m[o[k], c[k] - c0] = 1
        return m

    for i0 in range(0, len(ids), step):
        i1 = min(i0 + step, len(ids))
        for j0 in range(i0, len(ids), step):
            j1 = min(j0 + step, len(ids))
            if n[i0:i1].max() < t * n[j0:j1].min() - 1e-9 or n[j0:j1].max() < t * n[i0:i1].min() - 1e-9:
                continue
            both = np.zeros((i1 - i0, j1 - j0), np.float64)
            for c0 in range(0, width, 1 << 14):
                c1 = min(c0 + (1 << 14), width)
                a = dense(i0, i1, c0, c1)
                both += a @ (a.T if i0 == j0 else dense(j0, j1, c0, c1).T)
            both += len(x) - lost[i0:i1, None] - lost[None, j0:j1]
            score = both / (n[i0:i1, None] + n[None, j0:j1] - both)
            good = score >= t - 1e-12
            if len(other):
                good &= lesser[i0:i1] @ lesser[j0:j1].T == 0
            if i0 == j0:
                good &= np.triu(np.ones_like(good), 1)
            i, j = np.nonzero(good)
            yield i + i0, j + j0, score[i, j]


def _verify_few(hub: int, ids: list[int], blobs: list[bytes], hubs: list[list[int]], t: float) -> list[tuple[int, int, float]]:
    """What verify gives, for a star of few members."""
    sets = [set(memoryview(b).cast("Q")) for b in blobs]
    lesser = [{h for h in hs if h < hub} for hs in hubs]
    out = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            score = both / (len(a) + len(sets[j]) - both)
            if score >= t - 1e-12 and lesser[i].isdisjoint(lesser[j]):
                out.append((ids[i], ids[j], score))
    return out


def verified_pairs(texts: DataFrame, homes: DataFrame, stars_of: DataFrame, elements, t: float, spanning: bool = False) -> DataFrame:
    """(a, b, jaccard) of all pairs within stars that reach t.

    texts: (doc_id, text); homes: (member, doc_id), a document for every member; stars_of: (member,
    hubs); elements(column, members) gives (row, member, its sorted elements) for what the texts of a
    column hold, of those members at least.
    With spanning, only enough pairs to connect each star's similar members are given; and, if homes has
    a column weight, rows (a, null, null, links) of which the sum of links is the weight of all that are
    similar to a."""
    weighted = "weight" in homes.columns
    homes = homes if weighted else homes.withColumn("weight", F.lit(0).cast("bigint"))
    parts = 4 * partitions(texts.sparkSession, texts)
    wanted = homes.join(stars_of, "member").groupBy("doc_id").agg(F.collect_list(F.struct("member", "hubs", "weight")).alias("wanted"))

    def spread(batches):
        for batch in batches:
            lists = batch.column("wanted")
            offsets, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
            known: dict[tuple[int, int], tuple] = dict(zip(zip(owner.tolist(), flat.field("member").to_pylist()), zip(flat.field("hubs"), flat.field("weight").to_pylist())))
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, member, x in elements(batch.column("text"), flat.field("member").to_numpy()):
                found = known.pop((row, member), None)
                if found is not None:
                    hubs, weight = found[0].values.to_pylist(), found[1]
                    blob = x.tobytes()
                    for h in hubs:
                        for column, value in zip(out, (h, member, blob, hubs, weight)):
                            column.append(value)
            hub = np.array(out[0], np.int64)
            yield pa.record_batch(
                [pa.array(part_of(hub, parts)), pa.array(hub), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.int64())],
                ["part", "hub", "member", "elements", "hubs", "weight"],
            )

    def stars_in(group: pa.Table) -> pa.Table:
        hub = group.column("hub").to_numpy()
        member = group.column("member").to_numpy()
        order = np.lexsort((member, hub))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hub[order][1:] != hub[order][:-1]) | (member[order][1:] != member[order][:-1])
        order = order[fresh]
        cuts = np.flatnonzero(np.r_[True, hub[order][1:] != hub[order][:-1], True])
        blobs, hubs = group.column("elements").to_pylist(), group.column("hubs").to_pylist()
        weight = group.column("weight").to_numpy()
        out, few, links = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = order[a:b]
            if b - a < 2:
                continue
            ids, h = member[at], int(hub[at[0]])
            if b - a <= _FEW:
                found = _verify_few(h, ids.tolist(), [blobs[i] for i in at.tolist()], [hubs[i] for i in at.tolist()], t)
                if not spanning:
                    few += found
                    continue
                pairs = iter([(np.searchsorted(ids, x[0]), np.searchsorted(ids, x[1]), np.array(x[2])) for x in [list(zip(*found))]] if found else [])
            else:
                sets = [np.frombuffer(blobs[i], np.uint64) for i in at]
                if not spanning:
                    out.append(verify(h, ids, sets, [np.array(hubs[i]) for i in at], t))
                    continue
                pairs = _verified(h, ids, sets, [np.array(hubs[i]) for i in at], t)
            i, j, score, of = _spanning(len(ids), weight[at], pairs)
            out.append((ids[i], ids[j], score))
            links.append((ids[of > 0], of[of > 0]))
        if few:
            out.append(tuple(np.array(x) for x in zip(*few)))
        a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        release()
        edges = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "jaccard": pa.array(s, pa.float64())})
        if not weighted:
            return edges
        a, of = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
        counts = pa.table({"a": pa.array(a, pa.int64()), "b": pa.nulls(len(a), pa.int64()), "jaccard": pa.nulls(len(a), pa.float64()), "links": pa.array(of, pa.int64())})
        return pa.concat_tables([edges.append_column("links", pa.nulls(len(edges), pa.int64())), counts])

    schema = "part int, hub bigint, member bigint, elements binary, hubs array<bigint>, weight bigint"
    rows = texts.join(wanted, "doc_id").select("text", "wanted").mapInArrow(spread, schema)
    return rows.groupBy("part").applyInArrow(stars_in, "a bigint, b bigint, jaccard double" + ", links bigint" * weighted)


def _spanning(size: int, weight: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(i, j, score, links): enough of the pairs to connect all that they connect, and the weight of all
    that each of so many members is paired with."""
    root, links = np.arange(size), np.zeros(size, np.int64)

    def find(v: int) -> int:
        while (w := root[v]) != v:
            root[v] = root[w]
            v = root[v]
        return v

    kept = []
    for i, j, score in blocks:
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        for k in np.flatnonzero(root[i] != root[j]).tolist():
            u, v = find(i[k]), find(j[k])
            if u != v:
                root[max(u, v)] = min(u, v)
                kept.append((i[k], j[k], score[k]))
    i, j, score = zip(*kept) if kept else ((), (), ())
    return np.array(i, np.int64), np.array(j, np.int64), np.array(score, np.float64), links


def similar_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, spanning: bool = False, counted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, pairs, edges): the written (doc_id, set_id) of all documents, (a, b, jaccard) of all
    pairs of distinct sets that reach the threshold (or enough of them, with spanning), and the written
    table that pairs are read from.  With counted, pairs also has rows (a, null, null, links) of which the
    sum of links is the number of documents with a set that is similar to a."""
    spark = docs.sparkSession
    table = document_sets(docs, n)
    members = table.where("set_id is not null").select("doc_id", "set_id").distinct()
    ranks = spark.sparkContext.broadcast(_ranks(_frequencies(table)))
    late = spark.sparkContext.broadcast(_late(docs, n))
    parts = partitions(spark, docs)

    def prefixes(batches):
        pack = Packer(parts, _POSTING)
        for batch in batches:
            for _, x in _sets(batch.column("text"), n):
                size, sid = len(x), _set_id(x)
                rank = np.maximum(ranks.value[_counter(x)], late.value[_slot(x)])
                x = np.sort(x | rank.astype(np.uint64) << np.uint64(56))
                first = min(size, size - int(np.ceil(threshold * size - 1e-9)) + _SHARED)
                # list keys keep 48 bits of the hash; lists that fall together only add candidates
                yield from pack.add(x[:first] & ~np.uint64(0xFF), set=sid, n=size, pos=np.arange(first))
        yield from pack.flush()
        release()

    edges = star_table(_usable(docs).select("text").mapInArrow(prefixes, "part int, blob binary"), _POSTING, threshold, _SHARED)

    def elements(column, _):
        for row, x in _sets(column, n):
            yield row, _set_id(x), x

    homes = members.groupBy(F.col("set_id").alias("member")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"))
    homes = homes if counted else homes.drop("weight")
    return members, verified_pairs(_usable(docs), homes, needed_stars(edges), elements, threshold, spanning), edges


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """All similar documents as rows (doc_a, doc_b, jaccard, equal_sets).

    Documents with equal sets are linked to the least doc_id among them, with equal_sets true;
    pairs of distinct sets are given once, between the least doc_ids that have them.  The pairs of
    documents are those rows, with every document in the place of the one it is linked to."""
    members, pairs, _ = similar_sets(docs, n, threshold)
    first = members.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    copies = (
        members.join(first, "set_id").where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("equal_sets"))
    )
    left = first.select(F.col("set_id").alias("a"), F.col("rep").alias("rep_a"))
    right = first.select(F.col("set_id").alias("b"), F.col("rep").alias("rep_b"))
    near = (
        pairs.join(left, "a").join(right, "b").where("rep_a <> rep_b")
        .select(F.least("rep_a", "rep_b").alias("doc_a"), F.greatest("rep_a", "rep_b").alias("doc_b"), "jaccard", F.lit(False).alias("equal_sets"))
    )
    return copies.union(near).distinct()


def classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every doc_id: the least doc_id of its class, and the number of other
    documents that it is similar to.

    Classes are the connected components of jaccard_join's pairs; equal documents are links as well.
    Documents without a word are classes of their own.  A document whose rows have several sets connects
    them, and has the links of each."""
    members, rows, edges = similar_sets(docs, n, threshold, spanning=True, counted=True)
    rows = written(rows, "links")
    discard(edges)
    own = members.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z"))
    joined = members.join(own.where("a <> z"), "doc_id").select("a", F.col("set_id").alias("b"))
    root = components(rows.where("b is not null").select("a", "b").union(joined), "classes").select(F.col("node").alias("set_id"), "root")
    near = rows.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("near"))
    same = members.groupBy("set_id").agg((F.count("*") - 1).alias("same"))
    found = members.join(same, "set_id").join(near, "set_id", "left").join(root, "set_id", "left")
    found = found.select("doc_id", F.coalesce("root", "set_id").alias("root"), (F.col("same") + F.coalesce("near", F.lit(0))).alias("links"))
    least = found.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    found = found.join(least, "root").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    return every.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_id) of every document that is not the least doc_id of its group: groups are
    the connected components of the similar pairs."""
    members, pairs, edges = similar_sets(docs, n, threshold, spanning=True)
    root = components(pairs.select("a", "b"), "groups").select(F.col("node").alias("set_id"), "root")
    discard(edges)
    grouped = members.join(root, "set_id", "left").select("doc_id", F.coalesce("root", "set_id").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("doc_id").alias("kept_id"))
    out = grouped.join(kept, "root").where("doc_id <> kept_id")
    return out.groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"))

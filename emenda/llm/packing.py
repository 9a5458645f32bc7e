"""Packing documents into windows of a fixed number of tokens, best fit decreasing.

Lengths are counted with a public tokenizer.  A document longer than a window is first cut into full
windows and a rest; the rests and the other documents, longest first, each go to the open window with
the least room that holds them, found by a segment tree over the remaining capacity.

What best fit decreasing does depends on lengths only, and there are no more lengths than tokens in a
window.  So the plan is made on the driver for all documents at once, from the number of pieces of
each length (a table of fixed size), with pieces and windows in runs that fare alike: a window of
room r takes r // length pieces of a length before the next window's turn comes.  Pieces then find
their place by their rank within their length.  The result is that of the sequential algorithm
over the whole corpus, but for which of two pieces of equal length goes where.

Defined cases: a null text, or one without tokens, is in no window; documents with a null doc_id are
packed like others and carry null.  Repeated rows are packed as often as they occur.  Pieces of equal
length are ranked by doc_id and text hash.  Other columns, of whatever name, are ignored.  An
empty table gives no windows.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

CAPACITY = 4096
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ranks within a length are taken in shares of about so many pieces, so that no length is one task.
SHARE_PIECES = 1 << 20


class Segments:
    """Segment tree over the room that open windows have left: the least room of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, windows: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += windows
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The least room >= least that some window has."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first window, pieces per window, offset) and the number of
    windows, for so many pieces of each length below the capacity.

    The piece of rank first + i of a length goes to window first window + i // pieces per window,
    at token offset + length * (i % pieces per window)."""
    tree = Segments(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    runs, windows = [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            open_.setdefault(room, []).append((first, count))
            tree.add(room, count)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # as many new windows as the rest fills, the last perhaps in part
                per = capacity // length
                room, first, count = capacity, windows, -(-left // per)
                windows += count
            else:
                first, count = open_[room].pop()
                tree.add(room, -count)
            per = room // length
            full = min(count, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < count:
                runs.append((length, rank, left, first + full, per, capacity - room))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(room, first + full, count - full)
    return runs, windows


_memo: dict[str, tiktoken.Encoding] = {}


def encoding(folder: str, vocabulary: str) -> tiktoken.Encoding:
    """A tiktoken vocabulary of the folder, with the pattern that the folder's module names."""
    key = f"{folder}/{vocabulary}"
    if key not in _memo:
        spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(key).read_bytes().splitlines())}
        _memo[key] = tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _memo[key]


def _cut(tokens: list[int], enc: tiktoken.Encoding, capacity: int) -> list[tuple[int, int]]:
    """(characters, tokens) of the pieces of a text: full windows, then the rest.

    A cut inside a character moves to the character's begin; its bytes are in the next piece."""
    out, sizes = [], np.array([len(enc.decode_single_token_bytes(t)) for t in tokens])
    data = np.frombuffer(enc.decode_bytes(tokens), np.uint8)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.cumsum(sizes)
    for i in range(0, len(tokens), capacity):
        j = min(i + capacity, len(tokens))
        end = ends[j - 1]
        # a character whose bytes go on is not yet counted
        chars = begins[end] - (end < len(data) and (data[end] & 0xC0) == 0x80)
        out.append((int(chars), j - i))
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text_hash, piece, start, end, tokens) of every piece: characters start to end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizers, vocabulary)
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens = enc.encode_ordinary(text)
                if not tokens:
                    continue
                cuts = [(len(text), len(tokens))] if len(tokens) <= capacity else _cut(tokens, enc, capacity)
                start = 0
                for k, (end, n) in enumerate(cuts):
                    rows.append(row)
                    for c, v in zip(cols, (k, start, end, n)):
                        c.append(v)
                    start = end
            at = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), *(pa.array(c, pa.int64()) for c in cols)],
                ["doc_id", "text_hash", "piece", "start", "end", "tokens"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(scan, "doc_id bigint, text_hash bigint, piece bigint, start bigint, end bigint, tokens bigint")


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, share_pieces: int = SHARE_PIECES) -> DataFrame:
    """One row per window: (window_id, tokens, doc_ids, pieces), pieces in their order as structs
    (doc_id, piece, start, end, offset, tokens): characters start to end of the document are tokens
    offset to offset + tokens of the window.  doc_ids has the pieces' documents, each once."""
    spark = docs.sparkSession
    table = written(pieces(docs, capacity, tokenizers, vocabulary), "pieces")
    # no more rows than there are lengths
    sizes = table.groupBy("tokens").agg(F.ceil(F.count("*") / share_pieces).alias("shares"))
    share = F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.col("shares")).cast("int")
    table = table.join(sizes, "tokens").withColumn("share", share)
    counts = {(r.tokens, r.share): r["count"] for r in table.groupBy("tokens", "share").count().collect()}
    lengths: dict[int, int] = {}
    before = []
    for (n, s), count in sorted(counts.items()):
        before.append((n, s, lengths.get(n, 0)))
        lengths[n] = lengths.get(n, 0) + count
    whole = lengths.pop(capacity, 0)
    runs, windows = plan(lengths, capacity)
    runs += [(capacity, 0, whole, windows, 1, 0)] if whole else []

    first = np.array([r[1] for r in runs], np.int64)
    where = np.array([r[0] for r in runs], np.int64)
    order = np.lexsort((first, where))
    shared = spark.sparkContext.broadcast((where[order], first[order], np.array(runs, np.int64).reshape(-1, 6)[order]))

    def place(batches):
        where, first, run = shared.value
        for batch in batches:
            n, rank = batch.column("tokens").to_numpy(), batch.column("rank").to_numpy()
            # the last run of the length that begins at the rank or before
            key, end = np.searchsorted(where, n, "left"), np.searchsorted(where, n, "right")
            at = np.empty(len(n), np.int64)
            for length in np.unique(n):
                own = n == length
                a, z = key[own][0], end[own][0]
                at[own] = a + np.searchsorted(first[a:z], rank[own], "right") - 1
            i = rank - run[at, 1]
            per = run[at, 4]
            window, offset = run[at, 3] + i // per, run[at, 5] + n * (i % per)
            yield batch.append_column("window_id", pa.array(window)).append_column("offset", pa.array(offset))

    starts = spark.createDataFrame(before or [(0, 0, 0)], "tokens bigint, share int, before bigint")
    own = Window.partitionBy("tokens", "share").orderBy("doc_id", "text_hash", "piece")
    ranked = table.withColumn("own", F.row_number().over(own) - 1).join(starts, ["tokens", "share"])
    ranked = ranked.select("doc_id", "piece", "start", "end", "tokens", (F.col("before") + F.col("own")).alias("rank"))
    schema = "doc_id bigint, piece bigint, start bigint, end bigint, tokens bigint, rank bigint, window_id bigint, offset bigint"
    placed = ranked.mapInArrow(place, schema)
    rows = placed.groupBy("window_id").agg(
        F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "end", "tokens"))).alias("p")
    )
    return rows.select(
        "window_id", "tokens", F.array_distinct(F.col("p.doc_id")).alias("doc_ids"),
        F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.start.alias("start"), x.end.alias("end"), x.offset.alias("offset"), x.tokens.alias("tokens"))).alias("pieces"),
    )

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram abc is bound as the product of the letter
vectors permuted by 2, 1 and 0 places, a text is the bundle (sum) of its trigrams, and a language is
the bundle of its sample's.  Texts are compared with the languages by cosine.

Prototypes are fitted on a bounded sample of labelled rows: of every language ``sample`` documents
or a few more, chosen by a hash of doc_id among all documents.

A text is accepted if its best cosine reaches ``min_similarity``, or as much less as the root of its
trigrams in 40 is less than one: short texts hold too few trigrams of a language to come near it.

Defined cases: a null or empty text, or one without a letter trigram, has similarity 0, no language
and is not accepted.  Digits, punctuation and white space all count as one space.  Rows are answered
one by one, so ties, repeated rows and null doc_ids are kept as they are; of equally similar languages
the first by name is given.  Other columns, of whatever name, are ignored.  Rows with a null label
don't count for fitting.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import passed, release
from .textvec import string_buffers

DIMENSIONS = 1024
SAMPLE = 400
#: Cosines of unrelated vectors of 1,024 dimensions spread by 1 / 32; this is over three times that.
MIN_SIMILARITY = 0.1
#: Trigrams from which on all of it is asked for.
ENOUGH = 40

_LETTERS = 256
_CHUNK = 1 << 18
_ROWS = 128


def _letters() -> np.ndarray:
    """Symbol of every code point of the planes that have letters: 0 for what is no letter, ASCII letters
    their own, and the others in lower case, a hash of the code point."""
    table = np.zeros(1 << 18, np.uint8)
    for cp in (*range(0xD800), *range(0xE000, 1 << 18)):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else low if 0xDF <= low <= 0xFF else 27 + (low * 2654435761 >> 7) % 190
    return table


_memo: dict[str, np.ndarray] = {}


def _tables(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    if "letters" not in _memo:
        _memo["letters"] = _letters()
    key = f"vectors{dimensions}"
    if key not in _memo:
        _memo[key] = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (_LETTERS, dimensions))
    return _memo["letters"], _memo[key]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1), i + _ROWS)
        yield i, j
        i = j


def _symbols(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of UTF-8 bytes, and the byte at which each begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.uint32)
    follow = np.concatenate([data, np.zeros(3, np.uint8)])
    cp = b.copy()
    two, three, four = (b >= 0xC0) & (b < 0xE0), (b >= 0xE0) & (b < 0xF0), b >= 0xF0
    i = lead[two]
    cp[two] = (b[two] & 0x1F) << 6 | follow[i + 1] & 0x3F
    i = lead[three]
    cp[three] = (b[three] & 0x0F) << 12 | (follow[i + 1] & 0x3F).astype(np.uint32) << 6 | follow[i + 2] & 0x3F
    i = lead[four]
    cp[four] = (b[four] & 0x07) << 18 | (follow[i + 1] & 0x3F).astype(np.uint32) << 12 | (follow[i + 2] & 0x3F).astype(np.uint32) << 6 | follow[i + 3] & 0x3F
    return np.where(cp < len(letters), letters[np.minimum(cp, len(letters) - 1)], 0), lead


def bundles(column: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, one bundle per row, number of trigrams per row) for ranges of rows."""
    letters, vectors = _tables(dimensions)
    data, offsets = string_buffers(column)
    mark = np.zeros(_LETTERS**3, np.int32)
    for i, j in _chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        sym, at = _symbols(part, letters)
        row = np.searchsorted(offsets[i : j + 1] - offsets[i], at, "right") - 1
        # runs of what is no letter are one space, at the edges of a text too
        space = sym == 0
        same = np.zeros(len(sym), bool)
        same[1:] = space[1:] & space[:-1] & (row[1:] == row[:-1])
        sym, row = sym[~same].astype(np.int32), row[~same]
        ok = (row[2:] == row[:-2]) & ((sym[2:] != 0) | (sym[:-2] != 0) | (sym[1:-1] != 0))
        code = (sym[:-2] * _LETTERS + sym[1:-1]) * _LETTERS + sym[2:]
        code, row = code[ok], row[:-2][ok]
        out = np.zeros((j - i, dimensions), np.float32)
        if len(code):
            mark[code] = 1
            known = np.flatnonzero(mark)
            mark[known] = np.arange(len(known))
            count = np.bincount(row * len(known) + mark[code], minlength=(j - i) * len(known)).reshape(j - i, -1).astype(np.float32)
            mark[known] = 0
            for k in range(0, len(known), 4096):
                c = known[k : k + 4096]
                a, b, d = c // _LETTERS**2, c // _LETTERS % _LETTERS, c % _LETTERS
                bound = np.roll(vectors, 2, 1)[a] * np.roll(vectors, 1, 1)[b] * vectors[d]
                out += count[:, k : k + 4096] @ bound.astype(np.float32)
        yield i, out, np.bincount(row, minlength=j - i)


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and their prototypes, from about ``sample`` documents of each."""
    known = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label")
    )
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], np.zeros((0, dimensions), np.float32)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, sample / n)) + 1))))
    chosen = known.where(spread < share[F.col("label")]).where("text is not null")

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for first, rows, _ in bundles(batch.column("text"), dimensions):
                for k, v in enumerate(rows):
                    # every text counts alike, whatever its length
                    norm = float(np.linalg.norm(v))
                    if norm:
                        name = labels[first + k]
                        total[name] = total.get(name, 0) + v.astype(np.float64) / norm
        release()
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["label", "bundle"])

    sums: dict[str, np.ndarray] = {}
    for r in chosen.select("label", "text").mapInArrow(add, "label string, bundle binary").groupBy("label").agg(F.collect_list("bundle").alias("bundles")).collect():
        sums[r.label] = sum(np.frombuffer(b, np.float64) for b in r.bundles)
    names = sorted(sums)
    proto = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names], np.float32).reshape(len(names), dimensions)
    return names, proto


def _classify(docs: DataFrame, carried: list[str], names: list[str], proto: np.ndarray, min_similarity: float, rejected: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(proto)
    dimensions = proto.shape[1]
    kept = docs.columns if not rejected else carried
    text = kept.index("text")

    def answer(batches):
        for batch in batches:
            column = batch.column(text)
            n = len(column)
            best, score, margin, least = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
            for first, rows, trigrams in bundles(column, dimensions):
                norm = np.linalg.norm(rows, axis=1)
                cos = (rows @ shared.value.T).astype(np.float64) / np.where(norm, norm, 1)[:, None]
                s = slice(first, first + len(rows))
                least[s] = min_similarity * np.sqrt(np.minimum(trigrams / ENOUGH, 1))
                if cos.shape[1]:
                    best[s] = cos.argmax(1)
                    score[s] = cos.max(1)
                    margin[s] = score[s] - (np.partition(cos, -2, 1)[:, -2] if cos.shape[1] > 1 else 0)
            known = score > 0
            accepted = known & (score >= least)
            if rejected:
                name = pa.array([names[b] if k else None for b, k in zip(best, known)], pa.string())
                cols = [batch.column(i) for i in range(len(carried)) if i != text]
                yield pa.record_batch(
                    [*cols, name, pa.array(np.round(score, 6)), pa.array(np.round(margin, 6)), pa.array(accepted)],
                    [*(c for c in carried if c != "text"), "language", "similarity", "margin", "accepted"],
                )
            else:
                yield batch.filter(pa.array(accepted))
        release()

    if rejected:
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried if c != "text") + ", language string, similarity double, margin double, accepted boolean"
        return docs.mapInArrow(answer, schema)
    return passed(docs, answer)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, language, similarity, margin, accepted) of every row; margin is the distance to the
    next language.  A text is accepted if its similarity reaches min_similarity."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _classify(plain, ["doc_id", "text"], *model, min_similarity, True)


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The rows of docs whose text is accepted, with all their columns."""
    return _classify(docs, docs.columns, *model, min_similarity, False)

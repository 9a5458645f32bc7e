"""Lossless tokens, word islands, token windows and n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.chars import codepoints

_DIGIT = rf"\p{{Nd}}{T.OTHER_DIGITS}"
_SPACE = r"[\s\x1c-\x1f\x85&&[^\n]]"
_TYPES = ("NEWLINE", "NUMBER", "FOREIGN_WORD", "VI_WORD", "SPACE", "UNKNOWN", "PUNCT")
_NEWLINE, _NUMBER, _FOREIGN, _VI, _BLANK, _UNKNOWN, _PUNCT = range(7)
#: Bytes of text that are cut into tokens at once.
_CHUNK = 1 << 20
WORDS = ("VI_WORD", "FOREIGN_WORD", "UNKNOWN")
IDENTITY_ONLY = ("NUMBER", "UNIT", "PUNCT", "SPACE", "NEWLINE", "PROTECTED")


def token_type(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^\n"), "NEWLINE").when(token.rlike(rf"^[{_DIGIT}]"), "NUMBER")
        .when(token.rlike(r"^\p{L}"), F.when(T.contains_vietnamese(token), "VI_WORD").otherwise("FOREIGN_WORD"))
        .when(token.rlike(rf"(?U)^{_SPACE}"), "SPACE").when(token.rlike(r"^[\p{C}\p{Z}]"), "UNKNOWN").otherwise("PUNCT")
    )


@lru_cache
def _class_runs() -> tuple[np.ndarray, np.ndarray]:
    """(class, how many) of all code points in order, classes as indices of _TYPES; Vietnamese letters have
    their own."""
    table = np.full(0x110000, _PUNCT, np.uint8)
    vietnamese = re.compile(T.VIETNAMESE)
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c == "\n":
            table[cp] = _NEWLINE
        elif kind == "Nd":
            table[cp] = _NUMBER
        elif kind[0] == "L":
            table[cp] = _VI if vietnamese.match(c) else _FOREIGN
        elif kind[0] in "CZ":
            table[cp] = _BLANK if c.isspace() else _UNKNOWN
    table[[ord(c) for c in T.OTHER_DIGITS]] = _NUMBER
    first = np.flatnonzero(np.r_[True, table[1:] != table[:-1]])
    return table[first], np.diff(np.r_[first, len(table)])


def _token_batches(batches: Iterator[pa.RecordBatch], key: str, words: bool, runs: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tokens of batches (key, text), each a slice of the text's own bytes; with words, only word tokens,
    with their island and place in it."""
    table = np.repeat(*runs)
    names = pa.array(_TYPES)
    for batch in batches:
        column = batch.column(1).cast(pa.large_string()).fill_null("")
        size = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(size, size[i] + _CHUNK, "right")) - 1)
            cp, place, row, data = codepoints(column.slice(i, j - i))
            vi = table[cp]
            kind = np.where(vi == _VI, _FOREIGN, vi)
            first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])][: len(kind)])
            own, kind = row[first], kind[first]
            if len(first):
                kind = np.where((kind == _FOREIGN) & (np.add.reduceat(vi == _VI, first) > 0), _VI, kind)
            text = np.searchsorted(row, np.arange(j - i + 1))
            start, end = first - text[own], np.r_[first[1:], len(cp)][: len(first)] - text[own]
            head = np.searchsorted(own, np.arange(j - i))
            index = np.arange(len(first)) - head[own]
            offsets = np.r_[place[first], len(data)].astype(np.int32)
            token = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            columns = [batch.column(0).take(pa.array(own + i)), pa.array(index.astype(np.int32)), token, names.take(pa.array(kind)), pa.array(start), pa.array(end)]
            fields = [key, "tok_idx", "token", "token_type", "start", "end"]
            if words:
                word = np.isin(kind, (_VI, _FOREIGN, _UNKNOWN))
                parted = np.cumsum(~word & (kind != _BLANK))
                before = np.r_[0, parted][head] if len(first) else head
                island = parted - before[own]
                count = np.cumsum(word)
                begin = np.r_[True, (island[1:] != island[:-1]) | (own[1:] != own[:-1])][: len(island)]
                # words before the island, carried over it
                earlier = np.maximum.accumulate(np.where(begin, count - word, 0))
                columns += [pa.array(island), pa.array((count - earlier - 1).astype(np.int32))]
                fields += ["island", "word_pos"]
                yield pa.record_batch(columns, fields).filter(pa.array(word))
            else:
                yield pa.record_batch(columns, fields)
            i = j


def _tokens(docs: DataFrame, text: str, key: str, words: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, tok_idx int, token string, token_type string, start bigint, `end` bigint" + ", island bigint, word_pos int" * words
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = _class_runs()
    return rows.mapInArrow(lambda batches: _token_batches(batches, key, words, runs), schema)


def tokenize(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tok_idx, token, token_type, start, end): maximal runs of one character class.

    A text's tokens and their places come from one pass over it, so nothing is shuffled or sorted."""
    return _tokens(docs, text, key, False)


def island_words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What islands(tokenize(docs)) gives, in the same pass."""
    return _tokens(docs, text, key, True)


def token_lists(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tokens): what tokenize() gives, as one row for every text."""
    kind = docs.schema[key].dataType.simpleString()
    runs = _class_runs()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, head, tokens, _ in _by_text(batches, "key", runs):
            yield pa.record_batch([keys, pa.ListArray.from_arrays(pa.array(head.astype(np.int32)), tokens)], [key, "tokens"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(lists, f"`{key}` {kind}, tokens array<string>")


def _by_text(batches: Iterator[pa.RecordBatch], key: str, runs: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, pa.RecordBatch]]:
    """(keys, first token of each text and their number, tokens, rows) of slices of batches (key, text, ...)."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + _CHUNK, "right")))
            part = batch.slice(i, j - i)
            numbered = pa.record_batch([pa.array(np.arange(j - i)), part.column(1)], [key, "text"])
            cut = [(b.column(0), b.column(2)) for b in _token_batches(iter([numbered]), key, False, runs)]
            own = np.concatenate([c[0].to_numpy(zero_copy_only=False) for c in cut]) if cut else np.zeros(0, np.int64)
            tokens = pa.concat_arrays([c[1] for c in cut]) if cut else pa.array([], pa.string())
            yield part.column(0), np.searchsorted(own, np.arange(j - i + 1)), tokens, part
            i = j


def _runs(key: pa.Array, at: np.ndarray) -> np.ndarray:
    """Where a run of consecutive places in one text begins."""
    one, two = key.slice(0, len(key) - 1), key.slice(1)
    same = pc.or_(pc.equal(one, two).fill_null(False), pc.and_(one.is_null(), two.is_null())).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, ~same | (at[1:] != at[:-1] + 1)])


def _joined(tokens: pa.Array, head: np.ndarray) -> pa.Array:
    """Texts of runs of tokens, of which head has the beginnings and the end: slices of the tokens' own bytes."""
    tokens = tokens.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, tokens.offset * 8) if len(tokens) else np.zeros(1, np.int64)
    data = tokens.buffers()[2] if len(tokens) else None
    return pa.Array.from_buffers(pa.large_string(), len(head) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[head])), data or pa.py_buffer(b"")]).cast(pa.string())


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            first = _runs(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False))
            where = pa.array(first)
            yield pa.record_batch([batch.column(0).take(where), batch.column(1).take(where), _joined(batch.column(2), np.r_[first, len(batch)])], batch.schema.names)


def reconstruct(tokens: DataFrame, key: str = "doc_id", token: str = "token") -> DataFrame:
    """(key, text) of tokens. Tokens that follow each other are joined where they are, so that pieces of text
    are gathered, not tokens."""
    kind = tokens.schema[key].dataType.simpleString()
    pieces = tokens.select(F.col(f"`{key}`"), "tok_idx", F.col(f"`{token}`").alias("piece")).mapInArrow(_piece_batches, f"`{key}` {kind}, tok_idx int, piece string")
    parts = F.array_sort(F.collect_list(F.struct("tok_idx", "piece")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"))


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, token): the distinct tokens of every text but spaces and others that begin with an ASCII character that is no letter."""
    kind = docs.schema[key].dataType.simpleString()
    runs = _class_runs()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, head, tokens, _ in _by_text(batches, "key", runs):
            own = pa.array(np.repeat(np.arange(len(keys)), np.diff(head)))
            found = pa.table([own, tokens], ["own", "token"]).group_by(["own", "token"], use_threads=False).aggregate([]).combine_chunks()
            if len(found):
                found = found.filter(pc.invert(pc.match_substring_regex(found["token"], r"^[\x00-@\[-`{-\x7F]")))
                yield pa.record_batch([keys.take(found["own"].combine_chunks()), found["token"].combine_chunks()], [key, "token"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(words, f"`{key}` {kind}, token string")


def replaced(docs: DataFrame, forms: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) of docs with tokens replaced as the column forms has it, an array of (token, form), or null.

    A token has the same form in all texts that have one for it."""
    kind = docs.schema[key].dataType.simpleString()
    runs = _class_runs()

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, head, tokens, rows in _by_text(batches, "key", runs):
            pairs = rows.column(2).flatten()
            token, form = pairs.field(0), pairs.field(1)
            once = np.unique(np.asarray(token.dictionary_encode().indices), return_index=True)[1]
            known, form = token.take(pa.array(once)), form.take(pa.array(once))
            if len(known):
                tokens = pc.coalesce(form.take(pc.index_in(tokens, value_set=known)), tokens)
            yield pa.record_batch([keys, _joined(tokens, head)], [key, "text"])

    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"), F.coalesce(forms, F.array().cast("array<struct<token:string,form:string>>")).alias("forms"))
    return rows.mapInArrow(rebuilt, f"`{key}` {kind}, text string")


def islands(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Word tokens with their island and position in it: spaces join words, all else parts them."""
    own = Window.partitionBy(key).orderBy("tok_idx")
    breaks = F.when(F.col("token_type").isin(*WORDS, "SPACE"), 0).otherwise(1)
    rows = tokens.withColumn("island", F.sum(breaks).over(own.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("token_type").isin(*WORDS))
    return rows.withColumn("word_pos", F.row_number().over(Window.partitionBy(key, "island").orderBy("tok_idx")) - 1)


def word_spans(words: DataFrame, least: int = 2, most: int = 8, key: str = "doc_id") -> DataFrame:
    """(key, island, start_pos, n, words, first_tok, last_tok) of all runs of least to most words."""
    own = Window.partitionBy(key, "island").orderBy("word_pos").rowsBetween(0, most - 1)
    rows = words.withColumn("ahead", F.collect_list("token").over(own)).withColumn("toks", F.collect_list("tok_idx").over(own))
    rows = rows.where(F.size("ahead") >= least).withColumn("n", F.explode(F.sequence(F.lit(least), F.size("ahead"))))
    return rows.select(
        key, "island", F.col("word_pos").alias("start_pos"), "n", F.slice("ahead", F.lit(1), F.col("n")).alias("words"),
        F.col("tok_idx").alias("first_tok"), F.element_at("toks", F.col("n")).alias("last_tok"),
    )


def span_places(docs: DataFrame, least: int = 2, most: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, island, start_pos, n, first_tok, last_tok): word_spans(island_words(docs)) without the words, in the pass that cuts the tokens."""
    kind = docs.schema[key].dataType.simpleString()
    runs = _class_runs()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _token_batches(batches, key, True, runs):
            at, island, pos = (words.column(c).to_numpy(zero_copy_only=False) for c in ("tok_idx", "island", "word_pos"))
            group = np.cumsum(pos == 0)
            for n in range(least, most + 1):
                ahead = n - 1
                i = np.flatnonzero(group[ahead:] == group[: len(group) - ahead]) if len(group) > ahead else np.zeros(0, np.int64)
                columns = [words.column(0).take(pa.array(i)), pa.array(island[i]), pa.array(pos[i]), pa.array(np.full(len(i), n, np.int32)), pa.array(at[i]), pa.array(at[i + ahead])]
                yield pa.record_batch(columns, [key, "island", "start_pos", "n", "first_tok", "last_tok"])

    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(spans, f"`{key}` {kind}, island bigint, start_pos int, n int, first_tok int, last_tok int")


#: Rows of which words are put in place at once.
_ROWS = 256


@F.arrow_udf(StringType())
def rebuild_phrase(original: pa.Array, replacement: pa.Array) -> pa.Array:
    """Words of replacement in the places of the words of the original token array, spaces kept; words
    that have no replacement stay."""

    def some(a: pa.Array, b: pa.Array) -> pa.Array:
        size, most = (pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        tokens, words = a.flatten(), b.flatten()
        code = tokens.dictionary_encode()
        space = np.array([t.isspace() or not t for t in code.dictionary.to_pylist()], bool)
        word = ~space[np.asarray(code.indices)] if len(tokens) else np.zeros(0, bool)
        head, own = np.r_[0, np.cumsum(size)], np.repeat(np.arange(len(a)), size)
        nth = np.cumsum(word) - word - np.r_[0, np.cumsum(word)][head[:-1]][own]
        there = word & (nth < most[own])
        chosen = words.take(pa.array(np.where(there, (np.cumsum(most) - most)[own] + nth, 0), mask=~there)) if len(words) else pa.nulls(len(tokens), tokens.type)
        none = pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        return _joined(pc.coalesce(chosen, tokens), head).take(pa.array(np.arange(len(a)), mask=none))

    return pa.concat_arrays([some(original.slice(i, _ROWS), replacement.slice(i, _ROWS)) for i in range(0, max(1, len(original)), _ROWS)])


def _window_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Windows of runs of consecutive tokens, joined as far as the run goes, and not yet cut at the text's end; a
    run without any has a row of its last token only."""
    half = most // 2
    for batch in batches:
        if not len(batch):
            continue
        key, at, wanted = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        first = _runs(key, at)
        last = np.r_[first[1:], len(at)] - 1
        i = np.flatnonzero(wanted)
        run = np.searchsorted(first, i, "right") - 1
        a = np.maximum(at[i] - half, 0)
        b = np.minimum(at[i] + half + 1, a + most)
        fresh = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (a[1:] > b[:-1])][: len(i)])
        ends = (np.r_[fresh[1:], len(i)] - 1)[: len(fresh)]
        none = np.setdiff1d(np.arange(len(first)), run)
        of, blank = np.r_[run[fresh], none], np.r_[np.zeros(len(fresh), bool), np.ones(len(none), bool)]
        rest = np.zeros(len(none), np.int32)
        columns = [pa.array(at[last[of]].astype(np.int32)), *(pa.array(np.r_[x, rest].astype(np.int32), mask=blank) for x in (a[fresh], b[ends]))]
        yield pa.record_batch([key.take(pa.array(first[of])), *columns], [batch.schema.names[0], "top", "a", "b"])


def windows(tokens: DataFrame, most: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, win_id, start_tok, end_tok): half-open windows around ambiguous tokens, joined where they touch.

    tokens: key, tok_idx, n_candidates, protected. Windows of tokens that follow each other are joined where the
    tokens are, so that what is gathered by text are windows."""
    kind = tokens.schema[key].dataType.simpleString()
    wanted = tokens.select(F.col(f"`{key}`"), F.col("tok_idx").cast("int").alias("tok_idx"), F.expr("n_candidates > 1 and not protected").alias("wanted"))
    own = Window.partitionBy(key)
    rows = wanted.mapInArrow(lambda batches: _window_batches(batches, most), f"`{key}` {kind}, top int, a int, b int")
    # an end cut at the text's end touches what it touched before, as all windows begin within the text
    rows = rows.withColumn("b", F.least("b", F.max("top").over(own) + 1)).where("a is not null")
    own = own.orderBy("a", "b")
    before = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(F.col("a") <= before, 0).otherwise(1)).withColumn("win_id", F.sum("fresh").over(own) - 1)
    return rows.groupBy(key, "win_id").agg(F.min("a").alias("start_tok"), F.max("b").alias("end_tok"))


def ngrams(words: Column, least: int, most: int) -> Column:
    """All runs of least to most elements, joined by spaces."""
    size = F.size(words)

    def of(n: int) -> Column:
        at = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*(of(n) for n in range(least, most + 1)))


def _place_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(two, rest) of every place in batches (words) that another word follows: two words, and those up to most."""
    for batch in batches:
        for i in range(0, len(batch), _ROWS):
            lists = batch.column(0).slice(i, _ROWS)
            words = lists.flatten()
            own = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            n = len(words)
            at = np.arange(n)
            after = [words.take(pa.array(np.minimum(at + k, n - 1), mask=np.r_[own[k:], np.full(min(k, n), -1)] != own)) for k in range(most)]
            some = after[1].is_valid()
            first, second, *others = (x.filter(some) for x in after)
            rest = others[0].fill_null("") if others else pa.array([""] * len(first), words.type)
            for x in others[1:]:
                rest = pc.coalesce(pc.binary_join_element_wise(rest, x, " "), rest)
            yield pa.record_batch([pc.binary_join_element_wise(first, second, " "), rest], ["two", "rest"])


def ngram_counts(docs: DataFrame, words: str, most: int = 4) -> DataFrame:
    """(ngram, cnt) of all runs of 2 to most elements of the column words, which are not empty and hold no spaces.

    Each place is sent once, with the longest run that begins there, to where its first two words are; shorter
    runs are its beginnings, and are counted there too."""
    rows = docs.select(F.col(words)).mapInArrow(lambda batches: _place_batches(batches, most), "two string, rest string").repartition("two")
    size = F.when(F.col("rest") == "", 0).otherwise(F.length("rest") - F.length(F.replace("rest", F.lit(" "), F.lit(""))) + 1)
    longer = [F.when(size >= k, F.concat("two", F.lit(" "), F.substring_index("rest", " ", k))) for k in range(1, most - 1)]
    rows = rows.select("two", F.explode(F.array("two", *longer)).alias("ngram")).where("ngram is not null")
    return rows.groupBy("two", "ngram").agg(F.count("*").alias("cnt")).drop("two")

"""Candidate sequences of token windows: exhaustive product and beam search.

Both run window by window in Arrow batches; the search is a loop over positions whose state depends on
all candidates so far, which has no relational form.  Scoring of the sequences is relational."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Choice = tuple[str, float]
OUT = "win_id long, seq_id int, tokens array<string>, beam_score double"


def position_choices(original: str, choices: Sequence[Choice], most: int = 8) -> list[Choice]:
    """The candidates of a position by falling prior: at least most if there are so many, and as many
    more as it takes to reach the original."""
    out, seen = [], False
    for text, prior in sorted(choices, key=lambda c: -c[1]):
        seen |= text == original
        out.append((text, prior))
        if len(out) >= most and seen:
            break
    return out if seen else [*out, choices[0]]


def beam(originals: Sequence[str], choices: Sequence[Sequence[Choice]], bigram: Callable[[str, str], float], width: int = 32, most: int = 8) -> list[tuple[tuple[str, ...], float]]:
    """Sequences by beam search on priors and bigrams of content tokens.

    Ties at the width stay, and the sequence of originals is put back whenever it falls out."""
    options = [position_choices(o, c, most) for o, c in zip(originals, choices)]
    # a row is (link, last content token, score, whether all is original), a link (link before, token):
    # rows share what they have in common, so a long window costs no more a position than a short one
    rows: list[tuple[tuple | None, str | None, float, bool]] = [(None, None, 0.0, True)]
    same, same_last, same_score = None, None, 0.0
    for original, own in zip(originals, options):
        grown = []
        for link, last, score, plain in rows:
            for text, prior in own:
                content = bool(text.strip())
                gain = bigram(last, text) if last is not None and content else 0.0
                grown.append(((link, text), text if content else last, score + prior + gain, plain and text == original))
        grown.sort(key=lambda r: -r[2])
        rows = [r for r in grown if r[2] >= grown[width - 1][2]] if len(grown) > width else grown
        same_score += next((p for t, p in own if t == original), 0.0) + (bigram(same_last, original) if same_last is not None else 0.0)
        same = (same, original)
        same_last = original if original.strip() else same_last
        if not any(r[3] for r in rows):
            rows.append((same, same_last, same_score, True))

    def tokens(link: tuple | None) -> tuple[str, ...]:
        out = []
        while link is not None:
            link, text = link
            out.append(text)
        return tuple(reversed(out))

    return [(tokens(link), score) for link, _, score, _ in rows]


def product(originals: Sequence[str], choices: Sequence[Sequence[Choice]], limit: int = 5000, most: int = 8) -> list[tuple[tuple[str, ...], float]]:
    """All combinations, originals first; if they are too many, with fewer choices per position."""

    def ordered(original: str, own: Sequence[Choice], k: int) -> list[Choice]:
        rest = sorted((c for c in own if c[0] != original), key=lambda c: -c[1])
        return ([c for c in own if c[0] == original][:1] + rest)[:k]

    options = [ordered(o, c, most) for o, c in zip(originals, choices)]
    if math.prod(map(len, options)) > limit:
        several = max(1, sum(len(o) > 1 for o in options))
        options = [o[: max(2, int(limit ** (1 / several)))] for o in options]
    rows: list[tuple[tuple[str, ...], float]] = [((), 0.0)]
    for own in options:
        rows = [((*t, text), s + prior) for t, s in rows for text, prior in own][:limit]
    return rows


def generate(window_candidates: DataFrame, bigrams: DataFrame, key: str = "doc_id", width: int = 32, most: int = 8, exhaustive: bool = False, limit: int = 5000) -> DataFrame:
    """Sequences (key, win_id, seq_id, tokens, beam_score) of windows.

    window_candidates: (key, win_id, tok_idx, token, text, prior, rank).  bigrams: (ngram, score).
    Only bigrams of neighbouring candidates can count, so those come along with each window."""
    rows = window_candidates.select(key, "win_id", "tok_idx", "token", F.struct(F.negative("prior").alias("k"), "rank", "text", "prior").alias("c"))
    positions = rows.groupBy(key, "win_id", "tok_idx", "token").agg(F.array_sort(F.collect_list("c")).alias("choices"))
    # the search takes the best by prior, and as many more as it takes to reach the original
    upto = F.greatest(F.lit(most), F.array_position(F.transform("choices", lambda c: c["text"]), F.col("token")).cast("int"))
    positions = positions.withColumn("choices", F.slice("choices", F.lit(1), upto))
    # a content token's bigrams are with those of the next position that has any
    content = positions.withColumn("ws", F.filter(F.transform("choices", lambda c: c["text"]), lambda w: F.trim(w) != "")).where(F.size("ws") > 0)
    content = content.withColumn("next", F.lead("ws").over(Window.partitionBy(key, "win_id").orderBy("tok_idx")))
    pairs = content.select(key, "win_id", F.explode("ws").alias("a"), "next").select(key, "win_id", "a", F.explode("next").alias("b"))
    known = pairs.select(key, "win_id", F.concat_ws(" ", "a", "b").alias("ngram")).distinct().join(bigrams.groupBy("ngram").agg(F.max("score").alias("score")), "ngram")
    known = known.groupBy(key, "win_id").agg(F.map_from_entries(F.collect_set(F.struct("ngram", "score"))).alias("bigrams"))
    lists = positions.groupBy(key, "win_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "token", "choices"))).alias("positions")).join(known, [key, "win_id"], "left")
    key_type = window_candidates.schema[key].dataType.simpleString()

    def search(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                scores = dict(r.bigrams) if r.bigrams is not None else {}
                originals = [p["token"] for p in r.positions]
                choices = [[(c["text"], c["prior"]) for c in p["choices"]] for p in r.positions]
                found = product(originals, choices, limit, most) if exhaustive else beam(originals, choices, lambda a, b, s=scores: s.get(f"{a} {b}", 0.0), width, most)
                out += [(getattr(r, key), r.win_id, i, list(t), s) for i, (t, s) in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "win_id", "seq_id", "tokens", "beam_score"])

    return lists.mapInPandas(search, f"`{key}` {key_type}, {OUT}")


def trimmed(counts: Sequence[int], limit: int) -> list[int]:
    """Numbers of candidates per position, the first of the longest shortened by one again and again
    until their product is within the limit."""
    out = list(counts)
    while math.prod(out) > limit and max(out) > 1:
        out[out.index(max(out))] -= 1
    return out

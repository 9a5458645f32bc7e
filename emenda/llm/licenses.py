"""Fuzzy search for short licence notices.

A notice of m characters may differ by k = m // 10 edits.  It is split into k + 1 pieces; by the
pigeonhole principle every match holds a piece unchanged.  One Aho-Corasick automaton finds the
pieces of all notices, every hit opens the stretch that a match around it can span, overlapping
stretches join, and the regex library's bounded-error matching verifies them and gives the edits.

Within a stretch the best match is taken (fewest edits, then leftmost), then those before and after
it likewise.  Letters are compared without case, and every white-space character counts as a space.

Defined cases: a null or empty text, and rows with a null doc_id, give no rows.  Repeated rows are
reported as often as they occur.  Other columns, of whatever name, are ignored.  Texts are read
whole.  Where notices overlap each is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "MPL-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights": "All rights reserved",
}


_SPACES = [chr(cp) for cp in range(1 << 16) if chr(cp).isspace() and cp != 32]


def _flatten() -> dict[int, int]:
    """Lower case where that is one character, and spaces for white space: lengths stay."""
    table = {}
    for cp in range(1 << 16):
        c = chr(cp)
        low = " " if c.isspace() else c.lower()
        if len(low) == 1 and low != c:
            table[cp] = ord(low)
    return table


def reachable(masks: dict[str, int], size: int, k: int, text: str) -> bool:
    """Whether a part of text is within k edits of the notice with these character masks (Myers's
    bit vectors): spares the regex library the many stretches that hold no match."""
    every, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = every, 0, size
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & every
        up, down = minus | ~(d | plus) & every, d & plus
        score += (up & top > 0) - (down & top > 0)
        if score <= k:
            return True
        up, down = up << 1 & every, down << 1 & every
        plus, minus = down | ~(d | up) & every, up & d
    return False


class Scanner:
    def __init__(self, notices: dict[str, str]):
        self.table = _flatten()
        self.patterns, self.masks = [], []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for name, notice in notices.items():
            text = self.flat(notice)
            k = len(text) // 10
            at = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(at[:-1], at[1:]):
                seeds.setdefault(text[a:b], []).append((len(self.patterns), a))
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks.append(masks)
            self.patterns.append((name, text, k, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}", regex.DOTALL)))
        self.seeds = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def flat(self, text: str) -> str:
        low = text.lower()
        # only rare characters change their length in lower case
        if len(low) != len(text):
            return text.translate(self.table)
        for c in _SPACES:
            if c in low:
                low = low.replace(c, " ")
        return low

    def stretches(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the joined stretches that can hold a match."""
        out: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.seeds.iter(text):
            begin = end + 1 - size
            for p, offset in where:
                _, notice, k, _ = self.patterns[p]
                a, b = max(0, begin - offset - k), min(len(text), begin - offset + len(notice) + k)
                out.setdefault(p, []).append((a, b))
        for p, spans in out.items():
            spans.sort()
            joined = [spans[0]]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            out[p] = joined
        return out

    def matches(self, p: int, text: str, a: int, b: int) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        _, notice, k, pattern = self.patterns[p]
        size = len(notice)
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            # a match has k characters less than the notice at least; the leftmost without edits is best
            if (at := text.find(notice, a, b)) >= 0:
                yield at, at + size, (0, 0, 0)
                todo += [(a, at), (at + size, b)]
            elif b - a >= max(1, size - k) and reachable(self.masks[p], size, k, text[a:b]) and (m := pattern.search(text, a, b)) and m.end() > m.start():
                yield m.start(), m.end(), m.fuzzy_counts
                todo += [(a, m.start()), (m.end(), b)]

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, int]]:
        """(notice, start, end, substitutions, insertions, deletions), in order of place."""
        flat = self.flat(text)
        found = []
        for p, spans in self.stretches(flat).items():
            name = self.patterns[p][0]
            found += [(name, s, e, *edits) for a, b in spans for s, e, edits in self.matches(p, flat, a, b)]
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, notice, start, end, edits, substitutions, insertions, deletions, matched) of every
    notice in every document; start and end are characters, matched is the text between."""

    def search(batches):
        scanner = Scanner(notices)
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for m in scanner.scan(text):
                    rows.append(row)
                    out.append((*m[:3], sum(m[3:]), *m[3:], text[m[1] : m[2]]))
            cols = list(zip(*out)) or [()] * 8
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string())],
                ["doc_id", "notice", "start", "end", "edits", "substitutions", "insertions", "deletions", "matched"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id bigint, notice string, start bigint, `end` bigint, edits bigint, substitutions bigint, insertions bigint, deletions bigint, matched string"
    return texts.mapInArrow(search, schema)

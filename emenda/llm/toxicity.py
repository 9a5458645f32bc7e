"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause as symbols (insult, threat verb, announcement, target,
negation, report, quotation mark, other): insults escalate, a threat is an announcement, a threat
verb and a target in this order, a target makes a clause worse, a negation shortly before an insult
and reported speech make it milder.  Their composition, the product machine with the product of
their weights, is built once; a clause is scored by one run of it, a document by the sum of its
clauses.  A clause counts only if it matches, so most text is never run.

The words of threats, targets, negation and report are given; insults are given for English and
learned for all languages from a bounded sample of labelled rows (``sample`` of each label,
chosen by a hash of doc_id): words and five-letter beginnings that are much more frequent among
toxic documents.

Defined cases: rows with a null doc_id or a null text, and documents under the threshold, give no
row.  Labels with null ids or null values don't count.  Repeated rows are reported as often as they
occur; of equal clauses the first is named.  Without labels only the given words count.  Other
columns, of whatever name, are ignored.  Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
SAMPLE = 4000
BEGINNING = 5

INSULTS = {w: 1.0 for w in "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile filth vermin degenerate".split()}
WORDS = {
    "threat": "kill hurt destroy beat burn shoot stab strangle murder tuer brûler töten schlagen matar quemar",
    "will": "will gonna shall going must should vais werde voy",
    "target": "you your yours he him she her they them their tu toi vous du dich ihr usted vosotros ellos",
    "not": "not never no isn't aren't wasn't don't nobody nothing without pas jamais nicht kein keine nunca",
    "report": "said says say called calls wrote writes claimed claims quoted reported alleged dit sagte dijo",
}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]|[.!?;:,\n]+")
#: What ends a clause: not a comma, after which the one that is meant may be named, or what is said quoted.
_END = frozenset(".!?;:\n")
SYMBOLS = ("insult", "threat", "will", "target", "not", "report", "quote", "other")


@dataclass
class Transducer:
    """States 0 ... n - 1 from 0: step gives (next state, factor of the arc) by state and symbol,
    final (factor, addition) by state.  Where step says nothing, the state falls back."""

    step: dict[tuple[int, str], tuple[int, float]]
    final: dict[int, tuple[float, float]]
    back: dict[int, int]

    def go(self, state: int, symbol: str) -> tuple[int, float]:
        return self.step.get((state, symbol), (self.back.get(state, state), 1.0))


#: One insult weighs 0.6 of its weight, each further one of the clause 0.9.
INSULT = Transducer({(0, "insult"): (1, 0.6), (1, "insult"): (1, 0.9)}, {}, {})
#: announcement, threat verb, target; a verb with a target alone is half a threat.
THREAT = Transducer(
    {(0, "will"): (1, 1.0), (0, "threat"): (2, 1.0), (1, "threat"): (3, 1.0), (2, "target"): (4, 1.0), (3, "target"): (5, 1.0)}, {4: (1.0, 0.4), 5: (1.0, 1.5)}, {}
)
TARGET = Transducer({(0, "target"): (1, 1.0)}, {1: (1.5, 0.0)}, {})
#: A negation reaches over the next three words.
NEGATION = Transducer(
    {(s, "not"): (3, 1.0) for s in range(4)} | {(s, "insult"): (s - 1, 0.2) for s in (1, 2, 3)}, {}, {3: 2, 2: 1, 1: 0}
)
REPORT = Transducer({(s, "report"): (1 + s // 2 * 2, 1.0) for s in range(4)} | {(s, "quote"): (s ^ 2, 1.0) for s in range(4)} | {(s, "insult"): (s, 0.6) for s in (2, 3)}, {1: (0.4, 0.0), 3: (0.4, 0.0)}, {})


class Grammar:
    """Composition of transducers: states are numbered as they are reached from the start."""

    def __init__(self, *parts: Transducer):
        start = (0,) * len(parts)
        self.number, self.arcs, self.finals = {start: 0}, [], []
        todo = [start]
        while todo:
            state = todo.pop(0)
            row = {}
            for symbol in SYMBOLS:
                moves = [p.go(s, symbol) for p, s in zip(parts, state)]
                to = tuple(m[0] for m in moves)
                if to not in self.number:
                    self.number[to] = len(self.number)
                    todo.append(to)
                row[symbol] = (self.number[to], math.prod(m[1] for m in moves))
            self.arcs.append(row)
            ends = [p.final.get(s, (1.0, 0.0)) for p, s in zip(parts, state)]
            self.finals.append((math.prod(e[0] for e in ends), sum(e[1] for e in ends)))

    def weigh(self, symbols: list[tuple[str, float]]) -> float:
        """Weight of a clause of (symbol, weight of the word)."""
        state, total = 0, 0.0
        for symbol, weight in symbols:
            state, factor = self.arcs[state][symbol]
            if symbol == "insult":
                total += weight * factor
        factor, extra = self.finals[state]
        # what is said in milder ways, or to somebody, holds for threats too
        return (total + extra) * factor


class Scorer:
    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self.symbol = {w: s for s, group in WORDS.items() for w in group.split()}
        self.grammar = Grammar(INSULT, THREAT, TARGET, NEGATION, REPORT)
        self.triggers = ahocorasick.Automaton()
        for w in {*words, *beginnings, *WORDS["threat"].split()}:
            self.triggers.add_word(w, w)
        self.triggers.make_automaton()

    def read(self, word: str) -> tuple[str, float]:
        if word in self.words:
            return "insult", self.words[word]
        if word[:BEGINNING] in self.beginnings and len(word) > BEGINNING:
            return "insult", self.beginnings[word[:BEGINNING]]
        if word in self.symbol:
            return self.symbol[word], 0.0
        return ("quote" if word in '"“”«»' else "other"), 0.0

    def clauses(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, weight) of the clauses that match."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        done = -1
        for end, word in self.triggers.iter(low):
            at = end + 1 - len(word)
            if at < done or at and low[at - 1].isalpha():
                continue
            a = 1 + max(low.rfind(c, 0, at) for c in _END)
            b = min((x for c in _END if (x := low.find(c, end + 1)) >= 0), default=len(low))
            done = b
            weight = self.grammar.weigh([self.read(m.group()) for m in _WORD.finditer(low, a, b)])
            if weight > 0:
                yield a, b, weight

    def score(self, text: str) -> tuple[float, int, int, int]:
        """(score, clauses, start and end of the heaviest)."""
        total, n, best = 0.0, 0, (0.0, 0, 0)
        for a, b, w in self.clauses(text):
            total, n = total + w, n + 1
            if w > best[0]:
                best = (w, a, b)
        return total, n, best[1], best[2]


def _features(text: str) -> set[str]:
    words = {m.group() for m in re.finditer(r"[^\W\d_]+", text.lower())}
    return {"w" + w for w in words if len(w) > 3} | {"b" + w[:BEGINNING] for w in words if len(w) > BEGINNING}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer with the insults of the labelled sample besides the given ones."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct()
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    words, beginnings = dict(INSULTS), {}
    if not counts.get(1) or not counts.get(0):
        return Scorer(words, beginnings)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    size = {1: sample, 0: 2 * sample}
    share = F.when(F.col("toxic") == 1, int((1 << 30) * min(1.0, size[1] / counts[1])) + 1).otherwise(int((1 << 30) * min(1.0, size[0] / counts[0])) + 1)
    # the sample is bounded, so its ids may go to every executor
    chosen = F.broadcast(known.where(spread < share))

    def count(batches):
        seen: Counter[tuple[str, int]] = Counter()
        total: Counter[int] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                total[toxic] += 1
                seen.update((f, toxic) for f in _features(text))
        rows = [(f, t, n) for (f, t), n in seen.items()] + [("", t, n) for t, n in total.items()]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["feature", "toxic", "n"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = texts.join(chosen, "doc_id").select("text", "toxic").mapInArrow(count, "feature string, toxic int, n bigint")
    found = found.groupBy("feature").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("bad"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("good"))
    size = found.where("feature = ''").first()
    if size is None or not size.bad or not size.good:
        return Scorer(words, beginnings)
    # the smoothed odds ratio
    lift = ((F.col("bad") + 0.5) / (size.bad + 1)) / ((F.col("good") + 0.5) / (size.good + 1))
    least = F.when(F.col("feature").startswith("b"), 5).otherwise(3)
    for r in found.where(F.col("feature") != "").where((F.col("bad") >= least) & (lift >= 25) & (F.col("good") <= 0.02 * F.col("bad"))).collect():
        (words if r.feature[0] == "w" else beginnings).setdefault(r.feature[1:], 1.0)
    return Scorer(words, beginnings)


def toxic(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, clauses, start, end, clause) of every document whose score reaches the
    threshold: how many clauses match, and the heaviest with its characters."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.words, scorer.beginnings))

    def scan(batches):
        run = Scorer(*shared.value)
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                total, n, a, b = run.score(text)
                if total >= threshold:
                    rows.append(row)
                    out.append((round(total, 6), n, a, b, text[a:b].strip()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())],
                ["doc_id", "score", "clauses", "start", "end", "clause"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return texts.mapInArrow(scan, "doc_id bigint, score double, clauses bigint, start bigint, `end` bigint, clause string")

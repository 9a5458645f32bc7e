"""Eight signals of a candidate sequence, their weighted sum, and the ranking of a window.

sequences: (keys, seq_id, tokens array, originals array); candidates: (keys, pos, token, text,
edit_distance, sources); keys name a window.  Positions count from 0 within the window."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Weights:
    word: float = 1.0
    syllable: float = 0.4
    ngram: float = 1.4
    domain: float = 1.2
    ocr: float = 1.0
    edit: float = 0.6
    overcorrection: float = 1.3
    negative: float = 1.5


SIGNALS = ("word", "syllable", "ngram", "domain", "ocr", "edit", "overcorrection", "negative")


#: What a known syllable counts, and what a change of a known word needs as an excuse: a bigram of such a
#: score, and so much more than before.
PER_SYLLABLE, LEAST, GAIN = 0.3, 0.5, 0.2


def total(w: Weights = Weights()) -> Column:
    plus = [w.word * F.col("word"), w.syllable * F.col("syllable"), w.ngram * F.col("ngram"), w.domain * F.col("domain"), w.ocr * F.col("ocr"), w.edit * F.col("edit")]
    return reduce(lambda a, b: a + b, plus) - w.overcorrection * F.col("overcorrection") - w.negative * F.col("negative")


def confidence(raw: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 5.0) / 10.0))


def positions(sequences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq_id, pos, token, original) of every sequence."""
    pairs = F.arrays_zip(F.col("tokens").alias("t"), F.col("originals").alias("o"))
    rows = sequences.select(*keys, "seq_id", F.posexplode(pairs).alias("pos", "p"))
    return rows.select(*keys, "seq_id", "pos", F.col("p").getField("t").alias("token"), F.col("p").getField("o").alias("original"))


def known_tokens(rows: DataFrame, words: DataFrame, column: str, per: float, keys: list[str], out: str) -> DataFrame:
    """per for every token in words (column)."""
    table = words.select(F.col(column).alias("token")).distinct().withColumn("hit", F.lit(per))
    return rows.join(table, "token", "left").groupBy(*keys, "seq_id").agg(F.coalesce(F.sum("hit"), F.lit(0.0)).alias(out))


def ngram_signal(rows: DataFrame, ngrams: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the scores of all 2-, 3- and 4-grams of content tokens."""
    own = Window.partitionBy(*keys, "seq_id").orderBy("pos")
    ahead = rows.where(F.trim("token") != "").withColumn("ahead", F.collect_list("token").over(own.rowsBetween(0, 3)))
    grams = ahead.select(*keys, "seq_id", F.explode(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.when(F.size("ahead") >= n, F.array_join(F.slice("ahead", F.lit(1), n), " ")))).alias("ngram"))
    table = ngrams.where(F.col("kind").isin("bigram", "trigram", "fourgram")).groupBy("ngram").agg(F.max("score").alias("score"))
    return grams.join(table, "ngram").groupBy(*keys, "seq_id").agg(F.sum("score").alias("ngram"))


def whole_window(sequences: DataFrame, ngrams: DataFrame, kind: str, keys: list[str], out: str, domain: str | None = None) -> DataFrame:
    """Score of the phrase that the sequence's content is as a whole."""
    table = ngrams.where(F.col("kind") == kind)
    if domain is not None:
        table = table.where(F.col("domain") == domain)
    table = table.groupBy(F.col("ngram").alias("phrase")).agg(F.max("score").alias(out))
    rows = sequences.select(*keys, "seq_id", F.array_join(F.filter("tokens", lambda t: F.trim(t) != ""), " ").alias("phrase"))
    return rows.join(table, "phrase").select(*keys, "seq_id", out)


def edit_and_ocr(rows: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """edit: 1 for what is unchanged, and 1 / (1 + distance) for each change, at every position of the
    window that has the same original; ocr likewise 1 where the change is a known confusion."""
    unchanged = rows.groupBy(*keys, "seq_id").agg(F.sum(F.when(F.col("token") == F.col("original"), 1.0).otherwise(0.0)).alias("same"))
    changed = rows.where("token <> original").select(*keys, "seq_id", "token", "original")
    found = candidates.select(*keys, F.col("token").alias("original"), F.col("text").alias("token"), "edit_distance", F.array_contains("sources", "ocr_confusion").alias("is_ocr"))
    hits = changed.join(found, [*keys, "original", "token"]).groupBy(*keys, "seq_id").agg(
        F.sum(F.coalesce(1.0 / (1.0 + F.col("edit_distance")), F.lit(0.0))).alias("near"), F.sum(F.when(F.col("is_ocr"), 1.0).otherwise(0.0)).alias("ocr")
    )
    both = unchanged.join(hits, [*keys, "seq_id"], "left")
    return both.select(*keys, "seq_id", (F.col("same") + F.coalesce("near", F.lit(0.0))).alias("edit"), F.coalesce("ocr", F.lit(0.0)).alias("ocr"))


def is_restored(original: Column, token: Column) -> Column:
    """Whether a token only adds accents to an original that has none."""
    return ~T.contains_vietnamese(original) & T.contains_vietnamese(token) & (T.strip_accents(token) == F.lower(original))


def overcorrection(rows: DataFrame, words: DataFrame, lexicon: DataFrame, ngrams: DataFrame, keys: list[str], least: float = LEAST, gain: float = GAIN) -> DataFrame:
    """Share of the changes that touch a known word without an excuse.

    Excuses: the original has no accents and the lexicon has the accented form, or a bigram with an
    original neighbour reaches least and gains at least gain."""
    own = Window.partitionBy(*keys, "seq_id").orderBy("pos")
    content = rows.where(F.trim("original") != "").withColumns({"left": F.lag("original").over(own), "right": F.lead("original").over(own)})
    changes = rows.where("token <> original").join(content.select(*keys, "seq_id", "pos", "left", "right"), [*keys, "seq_id", "pos"], "left")
    table = ngrams.where(F.col("kind") == "bigram").groupBy("ngram").agg(F.max("score").alias("s"))
    for name, a, b in (("l0", "left", "original"), ("l1", "left", "token"), ("r0", "original", "right"), ("r1", "token", "right")):
        t = table.select(F.col("ngram").alias("__n"), F.col("s").alias(name))
        changes = changes.join(t, F.concat(F.col(a), F.lit(" "), F.col(b)) == F.col("__n"), "left").drop("__n").withColumn(name, F.coalesce(name, F.lit(0.0)))
    better = ((F.col("l1") >= least) & (F.col("l1") >= F.col("l0") + gain)) | ((F.col("r1") >= least) & (F.col("r1") >= F.col("r0") + gain))
    forms = lexicon.select(F.lower("surface").alias("__s"), F.col("no_tone").alias("__k")).distinct().withColumn("__form", F.lit(True))
    changes = changes.join(forms, (F.lower("token") == F.col("__s")) & (T.strip_accents(F.col("original")) == F.col("__k")), "left")
    restored = is_restored(F.col("original"), F.col("token")) & F.col("__form").isNotNull()
    known = words.select(F.col("surface").alias("original")).distinct().withColumn("__known", F.lit(True))
    changes = changes.join(known, "original", "left")
    bad = F.when(F.col("__known").isNotNull() & ~better & ~restored, 1.0).otherwise(0.0)
    return changes.groupBy(*keys, "seq_id").agg(F.avg(bad).alias("overcorrection"))


def score(sequences: DataFrame, candidates: DataFrame, words: DataFrame, syllables: DataFrame, lexicon: DataFrame, ngrams: DataFrame, keys: list[str], domain: str | None = None, weights: Weights = Weights()) -> DataFrame:
    """sequences with their signals, raw score, confidence and rank within the window (by score, then
    the order in which they were generated)."""
    rows = positions(sequences, keys)
    parts = [
        known_tokens(rows, words, "surface", 1.0, keys, "word"), known_tokens(rows, syllables, "surface", PER_SYLLABLE, keys, "syllable"), ngram_signal(rows, ngrams, keys),
        edit_and_ocr(rows, candidates, keys), overcorrection(rows, words, lexicon, ngrams, keys), whole_window(sequences, ngrams, "negative", keys, "negative"),
        whole_window(sequences, ngrams, "domain", keys, "domain", domain) if domain is not None else None,
    ]
    out = sequences
    for p in parts:
        if p is not None:
            out = out.join(p, [*keys, "seq_id"], "left")
    if domain is None:
        out = out.withColumn("domain", F.lit(0.0))
    out = out.withColumns({s: F.coalesce(F.col(s), F.lit(0.0)) for s in SIGNALS}).withColumn("raw", F.round(total(weights), 10))
    order = Window.partitionBy(*keys).orderBy(F.desc("raw"), "seq_id")
    return out.withColumn("confidence", confidence(F.col("raw"))).withColumn("rank", F.row_number().over(order))


#: Kinds of evidence in the order in which they are given, and their signals.
EVIDENCE = (("ocr_confusion", "ocr"), ("phrase_ngram", "ngram"), ("edit_distance", "edit"), ("domain_context", "domain"))


def explanations(scored: DataFrame, keys: list[str], weights: Weights = Weights()) -> DataFrame:
    """(keys, seq_id, pos, original, corrected, evidence) of every changed position: each kind of evidence
    whose signal of the sequence is positive, with what it adds to the score and a message."""
    original, token = F.col("original"), F.col("corrected")
    message = {
        "ocr_confusion": F.concat(F.lit("known confusion of "), original, F.lit(" with "), token), "phrase_ngram": F.lit("n-grams of the sequence are known"),
        "edit_distance": F.lit("near to the original"), "domain_context": F.lit("phrase of the domain"),
    }
    rows = positions(scored, keys).where("token <> original").withColumnRenamed("token", "corrected").join(scored.select(*keys, "seq_id", *SIGNALS), [*keys, "seq_id"])
    found = F.array_compact(F.array(*(
        F.when(F.col(signal) > 0, F.struct(F.lit(kind).alias("kind"), message[kind].alias("message"), (getattr(weights, signal) * F.col(signal)).alias("delta"))) for kind, signal in EVIDENCE
    )))
    return rows.select(*keys, "seq_id", "pos", "original", "corrected", found.alias("evidence"))

"""Lexicon look-ups as joins.

Tables: lexicon (entry_ord, surface, no_tone, kind, freq, domain, tags), abbreviations (surface,
exp_ord, expansion), confusions (noisy, corr_ord, correction), phrases (phrase, no_tone, n,
confidence, domain), ngrams (kind, domain, ngram, score).  Lexicons are broadcast by Spark where they
are under its size limit, and shuffled beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def by_surface(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    return tokens.join(lexicon, tokens[token] == lexicon["surface"])


def by_no_tone(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    keyed = tokens.withColumn("__key", T.strip_accents(F.col(token)))
    return keyed.join(lexicon, keyed["__key"] == lexicon["no_tone"]).drop("__key")


def by_abbreviation(tokens: DataFrame, abbreviations: DataFrame, token: str = "token") -> DataFrame:
    return tokens.join(abbreviations.withColumnRenamed("surface", "abbreviation"), F.col(token) == F.col("abbreviation"))


def by_confusion(tokens: DataFrame, confusions: DataFrame, token: str = "token") -> DataFrame:
    return tokens.join(confusions, tokens[token] == confusions["noisy"])


def by_prefix(tokens: DataFrame, lexicon: DataFrame, size: int = 3, token: str = "token") -> DataFrame:
    """Entries whose key begins like the token's."""
    keyed = tokens.withColumn("__p", F.substring(T.strip_accents(F.col(token)), 1, size))
    return keyed.join(lexicon.withColumn("__q", F.substring("no_tone", 1, size)), F.col("__p") == F.col("__q")).drop("__p", "__q")


def flagged(rows: DataFrame, known: DataFrame, left: str, right: str, flag: str) -> DataFrame:
    """rows with whether left occurs in known."""
    keys = known.select(F.col(right).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    return rows.join(keys, rows[left] == keys["__key"], "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def first_loaded(*sources: DataFrame, key: str) -> DataFrame:
    """Union of sources in which the first source that has a key wins."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def ngram_score(rows: DataFrame, ngrams: DataFrame, kind: str, key: Column, out: str) -> DataFrame:
    """rows with the score of the n-gram under key; unknown ones have 0."""
    table = ngrams.where(F.col("kind") == kind).groupBy(F.col("ngram").alias("__n")).agg(F.max("score").alias("__s"))
    return rows.withColumn("__k", key).join(table, F.col("__k") == F.col("__n"), "left").withColumn(out, F.coalesce("__s", F.lit(0.0))).drop("__k", "__n", "__s")


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def covers(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= c) & (d <= b)

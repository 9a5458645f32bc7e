"""Batch jobs that build lexicons and n-gram tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.tokens import ngrams

SOURCE_CONFIDENCE = {"uvd": 0.90, "underthesea": 0.95, "aspell": 0.92, "names": 0.80}
SOURCE_WEIGHT = {"curated": 1.0, "domain": 0.95, "sqlite": 0.90, "lexicon": 0.85, "mined": 0.45}


def merge_words(words: DataFrame, confidence: dict[str, float] = SOURCE_CONFIDENCE, order: str = "ord") -> DataFrame:
    """One entry per normalized form of rows (source, surface, normalized, no_tone, ord): the first
    surface, the distinct sources, and a confidence that grows with them."""
    own = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in confidence.items() for x in (k, v))), F.element_at("sources", 1)), F.lit(0.5))
    rows = words.groupBy("normalized").agg(F.min_by("surface", order).alias("surface"), F.min_by("no_tone", order).alias("no_tone"), F.sort_array(F.collect_set("source")).alias("sources"))
    n = F.size("sources")
    kind = F.when((n == 1) & (F.element_at("sources", 1) == "names"), "name").when(F.contains("normalized", F.lit(" ")), "phrase").otherwise("word")
    return rows.select("normalized", "surface", "no_tone", n.alias("n_sources"), F.when(n >= 3, 1.0).when(n == 2, 0.98).otherwise(own).alias("confidence"), kind.alias("kind"))


def no_tone_index(entries: DataFrame) -> DataFrame:
    """entries with their rank within the no-tone key: confidence, sources, words, then the form."""
    words = F.size(F.split("normalized", " "))
    order = Window.partitionBy("no_tone").orderBy(F.desc("confidence"), F.desc("n_sources"), F.desc(words), "normalized")
    return entries.withColumn("rank", F.row_number().over(order))


def syllable_frequencies(docs: DataFrame, text: str = "text", pattern: str = r"^\p{L}{1,7}$") -> DataFrame:
    """(no_tone, surface, cnt, freq) of lower-case words; freq is the share within the no-tone key."""
    words = docs.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("surface")).where(F.col("surface").rlike(pattern))
    rows = words.groupBy("surface").agg(F.count("*").alias("cnt")).withColumn("no_tone", T.strip_accents(F.col("surface")))
    return rows.select("no_tone", "surface", "cnt", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy("no_tone"))).alias("freq"))


def as_lexicon(frequencies: DataFrame) -> DataFrame:
    """Lexicon rows of mined syllables, in a fixed order of entries."""
    order = F.xxhash64("surface")
    none = F.lit(None).cast("string")
    return frequencies.select(order.alias("entry_ord"), "surface", "no_tone", F.lit("common_word").alias("kind"), "freq", none.alias("domain"), F.array().cast("array<string>").alias("tags"))


def first_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of every key: insert, or ignore."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def statistics(lexicon: DataFrame) -> DataFrame:
    """Entries, distinct surfaces and keys by kind and in all, in one pass over grouping sets."""
    rows = lexicon.rollup("kind").agg(
        F.count("*").alias("entries"), F.countDistinct("surface").alias("surfaces"), F.countDistinct("no_tone").alias("keys"), F.count("domain").alias("with_domain")
    )
    return rows.withColumn("kind", F.coalesce("kind", F.lit("*")))


def dedup_phrases(phrases: DataFrame, order: str = "ord") -> DataFrame:
    """Of phrases (source, phrase, score, ord) with equal lower-case words, that of greatest weight
    times score, of equals the first."""
    weight = F.element_at(F.create_map(*(F.lit(x) for k, v in SOURCE_WEIGHT.items() for x in (k, v))), F.col("source"))
    rows = phrases.withColumn("tokens", T.phrase_tokens(F.col("phrase"))).withColumn("key", F.array_join("tokens", " ")).withColumn("weighted", F.round(weight * F.col("score"), 10))
    return first_by(rows, "key", F.struct(-F.col("weighted"), F.col(order)))


def build_ngrams(phrases: DataFrame) -> DataFrame:
    """(n, ngram, score) of phrases (tokens, weighted): the phrase itself has its score, shorter
    n-grams .85 of it and bigrams .70, within .05 and 1; the greatest counts."""
    size = F.size("tokens")
    rows = phrases.where(size >= 2).select(size.alias("size"), "weighted", F.explode(ngrams(F.col("tokens"), 2, 4)).alias("ngram"))
    n = F.size(F.split("ngram", " "))
    factor = F.when(n == F.col("size"), 1.0).when(n >= 3, 0.85).otherwise(0.70)
    rows = rows.select(n.alias("n"), "ngram", F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("weighted") * factor)).alias("score"))
    return rows.groupBy("n", "ngram").agg(F.round(F.max("score"), 10).alias("score"))


def as_store(ngram_rows: DataFrame, domains: DataFrame | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """(kind, domain, ngram, score) of built n-grams, domain phrases and negative phrases."""
    kind = F.element_at(F.array(F.lit("bigram"), F.lit("trigram"), F.lit("fourgram")), F.col("n") - 1)
    out = ngram_rows.select(kind.alias("kind"), F.lit(None).cast("string").alias("domain"), "ngram", "score")
    for rows, name in ((domains, "domain"), (negatives, "negative")):
        if rows is not None:
            keys = ["domain", "ngram"] if name == "domain" else ["ngram"]
            top = rows.groupBy(*keys).agg(F.max("score").alias("score"))
            out = out.unionByName(top.select(F.lit(name).alias("kind"), (F.col("domain") if name == "domain" else F.lit(None).cast("string")).alias("domain"), "ngram", "score"))
    return out

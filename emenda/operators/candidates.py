"""Candidate generation: sources as joins, merge by text, ranking, limits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import lookup
from .tokens import IDENTITY_ONLY

#: Weight of a source for ranking, and its place in the order of sources.
SOURCES = {
    "original": (0, 0.10), "ocr_confusion": (1, 0.30), "syllable_map": (2, 0.20), "word_lexicon": (3, 0.25), "abbreviation": (4, 0.15),
    "phrase_evidence": (5, 0.35), "domain_specific": (6, 0.20), "edit_distance": (7, 0.05),
}
WORD_KINDS = ("common_word", "unit_word", "name", "location", "brand")
MAX_CANDIDATES = 32
_COLUMNS = ("text", "source", "entry_ord", "prior", "edit_distance", "syllable_freq", "word_freq", "known_word", "replacement_tokens")


@dataclass
class Lexicons:
    """Tables that candidates come from; what is None contributes nothing."""

    lexicon: DataFrame | None = None
    syllables: DataFrame | None = None
    abbreviations: DataFrame | None = None
    confusions: DataFrame | None = None
    phrases: DataFrame | None = None
    domain: str | None = None
    keys: list[str] = field(default_factory=lambda: ["doc_id", "tok_idx"])


def _row(lx: Lexicons, rows: DataFrame, source: str, text: Column, prior: Column, **extra: Column) -> DataFrame:
    none = {
        "entry_ord": F.lit(0), "edit_distance": F.lit(None).cast("int"), "syllable_freq": F.lit(None).cast("double"), "word_freq": F.lit(None).cast("double"),
        "known_word": F.lit(False), "replacement_tokens": F.lit(1),
    }
    cols = {"text": text, "source": F.lit(source), "prior": prior.cast("double")} | none | extra
    return rows.select(*lx.keys, "token", *(cols[c].cast({"entry_ord": "bigint", "replacement_tokens": "int"}.get(c)) .alias(c) if c in ("entry_ord", "replacement_tokens") else cols[c].alias(c) for c in _COLUMNS))


def identity(tokens: DataFrame, lx: Lexicons) -> DataFrame:
    return _row(lx, tokens.where(F.col("token") != ""), "original", F.col("token"), F.lit(0.10))


def from_confusions(words: DataFrame, lx: Lexicons, most: int = 2) -> DataFrame:
    rows = lookup.by_confusion(words, lx.confusions).where((F.col("corr_ord") < most) & (F.col("correction") != F.col("token")))
    return _row(lx, rows, "ocr_confusion", F.col("correction"), F.lit(0.30), entry_ord=F.col("corr_ord"))


def from_syllables(words: DataFrame, lx: Lexicons) -> DataFrame:
    rows = lookup.by_no_tone(words, lx.syllables).where(F.col("surface") != F.col("token"))
    return _row(
        lx, rows, "syllable_map", F.col("surface"), 0.20 + 0.2 * F.col("freq"), entry_ord=F.col("entry_ord"),
        edit_distance=F.levenshtein("token", "surface"), syllable_freq=F.col("freq"),
    )


def from_words(words: DataFrame, lx: Lexicons) -> DataFrame:
    rows = lookup.by_no_tone(words, lx.lexicon).where(F.col("kind").isin(*WORD_KINDS) & (F.col("surface") != F.col("token")))
    return _row(lx, rows, "word_lexicon", F.col("surface"), 0.25 + 0.3 * F.col("freq"), entry_ord=F.col("entry_ord"), word_freq=F.col("freq"), known_word=F.lit(True))


def from_abbreviations(words: DataFrame, lx: Lexicons) -> DataFrame:
    rows = lookup.by_abbreviation(words, lx.abbreviations).where(F.col("expansion") != F.col("token"))
    return _row(lx, rows, "abbreviation", F.col("expansion"), F.lit(0.15), entry_ord=F.col("exp_ord"), replacement_tokens=F.size(F.split("expansion", " ")))


def from_domain(words: DataFrame, lx: Lexicons) -> DataFrame:
    """Entries of a domain or with a tag; if a domain is asked for, only its own."""
    rows = lookup.by_no_tone(words, lx.lexicon).where(F.col("surface") != F.col("token"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    rows = rows.where(F.col("domain").isNotNull() | (F.size(tags) > 0))
    if lx.domain is not None:
        rows = rows.where((F.col("domain") == lx.domain) | F.contains(F.coalesce("domain", F.lit("")), F.lit(lx.domain)) | F.array_contains(tags, lx.domain))
    return _row(lx, rows, "domain_specific", F.col("surface"), 0.20 + 0.2 * F.col("freq"), entry_ord=F.col("entry_ord"), word_freq=F.col("freq"), known_word=F.lit(True))


def _deletions(key: Column) -> Column:
    """The key, and the key without each of its characters: keys one edit apart have one in common."""
    less = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(key.substr(F.lit(1), i - 1), key.substr(i + 1, F.length(key))))
    return F.array_distinct(F.concat(F.array(key), less))


def from_edits(words: DataFrame, lx: Lexicons, most: int = 3) -> DataFrame:
    """The first entries with the same beginning of three letters whose keys are one edit away.

    They meet by what is left when a character is deleted, so that the join is on equal keys of which
    few words share any."""
    n = F.length("token")
    near = words.where((n >= 3) & (n <= 20)).withColumn("__key", T.strip_accents(F.col("token")))
    forms = near.select("__key").distinct().withColumn("__part", F.explode(_deletions(F.col("__key"))))
    keys = lx.lexicon.select("no_tone").where(F.length("no_tone").between(2, 21)).distinct().withColumn("__part", F.explode(_deletions(F.col("no_tone"))))
    pairs = forms.join(keys, "__part").where(F.substring("__key", 1, 3) == F.substring("no_tone", 1, 3)).select("__key", "no_tone").distinct()
    pairs = pairs.withColumn("d", F.levenshtein("__key", "no_tone", 1)).where((F.col("d") > 0) & (F.col("d") <= 1))
    rows = near.join(pairs, "__key").drop("__key").join(lx.lexicon, "no_tone").where(F.col("surface") != F.col("token"))
    rank = F.row_number().over(Window.partitionBy(*lx.keys, "token").orderBy("entry_ord"))
    rows = rows.withColumn("r", rank).where(F.col("r") <= most)
    return _row(lx, rows, "edit_distance", F.col("surface"), 0.05 + 0.1 * F.col("freq") - 0.05 * F.col("d"), entry_ord=F.col("entry_ord"), edit_distance=F.col("d"), word_freq=F.col("freq"))


def phrase_evidence(tokens: DataFrame, proposals: DataFrame, lx: Lexicons, most: int = 4) -> DataFrame:
    """A row for every proposed text that makes a known phrase with its neighbours.

    Windows of 2 w - 1 raw tokens around the token, spaces included, are tried for w = 1 ... most; the
    first that matches a phrase without accents counts."""
    doc = [k for k in lx.keys if k != "tok_idx"]
    own = Window.partitionBy(*doc).orderBy("tok_idx")
    around = tokens.select(
        *lx.keys, F.collect_list("token").over(own.rowsBetween(-(most - 1), -1)).alias("left"), F.collect_list("token").over(own.rowsBetween(1, most - 1)).alias("right")
    )
    texts = proposals.select(*lx.keys, "token", "text").distinct().join(around, lx.keys)
    at = F.explode(F.sequence(F.lit(1), F.lit(most)))
    rows = texts.withColumn("w", at).withColumn(
        "joined",
        T.normalize_key(F.array_join(F.concat(F.slice("left", F.greatest(F.size("left") - F.col("w") + 2, F.lit(1)), F.col("w") - 1), F.array("text"), F.slice("right", F.lit(1), F.col("w") - 1)), "")),
    )
    known = lx.phrases.select(F.col("no_tone").alias("joined")).distinct()
    hit = rows.join(known, "joined", "left_semi").groupBy(*lx.keys, "token", "text").agg(F.min("w").alias("w"))
    return _row(lx, hit, "phrase_evidence", F.col("text"), F.lit(0.0))


def is_word() -> Column:
    """Whether a token (token_type, protected) may have candidates besides itself."""
    return ~(F.col("token_type").isin(*IDENTITY_ONLY) | F.col("protected"))


def _sources(lx: Lexicons) -> list[Callable[[DataFrame, Lexicons], DataFrame]]:
    found = []
    if lx.confusions is not None:
        found.append(from_confusions)
    if lx.syllables is not None:
        found.append(from_syllables)
    if lx.lexicon is not None:
        found += [from_words, from_domain, from_edits]
    if lx.abbreviations is not None:
        found.append(from_abbreviations)
    return found


def proposals(tokens: DataFrame, lx: Lexicons) -> DataFrame:
    """All proposals for tokens (keys, token, token_type, protected), one row per source and text."""
    words = tokens.where(is_word())
    return reduce(DataFrame.unionByName, [identity(tokens, lx), *(f(words, lx) for f in _sources(lx))])


def distinct(words: DataFrame) -> DataFrame:
    """The distinct tokens of words, written, as every source reads them."""
    return written(words.select("token").distinct(), "forms")


def others(tokens: DataFrame, lx: Lexicons, sources: Sequence[Callable[[DataFrame, Lexicons], DataFrame]] | None = None) -> DataFrame:
    """Merged candidates (token, text, ...) of every distinct word but the word itself, which no source proposes."""
    forms = distinct(tokens.where(is_word()))
    once = replace(lx, keys=[])
    found = [f(forms, once) for f in (_sources(lx) if sources is None else sources)]
    return merge(reduce(DataFrame.unionByName, found or [identity(forms, once).limit(0)]), [])


def own(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """What merge() makes of identity(), row by row."""
    none = lambda kind: F.lit(None).cast(kind)
    place, weight = SOURCES["original"]
    return tokens.where(F.col("token") != "").select(
        *keys, "token", F.col("token").alias("text"), F.array(F.lit("original")).alias("sources"), F.lit(1).cast("bigint").alias("evidence"), F.lit(0.10).alias("prior"),
        none("int").alias("edit_distance"), F.lit(False).alias("known_word"), none("double").alias("syllable_freq"), none("double").alias("word_freq"), F.lit(1).alias("replacement_tokens"),
        F.lit(weight).alias("source_weight"), F.struct(F.lit(place).alias("s"), F.lit(0).cast("bigint").alias("entry_ord")).alias("ordinal"), F.lit(True).alias("is_original"),
    )


def placed(tokens: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of all tokens, by what others() found, ranked or not: words are joined to it, and the tokens
    themselves, spaces included, need no join."""
    rows = own(tokens, keys)
    if "rank" in found.columns:
        rows = rows.withColumn("score", F.round(ranking_score(), 10)).withColumn("rank", F.lit(1))
    return rows.unionByName(tokens.where(is_word()).select(*keys, "token").join(found, "token"))


def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate per token and text: sources united, best values, order of first proposal."""
    order = F.element_at(F.create_map(*(F.lit(x) for k, (i, _) in SOURCES.items() for x in (k, i))), F.col("source"))
    weight = F.element_at(F.create_map(*(F.lit(x) for k, (_, w) in SOURCES.items() for x in (k, w))), F.col("source"))
    return rows.groupBy(*keys, "token", "text").agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.count("*").alias("evidence"), F.max("prior").alias("prior"), F.min("edit_distance").alias("edit_distance"),
        F.max("known_word").alias("known_word"), F.max("syllable_freq").alias("syllable_freq"), F.max("word_freq").alias("word_freq"),
        F.max("replacement_tokens").alias("replacement_tokens"), F.max(weight).alias("source_weight"), F.min(F.struct(order.alias("s"), F.col("entry_ord"))).alias("ordinal"),
    ).withColumn("is_original", F.col("text") == F.col("token"))


def ranking_score() -> Column:
    """Score by which candidates are ranked; the beam uses prior instead."""
    raw = (
        F.col("source_weight") + F.when(F.col("known_word"), 0.05).otherwise(0.0) + 0.3 * F.coalesce("syllable_freq", F.lit(0.0)) + 0.15 * F.coalesce("word_freq", F.lit(0.0))
        + F.when(F.col("is_original"), 0.05).otherwise(0.0) + 0.02 * F.least(F.col("evidence"), F.lit(5))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def rank(candidates: DataFrame, keys: list[str], most: int = MAX_CANDIDATES) -> DataFrame:
    """The best candidates of each token, the original first."""
    distance = F.when(F.coalesce("edit_distance", F.lit(0)) == 0, 999).otherwise(F.col("edit_distance"))
    order = Window.partitionBy(*keys).orderBy(
        F.desc("is_original"), F.desc("score"), F.desc(F.coalesce("word_freq", F.lit(0.0))), F.desc(F.coalesce("syllable_freq", F.lit(0.0))), F.desc("evidence"), distance, "ordinal", "text"
    )
    rows = candidates.withColumn("score", F.round(ranking_score(), 10))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rank_others(found: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """The best of others() for each token; the token itself is the first."""
    return rank(found, ["token"], most - 1).withColumn("rank", F.col("rank") + 1)


def generate(tokens: DataFrame, lx: Lexicons, most: int = MAX_CANDIDATES) -> DataFrame:
    """Ranked candidates of all tokens: sources, phrase evidence, merge, limits.

    Look-ups, and without phrases the ranking too, are made once for every distinct token, however often
    it occurs."""
    if lx.phrases is None:
        return placed(tokens, rank_others(others(tokens, lx), most), lx.keys)
    form = F.struct("token", "token_type", "protected")
    places = tokens.select(*lx.keys, form.alias("form"))
    forms = places.select("form").distinct().select("form", "form.*")
    rows = places.join(proposals(forms, replace(lx, keys=["form"])), "form").drop("form")
    rows = rows.unionByName(phrase_evidence(tokens, rows.where(F.col("text") != ""), lx))
    return rank(merge(rows, lx.keys), lx.keys, most)


def statistics(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """Counters over all tokens, each with itself and what others() found for it; tokens are counted before they
    are joined."""
    places = tokens.where(F.col("token") != "").groupBy("token", is_word().alias("word")).agg(F.count("*").alias("places"))
    per = found.groupBy("token").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence")).withColumn("word", F.lit(True))
    rows = places.join(per, ["token", "word"], "left").select("places", (F.coalesce("n", F.lit(0)) + 1).alias("n"), (F.coalesce("evidence", F.lit(0)) + 1).alias("evidence"))
    total = lambda c: F.sum(c * F.col("places"))
    return rows.agg(
        F.coalesce(F.sum("places"), F.lit(0)).alias("tokens"), total(F.col("n")).alias("candidates"), F.max("n").alias("most"), F.round(total(F.col("n")) / F.sum("places"), 6).alias("mean"),
        total(F.when(F.col("n") > 1, 1).otherwise(0)).alias("ambiguous"), total(F.col("evidence")).alias("evidence"),
    )

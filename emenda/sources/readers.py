"""Readers of texts, lexicon resources and gold data.

All resources are read with a fixed schema.  Lists in which the first or the last entry of a key
wins carry the order of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

WORDS = "surface string, normalized string, type string, freq double, domain string, tags array<string>"
ABBREVIATIONS = "abbreviation string, normalized string, expansions array<string>, tags array<string>, ambiguous boolean"
CONFUSIONS = "noisy string, corrections array<string>, confidence double"
PHRASES = "phrase string, normalized string, n int, freq double, domain string"
GOLD = "id string, input string, expected string, allowed_outputs array<string>, domain string, tags array<string>, should_change boolean, protected_substrings array<string>, notes string"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, stripped; empty ones are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("text"))
    return rows.where(F.col("text") != "")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row (line_no, line) per line that is not blank."""
    rows = docs.select("*", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def lexicon_words(raw: DataFrame, domain: str | None = None) -> DataFrame:
    """Lexicon entries of raw words: defaults, kinds, and keys from the surface."""
    return raw.where(F.col("surface").isNotNull()).select(
        "surface", T.strip_accents(F.col("surface")).alias("no_tone"), T.infer_kind(F.coalesce("type", F.lit("word"))).alias("kind"),
        F.coalesce("freq", F.lit(1.0)).alias("freq"), F.coalesce("domain", F.lit(domain)).alias("domain"),
    )


def lexicon_units(raw: DataFrame) -> DataFrame:
    return lexicon_words(raw.withColumn("type", F.lit("unit")), "measurement")


def syllable_forms(raw: DataFrame) -> DataFrame:
    """(base, surface, freq) of rows (base, forms, freqs): 0.5 where a form has no frequency."""
    return raw.select("base", F.explode("forms").alias("surface"), "freqs").select("base", "surface", F.coalesce(F.try_element_at("freqs", F.col("surface")), F.lit(0.5)).alias("freq"))


def abbreviations(raw: DataFrame) -> DataFrame:
    """(surface, exp_ord, expansion, ambiguous); ambiguous by default where there are several."""
    rows = raw.select(F.col("abbreviation").alias("surface"), "expansions", F.coalesce("ambiguous", F.size("expansions") > 1).alias("ambiguous"))
    return rows.select("surface", "ambiguous", F.posexplode("expansions").alias("exp_ord", "expansion"))


def confusions(raw: DataFrame, order: str = "ord") -> DataFrame:
    """(noisy, corr_ord, correction, confidence); the last row of a noisy form counts."""
    own = Window.partitionBy("noisy").orderBy(F.desc(order))
    rows = raw.withColumn("__r", F.row_number().over(own)).where("__r = 1")
    return rows.select("noisy", F.coalesce("confidence", F.lit(0.7)).alias("confidence"), F.posexplode("corrections").alias("corr_ord", "correction"))


def phrases(raw: DataFrame, recount: bool = False) -> DataFrame:
    """(phrase, no_tone, n, confidence, domain): n as given, or from the words."""
    n = F.size(T.phrase_tokens(F.col("phrase"))) if recount else F.col("n")
    rows = raw.select("phrase", T.normalize_key(F.col("phrase")).alias("no_tone"), n.alias("n"), F.coalesce("freq", F.lit(0.5)).alias("confidence"), "domain")
    return rows.where("n >= 2") if recount else rows


def term_list(raw: DataFrame, line: str = "line") -> DataFrame:
    """Distinct terms, one per line, without blank lines and comments."""
    return raw.select(F.trim(line).alias("term")).where("term <> '' and not startswith(term, '#')").distinct()


def raw_words(raw: DataFrame, source: str, fmt: str, line: str = "line") -> DataFrame:
    """(source, surface, normalized, no_tone) of dictionary lines in one of the formats plain, jsonl,
    affix (a count, then word/FLAGS) and names (only what has letters beyond ASCII)."""
    word = F.col(line)
    if fmt == "jsonl":
        word = F.get_json_object(word, "$.text")
    elif fmt == "affix":
        raw = raw.where(~F.col(line).rlike(r"^\s*\d+\s*$"))
        word = F.substring_index(word, "/", 1)
    rows = raw.select(F.trim(word).alias("surface")).where(F.col("surface").isNotNull())
    rows = rows.withColumn("normalized", F.lower(F.regexp_replace("surface", r"(?U)\s+", " ")))
    if fmt == "names":
        rows = rows.where(~T.is_ascii(F.col("surface")) & ~T.is_ascii(F.col("normalized")))
    rows = rows.where(T.garbage_reason(F.col("surface")).isNull())
    return rows.select(F.lit(source).alias("source"), "surface", "normalized", T.strip_accents(F.col("normalized")).alias("no_tone"))


def ngram_store(raw: DataFrame) -> DataFrame:
    """(kind, domain, ngram, score) of a store with maps bigrams, trigrams, fourgrams, negative_phrases
    (n-gram to score) and domain_phrases (domain to such a map)."""
    names = {"bigrams": "bigram", "trigrams": "trigram", "fourgrams": "fourgram", "negative_phrases": "negative"}
    out = None
    for column, kind in names.items():
        rows = raw.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("domain"), F.explode(column).alias("ngram", "score"))
        out = rows if out is None else out.unionByName(rows)
    domains = raw.select(F.explode("domain_phrases").alias("domain", "m")).select(F.lit("domain").alias("kind"), "domain", F.explode("m").alias("ngram", "score"))
    return out.unionByName(domains)


def gold(raw: DataFrame, line: str = "line") -> DataFrame:
    """Examples from JSON lines; blank lines are skipped, a missing id, input or expected fails."""
    rows = raw.where(F.trim(line) != "").withColumn("g", F.from_json(line, GOLD))
    must = F.coalesce(F.col("g.id"), F.raise_error(F.concat(F.lit("id is missing: "), F.col(line))).cast("string"))
    ok = lambda c: F.coalesce(F.col(f"g.{c}"), F.raise_error(F.concat(F.lit(f"{c} is missing: "), F.col(line))).cast("string"))
    empty = F.array().cast("array<string>")
    return rows.select(
        must.alias("id"), ok("input").alias("input"), ok("expected").alias("expected"), F.coalesce("g.allowed_outputs", empty).alias("allowed_outputs"), "g.domain",
        F.coalesce("g.tags", empty).alias("tags"), "g.should_change", F.coalesce("g.protected_substrings", empty).alias("protected_substrings"), "g.notes",
    )


def parse_json_array(raw: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """One row per element of the JSON arrays of a column."""
    return raw.select(F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("e")).select("e.*")


def snapshot_entries(raw: DataFrame) -> DataFrame:
    """Entries of a database snapshot (surface, no_tone, kind, freq, conf): a frequency of zero counts as
    missing, and a missing confidence is the frequency."""
    freq = F.when(F.coalesce("freq", F.lit(0.0)) == 0, 1.0).otherwise(F.col("freq"))
    return raw.select("surface", "no_tone", "kind", freq.alias("freq"), F.when(F.coalesce("conf", F.lit(0.0)) == 0, freq).otherwise(F.col("conf")).alias("confidence"))


def hybrid(first: DataFrame, second: DataFrame, key: str, rule: str) -> DataFrame:
    """Two sources of one kind of entry: rule keep (the first one's entry of a key wins), overwrite (the
    second's wins) or append."""
    if rule == "append":
        return first.unionByName(second)
    a, b = (first, second) if rule == "keep" else (second, first)
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def domain_phrases(raw: DataFrame, score: float = 0.95) -> DataFrame:
    return raw.select("domain", F.explode("phrases").alias("ngram")).withColumn("score", F.lit(score))


def tokenized_phrases(raw: DataFrame, default: float = 1.0) -> DataFrame:
    """Phrases (phrase, tokens, n, score) of at least two words whose n is right."""
    rows = raw.where((F.col("n") >= 2) & (F.col("n") == F.size("tokens")))
    return rows.select("phrase", "tokens", "n", F.coalesce("score", F.lit(default)).alias("score"))

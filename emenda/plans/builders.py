"""Lexicon builds: raw rows to typed entries, checks of what came out, statistics and the package.

Every builder is a select over rows with the columns of validation.SCHEMAS; an entry of any kind has the
same columns, so that a build is the union of its parts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

#: Confidence where a row has none.
DEFAULTS = {"syllables": 0.5, "words": 1.0, "phrases": 0.5, "confusions": 0.7, "abbreviations": 1.0}
TYPES = {"syllables": "LexiconEntry", "words": "LexiconEntry", "phrases": "PhraseEntry", "confusions": "OcrConfusionEntry", "abbreviations": "AbbreviationEntry"}
_COLUMNS = {
    "builder": "string", "ord": "bigint", "sub": "int", "entry_id": "string", "type": "string", "surface": "string", "normalized": "string", "no_tone": "string", "kind": "string",
    "n": "int", "values": "array<string>", "ambiguous": "boolean", "confidence": "double", "frequency": "double", "domain": "string", "tags": "array<string>",
}


def _entries(rows: DataFrame, builder: str, prefix: str, surface: Column, **columns: Column) -> DataFrame:
    given = {"builder": F.lit(builder), "ord": F.col("ord"), "sub": F.lit(0), "entry_id": F.concat(F.lit(f"{prefix}/"), surface), "type": F.lit(TYPES[builder]), "surface": surface} | columns
    return rows.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()))


def syllables(raw: DataFrame, default: float = DEFAULTS["syllables"]) -> DataFrame:
    """An entry for every form of rows (ord, base, forms, freq)."""
    rows = raw.select("ord", F.coalesce("base", F.lit("")).alias("base"), "freq", F.posexplode("forms").alias("sub", "form"))
    confidence = F.coalesce(F.try_element_at("freq", F.col("form")), F.lit(default))
    return _entries(rows, "syllables", "syllable", F.col("form"), sub=F.col("sub"), normalized=F.col("form"), no_tone=F.col("base"), kind=F.lit("syllable"), confidence=confidence, frequency=confidence, tags=F.array(F.lit("syllable")))


def words(raw: DataFrame, default: float = DEFAULTS["words"]) -> DataFrame:
    """An entry for every row (ord, surface, type, freq, domain) with a surface."""
    rows, kind = raw.where(F.col("surface") != ""), F.coalesce("type", F.lit("word"))
    inferred = F.when(kind == "unit_word", "unit").when(kind == "chemical", "domain_term").when(kind == "brand", "brand").otherwise("word")
    freq = F.coalesce("freq", F.lit(default))
    return _entries(rows, "words", "word", F.col("surface"), normalized=F.lower("surface"), no_tone=T.strip_accents(F.col("surface")), kind=inferred, confidence=freq, frequency=freq, domain=F.col("domain"), tags=F.array(kind))


def phrases(raw: DataFrame, default: float = DEFAULTS["phrases"]) -> DataFrame:
    """An entry for every row (ord, phrase, n, freq, domain, tags) with a phrase."""
    rows, freq, key = raw.where(F.col("phrase") != ""), F.coalesce("freq", F.lit(default)), T.strip_accents(F.col("phrase"))
    return _entries(rows, "phrases", "phrase", F.col("phrase"), normalized=key, no_tone=key, n=F.coalesce("n", F.lit(0)), confidence=freq, frequency=freq, domain=F.col("domain"), tags=F.coalesce("tags", F.array().cast("array<string>")))


def confusions(raw: DataFrame, default: float = DEFAULTS["confusions"]) -> DataFrame:
    """An entry for every row (ord, noisy, corrections, confidence) with both."""
    rows = raw.where((F.col("noisy") != "") & (F.size("corrections") > 0))
    return _entries(rows, "confusions", "ocr", F.col("noisy"), no_tone=T.strip_accents(F.col("noisy")), values=F.col("corrections"), confidence=F.coalesce("confidence", F.lit(default)))


def abbreviations(raw: DataFrame, default: float = DEFAULTS["abbreviations"]) -> DataFrame:
    """An entry for every row (ord, abbreviation, normalized, expansions, tags, ambiguous) with both."""
    rows = raw.where((F.col("abbreviation") != "") & (F.size("expansions") > 0))
    return _entries(
        rows, "abbreviations", "abbrev", F.col("abbreviation"), normalized=F.coalesce("normalized", F.lower("abbreviation")), values=F.col("expansions"),
        ambiguous=F.coalesce("ambiguous", F.size("expansions") > 1), confidence=F.lit(default), tags=F.coalesce("tags", F.array().cast("array<string>")),
    )


BUILDERS = {"syllables": syllables, "words": words, "phrases": phrases, "confusions": confusions, "abbreviations": abbreviations}


def output_errors(entries: DataFrame) -> DataFrame:
    """(builder, ord, sub, error) of what is wrong with built entries."""
    kind = F.col("builder")
    empty = F.array_compact(F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v, i: F.when((kind == "abbreviations") & (F.coalesce(v, F.lit("")) == ""), F.concat(F.lit("expansion "), i.cast("string"), F.lit(" is empty")))))
    checks = F.array_compact(F.array(
        F.when(F.coalesce("surface", F.lit("")) == "", "surface is empty"),
        F.when(kind.isin("syllables", "words") & (F.coalesce("no_tone", F.lit("")) == ""), "key is empty"),
        F.when((kind == "syllables") & (F.col("kind") != "syllable"), "kind is not syllable"),
        F.when((kind == "phrases") & (F.col("n") < 1), "n is less than one"),
        F.when(kind.isin("words", "phrases") & (F.col("frequency") < 0), "frequency is negative"),
        F.when((kind == "confusions") & ~F.col("confidence").between(0.0, 1.0), "confidence is not between 0 and 1"),
    ))
    rows = entries.select("builder", "ord", "sub", F.posexplode(F.concat(checks, empty)).alias("i", "error"))
    return rows.select("builder", "ord", "sub", "i", F.concat(F.lit("["), kind, F.lit("] ["), F.col("ord").cast("string"), F.lit("] "), F.col("error")).alias("error"))


def statistics(entries: DataFrame) -> DataFrame:
    """(what, name, n): entries, distinct surfaces and keys in all, and entries by kind and by domain."""
    kind = F.coalesce("kind", F.when(F.col("builder") == "phrases", "phrase").when(F.col("builder") == "confusions", "ocr_confusion").otherwise("abbreviation"))
    key = F.when(F.col("no_tone") != "", F.col("no_tone"))
    whole = entries.agg(F.count("*").alias("entries"), F.countDistinct("surface").alias("surfaces"), F.countDistinct(key).alias("keys"))
    parts = whole.select(F.explode(F.create_map(*(x for c in ("entries", "surfaces", "keys") for x in (F.lit(c), F.col(c))))).alias("name", "n")).select(F.lit("total").alias("what"), "name", "n")
    kinds = entries.groupBy(kind.alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), "name", "n")
    domains = entries.where(F.col("domain") != "").groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("n")).select(F.lit("domain").alias("what"), "name", "n")
    return parts.union(kinds).union(domains)


def package_rows(entries: DataFrame) -> DataFrame:
    """(builder, ord, sub, json): entries as they stand in a package, without fields that they lack."""
    record = F.struct(
        "entry_id", "type", "surface", "normalized", "no_tone", "kind", F.when(F.col("confidence").isNotNull(), F.struct("confidence", "frequency")).alias("score"),
        F.when(F.col("domain") != "", F.col("domain")).alias("domain"), "tags",
    )
    return entries.select("builder", "ord", "sub", F.to_json(record, {"ignoreNullFields": "true"}).alias("json"))


@dataclass
class Build:
    """What a build gives: tables, and the warnings of parts that had no data."""

    entries: DataFrame
    errors: DataFrame
    stats: DataFrame
    metadata: DataFrame
    warnings: list[str] = field(default_factory=list)


def build(parts: dict[str, DataFrame | None], version: str, source: str = "built-in", validate: bool = True) -> Build:
    """All five builders over their parts.  A part that is missing or has no rows is skipped with a
    warning; of none at all a build of no entries comes out."""
    warnings, tables = [], []
    for name, builder in BUILDERS.items():
        raw = parts.get(name)
        if raw is None or raw.isEmpty():
            warnings.append(f"no data for '{name}', skipped")
        else:
            tables.append(builder(raw))
    spark = next((p for p in parts.values() if p is not None)).sparkSession
    entries = spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in _COLUMNS.items()))
    for t in tables:
        entries = entries.unionByName(t)
    entries = written(entries, "lexicon")
    errors = output_errors(entries if validate else entries.where("false"))
    origin = "corpus" if source != "built-in" else "built-in"
    metadata = entries.agg(F.count("*").alias("entries")).select(F.lit(version).alias("version"), F.lit(source).alias("source"), F.lit(origin).alias("origin"), "entries")
    return Build(entries, errors, statistics(entries), metadata, warnings)


def export(built: Build, path: str, mode: str = "overwrite") -> None:
    """The package below path: entries and metadata as JSON lines, statistics and errors as tables."""
    package_rows(built.entries).orderBy("builder", "ord", "sub").select("json").write.mode(mode).text(f"{path}/entries")
    built.metadata.write.mode(mode).json(f"{path}/metadata")
    built.stats.write.mode(mode).json(f"{path}/stats")
    built.errors.write.mode(mode).json(f"{path}/errors")

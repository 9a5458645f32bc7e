"""Correction of single texts, on the same plan as whole tables.

One text costs a job of its own; texts that come together belong in a table, for plans.correct.correct."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import correct as plan


class CorrectionError(Exception):
    """What goes wrong in a correction."""


class InputTooLargeError(CorrectionError):
    """A text is longer than the configuration allows."""


@dataclass(frozen=True)
class Result:
    original: str
    corrected: str
    confidence: float
    changes: list[dict[str, Any]] = field(default_factory=list)
    flags: list[dict[str, Any]] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    def lines(self) -> str:
        """The result for reading."""
        out = [f"Original:  {self.original}", f"Corrected: {self.corrected}", f"Confidence: {self.confidence:.2%}"]
        if self.changes:
            out += ["Changes:", *(f"  [{c['start']}:{c['end']}] {c['original']!r} -> {c['replacement']!r}" for c in self.changes)]
        if self.flags:
            out += ["Flags:", *(f"  {f['flag']}: [{f['start']}:{f['end']}] {f.get('suggestion') or ''}" for f in self.flags)]
        return "\n".join(out)


def empty_resources(spark: SparkSession) -> plan.Resources:
    """No words at all: every text is its own correction."""
    words = spark.createDataFrame([], "entry_ord bigint, surface string, no_tone string, kind string, freq double, domain string, tags array<string>")
    return plan.Resources(words, words, None, None, None, spark.createDataFrame([], "kind string, domain string, ngram string, score double"))


def resources(entries: DataFrame, ngrams: DataFrame | None = None) -> plan.Resources:
    """Resources of lexicon entries as sources.databases.load gives them, and an n-gram table (kind, domain,
    ngram, score)."""
    order = F.xxhash64("entry_id").alias("entry_ord")
    kind = F.when(F.col("kind") == "word", "common_word").when(F.col("kind") == "unit", "unit_word").otherwise(F.col("kind"))
    row = (order, "surface", "no_tone", kind.alias("kind"), F.col("confidence").alias("freq"), "domain", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    expansions = entries.where("kind_of = 'abbreviation'").select("surface", "ambiguous", F.posexplode("values").alias("exp_ord", "expansion"))
    confusions = entries.where("kind_of = 'confusion'").select(F.col("surface").alias("noisy"), "confidence", F.posexplode("values").alias("corr_ord", "correction"))
    phrases = entries.where("kind_of = 'phrase'").select(F.col("surface").alias("phrase"), "no_tone", "n", "confidence", "domain")
    none = empty_resources(entries.sparkSession).ngrams
    return plan.Resources(
        entries.where("kind_of in ('word', 'unit')").select(*row), entries.where("kind_of = 'syllable'").select(*row), expansions, confusions, phrases, none if ngrams is None else ngrams
    )


class Corrector:
    """Corrects texts one by one with the same resources and configuration."""

    def __init__(self, spark: SparkSession, own: plan.Resources | None = None, config: plan.Config = plan.Config(), fail_closed: bool = True):
        self.spark, self.resources, self.config, self.fail_closed = spark, own or empty_resources(spark), config, fail_closed

    def correct(self, text: str, domain: str | None = None) -> Result:
        """The correction of text.  A text that is no string or too long is an error of the caller; any
        other failure gives the text as it is, with confidence 0 and a flag, if fail_closed says so."""
        if not isinstance(text, str):
            raise TypeError("a text must be a string")
        if len(text) > self.config.max_chars:
            raise InputTooLargeError(f"the text has {len(text)} characters, {self.config.max_chars} are allowed")
        if not text:
            return Result(text, text, 1.0)
        try:
            return self._run(text, domain)
        except Exception:
            if not self.fail_closed:
                raise
            flag = {"start": 0, "end": len(text), "flag": "no_safe_correction", "suggestion": None}
            return Result(text, text, 0.0, [], [flag], {"status": "fail_closed"})

    def _run(self, text: str, domain: str | None) -> Result:
        config = replace(self.config, domain=domain) if domain is not None else self.config
        docs = self.spark.createDataFrame([(0, text)], "doc_id bigint, text string")
        row = plan.correct(docs, self.resources, config).first()
        whole = row.asDict(recursive=True)
        return Result(text, row.corrected, row.confidence, whole["changes"], whole["flags"], {"status": row.status} | (whole["metadata"] or {}))


_default: list[Corrector] = []


def use(corrector: Corrector) -> None:
    """Makes a corrector the one that correct_text takes by itself."""
    _default[:] = [corrector]


def correct_text(text: str, domain: str | None = None, *, config: plan.Config | None = None, corrector: Corrector | None = None) -> Result:
    """The correction of one text by a corrector, by the default one, or by the default's resources under
    another configuration."""
    if corrector is None:
        if not _default:
            spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
            use(Corrector(spark))
        corrector = _default[0]
        if config is not None:
            corrector = Corrector(corrector.spark, corrector.resources, config, corrector.fail_closed)
    return corrector.correct(text, domain)

"""Evaluation of corrections against gold texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def error_rate(distance: Column, length: Column) -> Column:
    """distance / length; an empty expectation has 0 or 1."""
    return F.when(length == 0, F.when(distance == 0, 0.0).otherwise(1.0)).otherwise(distance / length)


def cer(output: Column, expected: Column) -> Column:
    return error_rate(T.char_distance(output, expected), F.length(expected))


def wer(output: Column, expected: Column) -> Column:
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return error_rate(T.word_distance(words(output), words(expected)), F.size(words(expected)))


def evaluate(rows: DataFrame, with_wer: bool = True) -> DataFrame:
    """rows (input, output, expected, allowed_outputs, should_change, protected_substrings) with the
    verdicts of each: exact, accepted, changed, over, under, violation and error rates.

    should_change may be null; then neither over- nor undercorrection is counted."""
    changed = F.col("input") != F.col("output")
    accepted = F.array_contains("allowed_outputs", F.col("output")) | (F.col("output") == F.col("expected"))
    should = F.coalesce(F.col("should_change"), F.lit(None).cast("boolean"))
    violation = F.exists("protected_substrings", lambda s: F.contains("input", s) & ~F.contains("output", s))
    out = rows.withColumns({
        "exact": F.col("output") == F.col("expected"), "accepted": accepted, "changed": changed,
        "over": F.coalesce(~should & changed, F.lit(False)), "under": F.coalesce(should & ~changed, F.lit(False)), "violation": F.coalesce(violation, F.lit(False)),
        "cer_before": cer(F.col("input"), F.col("expected")), "cer_after": cer(F.col("output"), F.col("expected")),
    })
    if with_wer:
        out = out.withColumns({"wer_before": wer(F.col("input"), F.col("expected")), "wer_after": wer(F.col("output"), F.col("expected"))})
    return out


def report(evaluated: DataFrame, *by: str) -> DataFrame:
    """Sums and means over all examples, or over groups; no examples give zeros."""
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).cast("bigint").alias(c)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    before, after = F.coalesce(F.avg("cer_before"), F.lit(0.0)), F.coalesce(F.avg("cer_after"), F.lit(0.0))
    return evaluated.groupBy(*by).agg(
        F.count("*").alias("examples"), *(count(c) for c in ("exact", "accepted", "changed", "over", "under", "violation")),
        mean("cer_before").alias("cer_before"), mean("cer_after").alias("cer_after"),
        F.round(F.when(before > 0, (before - after) / before * 100).otherwise(0.0), 6).alias("improvement"),
    )


def worst(evaluated: DataFrame, key: str, n: int = 5) -> DataFrame:
    return evaluated.orderBy(F.desc("cer_after"), key).limit(n)


def gate(reported: DataFrame, least_accepted: float = 0.0, most_over: float = 1.0, most_violations: int = 0) -> DataFrame:
    """reported with whether it passes."""
    n = F.greatest(F.col("examples"), F.lit(1))
    return reported.withColumn("passed", (F.col("accepted") / n >= least_accepted) & (F.col("over") / n <= most_over) & (F.col("violation") <= most_violations))

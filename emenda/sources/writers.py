"""Writers and renderers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, json) with all columns as one JSON object; text stays as it is."""
    return df.select(*keys, F.to_json(F.struct("*")).alias("json"))


def lexicon_jsonl(entries: DataFrame) -> DataFrame:
    """JSON lines of entries (surface, normalized, no_tone, kind, confidence, source)."""
    name = F.concat(F.lit("lex:"), F.col("normalized"), F.lit(":"), F.col("kind"))
    row = F.struct(name.alias("entry_id"), "surface", "normalized", "no_tone", "kind", "confidence", "source")
    return entries.select(F.to_json(row).alias("json"))


def change_line(start: Column, end: Column, original: Column, replacement: Column, confidence: Column) -> Column:
    return F.format_string("[%d:%d] '%s' -> '%s' (%.2f%%)", start, end, original, replacement, confidence * 100)


def result_text(original: Column, corrected: Column, confidence: Column, changes: Column, flags: Column) -> Column:
    """A result for reading: both texts, the confidence, and a line for every change and flag."""
    change = lambda c: F.concat(F.lit("  "), change_line(c["start"], c["end"], c["original"], c["replacement"], c["confidence"]))
    flag = lambda f: F.format_string("  %s: [%d:%d] %s", f["flag"], f["start"], f["end"], F.coalesce(f["suggestion"], F.lit("")))
    head = F.array(F.concat(F.lit("Original:  "), original), F.concat(F.lit("Corrected: "), corrected), F.format_string("Confidence: %.2f%%", confidence * 100))
    none = F.array().cast("array<string>")
    some = lambda rows, name, line: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(name)), F.transform(rows, line))).otherwise(none)
    return F.array_join(F.concat(head, some(changes, "Changes:", change), some(flags, "Flags:", flag)), "\n")


def candidate_lines(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, line) of every token: its candidates by rank, with sources and scores."""
    one = F.struct("rank", F.format_string("%s %.3f [%s]", F.col("text"), F.col("score"), F.array_join("sources", ", ")).alias("line"))
    rows = candidates.groupBy(*keys, "token").agg(F.sort_array(F.collect_list(one)).alias("c"))
    return rows.select(*keys, "token", F.array_join(F.transform("c", lambda x: x["line"]), "; ").alias("line"))


def window_lines(scored: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """(keys, rank, line) of the best sequences of every window."""
    line = F.format_string("%d. %s score=%.4f confidence=%.4f", F.col("rank"), F.array_join("tokens", " "), F.col("raw"), F.col("confidence"))
    return scored.where(F.col("rank") <= top).select(*keys, "rank", line.alias("line"))


def explanation_lines(explained: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq_id, pos, line) of explanations."""
    one = lambda e: F.format_string("%s: %s (%+.3f)", e["kind"], e["message"], e["delta"])
    line = F.concat(F.format_string("[%d] %s -> %s: ", F.col("pos"), F.col("original"), F.col("corrected")), F.array_join(F.transform("evidence", one), "; "))
    return explained.select(*keys, "seq_id", "pos", line.alias("line"))


def token_lines(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    index = F.col("tok_idx").cast("string")
    padded = F.when(F.length(index) < 3, F.lpad(index, 3, " ")).otherwise(index)
    text = lambda c: F.coalesce(c, F.lit("null"))
    line = F.concat(text(padded), F.lit(" "), text(F.col("token")), F.lit(" "), text(F.col("token_type")), F.when(F.col("protected"), " [protected]").otherwise(""))
    return tokens.select(key, "tok_idx", line.alias("line"))


def tables(parts: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each part as a Parquet table below path."""
    for name, df in parts.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of several tables."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")).select("name", "rows")
        out = row if out is None else out.unionByName(row)
    return out

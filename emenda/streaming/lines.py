"""Correction over unbounded inputs.

The correction of a document needs nothing but the document, so a stream needs no state and no
watermark: micro-batches go through the batch plan as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def line_source(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one document per line that is not blank, of text files that arrive in path.  Equal
    lines have equal doc_ids, and are documents of their own all the same."""
    rows = spark.readStream.text(path).where(F.trim("value") != "")
    return rows.select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("text"))


def normalized(stream: DataFrame) -> DataFrame:
    """The stateless columns of the pipeline, on a stream or a table."""
    clean = T.normalize_whitespace(T.remove_invisible(F.col("text")))
    return stream.select("*", clean.alias("clean"), T.strip_accents(clean).alias("key"), T.case_pattern(clean).alias("pattern"))


def run(stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch job to every micro-batch, each written once under its number."""

    def batch(df: DataFrame, number: int) -> None:
        job(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

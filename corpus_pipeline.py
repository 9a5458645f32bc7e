"""From raw documents to packed training windows, one operator after the other.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents.

1. language ID drops documents without a recognisable language;
2. the n-gram Jaccard join keeps the least doc_id of each group of near duplicates;
3. substring dedup cuts passages that an earlier document has out of the text, and drops documents
   of which no word is left;
4. decontamination drops documents that hold a benchmark item;
5. packing gives one row per training window, with its documents and the parts it has of them.

Rows with a null doc_id can't be told apart: stages 2, 3 and 4 pass them on, and packing packs them.
Rows with a null or empty text go in the first stage.  Rows that share a doc_id are one document: they
stay or go together, and are packed as often as they occur.  Of equal documents the least doc_id stays.
Other columns, of whatever name, come along to the last stage.  Empty tables give no windows, and without a
benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emenda.llm import decontaminate, jaccard, langid, packing, runtime, substring


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.tune(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.tune(spark)
    gone = jaccard.near_duplicates(docs).select("doc_id")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["doc_id"], "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.tune(spark)
    left = substring.without_repeats(docs)
    return left.where(left["text"].rlike(r"[^\x00-\x7f]|[0-9a-zA-Z]"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.tune(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.tune(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("packing", windows),
]

#: Hashed features, tokenizers and clusters: SQL can't express the stages; tests/llm compares each
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

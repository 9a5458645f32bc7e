"""Command line: correct texts, look into a lexicon, show candidates.

    python -m emenda.cli correct [--domain D] [--json] [--interactive] [TEXT ...]
    python -m emenda.cli lexicon info | lookup WORD | candidates KEY | validate
    python -m emenda.cli candidates TEXT ...

All take --lexicon FOLDER of JSON files, --database FILE and --mode json, sqlite or hybrid."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import text as T
from .operators import candidates as C
from .operators import tokens as K
from .plans import validation
from .sources import databases, readers, writers

#: Files of a lexicon folder and what they hold.
FILES = {
    "syllables.vi.json": "syllable", "words.vi.json": "word", "units.vi.json": "unit", "abbreviations.vi.json": "abbreviation", "foreign_words.json": "foreign_words",
    "phrases.vi.json": "phrase", "ocr_confusions.vi.json": "ocr_confusion",
}


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--lexicon", help="folder of JSON lexicon files")
    common.add_argument("--database", help="SQLite lexicon")
    common.add_argument("--mode", choices=["json", "sqlite", "hybrid"], default="json")
    out = argparse.ArgumentParser(prog="emenda", description="Correction of noisy accented text")
    sub = out.add_subparsers(dest="command", required=True)
    c = sub.add_parser("correct", parents=[common])
    c.add_argument("text", nargs="*")
    c.add_argument("--domain")
    c.add_argument("--json", action="store_true")
    c.add_argument("--interactive", "-i", action="store_true", help="a text on every line of the input")
    x = sub.add_parser("lexicon", parents=[common])
    x.add_argument("verb", choices=["info", "lookup", "candidates", "validate"])
    x.add_argument("word", nargs="?")
    k = sub.add_parser("candidates", parents=[common])
    k.add_argument("text", nargs="+")
    return out


def entries(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    if not args.lexicon and not args.database:
        return None
    return databases.load(spark, args.mode, args.lexicon, args.database)


def _info(lexicon: DataFrame) -> Iterable[str]:
    for r in lexicon.groupBy("kind_of").count().orderBy("kind_of").collect():
        yield f"{r.kind_of}: {r['count']}"


def _lookup(lexicon: DataFrame, word: str) -> Iterable[str]:
    key = lexicon.sparkSession.range(1).select(T.strip_accents(F.lit(word)).alias("key"))
    for name, rows in (("surface", lexicon.where(F.col("surface") == word)), ("accentless", lexicon.join(key, F.col("no_tone") == F.col("key")))):
        found = rows.orderBy("kind_of", "surface").collect()
        yield f"{name} match: {len(found)}" if found else f"no {name} match"
        for r in found:
            yield f"  [{r.kind or r.kind_of}] {r.surface} (confidence {r.confidence})"


def _candidates_of(lexicon: DataFrame, key: str) -> Iterable[str]:
    found = lexicon.where((F.col("kind_of") == "syllable") & (F.col("no_tone") == key)).orderBy(F.desc("confidence"), "surface").collect()
    yield f"candidates of {key!r}" if found else f"no candidates of {key!r}"
    for r in found:
        yield f"  {r.surface}  {r.confidence:.3f}"


def validate_folder(spark: SparkSession, folder: str) -> tuple[bool, list[str]]:
    """(whether all files are valid, a line for each with its errors)."""
    good, out = True, []
    for name, kind in FILES.items():
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            continue
        if kind == "foreign_words":
            with open(path, encoding="utf-8") as f:
                raw = spark.createDataFrame([(i, w if isinstance(w, str) else None) for i, w in enumerate(json.load(f))], "ord bigint, word string")
        else:
            raw = readers.json_array(spark, path, validation.SCHEMAS[kind]).coalesce(1).withColumn("ord", F.monotonically_increasing_id())
        errors = [r.error for r in validation.file_errors(raw, kind).orderBy("ord", "i").collect()]
        good &= not errors
        out += [f"[{'FAIL' if errors else 'PASS'}] {name}", *(f"    {e}" for e in errors)]
    return good, out


def show_candidates(spark: SparkSession, text: str, own: DataFrame | None) -> Iterable[str]:
    docs = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    r = api.resources(own) if own is not None else api.empty_resources(spark)
    toks = K.tokenize(docs).withColumn("protected", F.lit(False))
    found = C.generate(toks, C.Lexicons(r.lexicon, r.syllables, r.abbreviations, r.confusions, r.phrases))
    for x in writers.candidate_lines(found, ["doc_id", "tok_idx"]).orderBy("tok_idx").collect():
        yield f"[{x.tok_idx}] {x.token!r}: {x.line}"


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("emenda").getOrCreate()
    if args.command == "lexicon" and args.verb == "validate":
        good, lines = validate_folder(spark, args.lexicon)
        print("\n".join(lines))
        return 0 if good else 1
    lexicon = entries(spark, args)
    if args.command == "lexicon":
        if lexicon is None or args.verb != "info" and not args.word:
            print("a lexicon, and a word to look up, are needed", file=sys.stderr)
            return 2
        print("\n".join(_info(lexicon) if args.verb == "info" else (_lookup if args.verb == "lookup" else _candidates_of)(lexicon, args.word)))
        return 0
    if args.command == "candidates":
        print("\n".join(show_candidates(spark, " ".join(args.text), lexicon)))
        return 0
    corrector = api.Corrector(spark, api.resources(lexicon) if lexicon is not None else None)
    texts = (line.rstrip("\n") for line in sys.stdin) if args.interactive else [" ".join(args.text) or sys.stdin.read().strip()]
    some = False
    for text in texts:
        if text:
            some = True
            result = corrector.correct(text, args.domain)
            print(json.dumps(result.as_dict(), ensure_ascii=False) if args.json else result.lines())
    if not some and not args.interactive:
        print("no text is given", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

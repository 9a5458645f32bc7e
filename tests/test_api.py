"""Single texts, the command line, lexicon files and databases, packages, matcher folders."""

import json
import sqlite3

import pytest

from emenda import api, cli
from emenda.catalog import correction
from emenda.operators import spans
from emenda.plans import builders, validation
from emenda.plans.correct import Config
from emenda.sources import databases

WORDS = [{"surface": "muỗng", "normalized": "muỗng", "type": "word", "freq": 0.9}, {"surface": "", "freq": 2.0}, {"surface": "gạt", "normalized": "gạt", "domain": "sữa"}]
SYLLABLES = [{"base": "muong", "forms": ["muỗng", "mường"], "freq": {"muỗng": 0.7}}, {"base": "so", "forms": ["số", "số", "xô"]}]


@pytest.fixture
def folder(tmp_path):
    files = {
        "words.vi.json": WORDS, "syllables.vi.json": SYLLABLES, "units.vi.json": [{"surface": "ml", "normalized": "ml"}],
        "phrases.vi.json": [{"phrase": "số muỗng", "normalized": "so muong", "n": 2, "freq": 0.9}], "foreign_words.json": ["baby", " "],
        "ocr_confusions.vi.json": [{"noisy": "mùông", "corrections": ["muỗng", " "], "confidence": 0.8}], "abbreviations.vi.json": [{"abbreviation": "tp", "expansions": ["thành phố", "thực phẩm"]}],
    }
    for name, data in files.items():
        (tmp_path / name).write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(tmp_path)


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "lexicon.db"
    con = sqlite3.connect(path)
    con.executescript(
        """CREATE TABLE lexicon_syllables (base, surface, freq, freq_count, freq_no_tone);
        CREATE TABLE lexicon_words (surface, type, freq, domain, normalized, no_tone, kind, source, confidence, tags);
        CREATE TABLE lexicon_units (surface, freq, domain); CREATE TABLE lexicon_foreign_words (word);
        CREATE TABLE lexicon_abbreviations (abbreviation, normalized, expansions, ambiguous, tags);
        CREATE TABLE lexicon_phrases (phrase, normalized, n, freq, domain);
        CREATE TABLE lexicon_ocr_confusions (noisy, normalized_noisy, corrections, confidence);
        INSERT INTO lexicon_syllables VALUES ('muong', 'muỗng', 0.4, 1, 1), ('gat', 'gạt', 0.6, 1, 1);
        INSERT INTO lexicon_words VALUES ('gạt', 'common_word', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL), ('kg', 'unit', 0.3, NULL, 'kg', 'kg', 'unit', 'x', 0.2, '["u"]'), ('kg', 'unit', 0.9, NULL, 'kg', 'kg', 'unit', 'x', 0.9, NULL);
        INSERT INTO lexicon_units VALUES ('kg', 0.5, NULL), ('ml', 0, 'volume');
        INSERT INTO lexicon_foreign_words VALUES ('milk');
        INSERT INTO lexicon_abbreviations VALUES ('tp', NULL, '["thành phố"]', 1, NULL);
        INSERT INTO lexicon_phrases VALUES ('số muỗng', NULL, NULL, 0, NULL), ('một', 'mot', 5, 0.7, NULL);
        INSERT INTO lexicon_ocr_confusions VALUES ('mùông', NULL, '["mường"]', 0);"""
    )
    con.commit()
    con.close()
    return str(path)


def test_database_rules(spark, database):
    rows = databases.lexicon(spark, database).collect()
    by = {r.entry_id: r for r in rows}
    assert len(by) == len(rows) == 11
    assert (by["word/gạt"].frequency, by["word/gạt"].confidence, by["word/gạt"].no_tone) == (1.0, 1.0, "gat")
    assert (by["word/kg"].frequency, by["word/kg"].confidence, by["word/kg"].tags) == (0.3, 0.2, ["u"])
    assert by["unit/kg"].frequency == 0.3 and by["unit/ml"].frequency == 1.0 and by["unit/ml"].domain == "volume" and by["unit/kg"].domain == "measurement"
    assert by["abbrev/tp"].ambiguous and by["phrase/số muỗng"].n == 2 and by["phrase/số muỗng"].frequency == 0.5 and by["ocr/mùông"].confidence == 0.7
    got = {(r.phrase, r.n, r.confidence) for r in databases.phrase_rows(spark, database).collect()}
    assert got == {("số muỗng", 2, 0.0)} and databases.phrase_rows(spark, database + ".none").count() == 0


def test_modes(spark, folder, database, tmp_path):
    both = databases.load(spark, "hybrid", folder, database).collect()
    by = {}
    for r in both:
        by.setdefault(r.entry_id, []).append(r)
    assert len(by["phrase/số muỗng"]) == 2 and all(len(v) == 1 for k, v in by.items() if k != "phrase/số muỗng")
    assert by["syllable/muỗng"][0].frequency == 0.7 and list(by["abbrev/tp"][0]["values"]) == ["thành phố"] and by["ocr/mùông"][0]["values"] == ["mường"]
    assert databases.load(spark, "sqlite", folder, str(tmp_path / "no.db")).count() == databases.load(spark, "json", folder).count()
    with pytest.raises(FileNotFoundError):
        databases.load(spark, "sqlite", folder, str(tmp_path / "no.db"), fallback=False)
    with pytest.raises(ValueError):
        databases.load(spark, "xml", folder)


def test_syllable_checks(spark):
    rows = [(0, "so", ["số", "số", "mô"], {"số": 2.0}), (1, None, None, None), (2, "", [], None), (3, "so", ["số"], {"số": 0.5})]
    raw = spark.createDataFrame(rows, "ord bigint, base string, forms array<string>, freq map<string,double>")
    got = {r.ord: r.errors for r in validation.entry_errors(raw, "syllable").collect()}
    assert got[3] == [] and got[1] == ["missing field 'base'", "missing field 'forms'"] and got[2] == ["'base' is empty", "'forms' is empty"]
    assert got[0] == ["form 'mô' has another base", "frequency of 'số' is not between 0 and 1", "form 'mô' has no frequency", "form 'số' is repeated"]
    assert [r.error for r in validation.file_errors(raw.where("ord = 2"), "syllable").orderBy("i").collect()] == ["[2] 'base' is empty", "[2] 'forms' is empty"]
    with pytest.raises(ValueError):
        validation.entry_errors(raw, "other")


def test_build_and_package(spark, tmp_path):
    words = spark.createDataFrame([(0, "Gạt", None, 0.5, None), (1, "", "brand", None, None), (2, "DHA", "chemical", -1.0, "sữa")], "ord bigint, surface string, type string, freq double, domain string")
    built = builders.build({"words": words, "phrases": None}, "2", "mine")
    assert [r.entry_id for r in built.entries.orderBy("ord").collect()] == ["word/Gạt", "word/DHA"] and len(built.warnings) == 4
    assert [r.error for r in built.errors.collect()] == ["[words] [2] frequency is negative"]
    assert built.metadata.first().asDict() == {"version": "2", "source": "mine", "origin": "corpus", "entries": 2}
    builders.export(built, str(tmp_path / "package"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "package" / "entries")).collect()]
    assert lines[1] == {"entry_id": "word/DHA", "type": "LexiconEntry", "surface": "DHA", "normalized": "dha", "no_tone": "dha", "kind": "domain_term", "score": {"confidence": -1.0, "frequency": -1.0}, "domain": "sữa", "tags": ["chemical"]}
    assert builders.build({"words": words.where("ord > 5")}, "1").entries.count() == 0


def test_matcher_folder(tmp_path):
    (tmp_path / "b.yaml").write_text("name: code\ntype: regex\npriority: 2\npatterns: ['X\\d+']\n")
    (tmp_path / "a.yaml").write_text("name: terms\nspan_type: chemical\ntype: lexicon\npriority: 9\nsource: terms.txt\n")
    (tmp_path / "terms.txt").write_text("# none\nDHA\n\nARA\n")
    (tmp_path / "c.yaml").write_text("name: nonsense\ntype: regex\npatterns: [x]\n")
    (tmp_path / "d.yaml").write_text("name: url\ntype: regex\n")
    (tmp_path / "e.yaml").write_text("- a list\n")
    (tmp_path / "f.yaml").write_text("name: date\ntype: lexicon\nsource: nowhere.txt\n")
    got = spans.matcher_folder(str(tmp_path))
    assert [(m.name, m.priority) for m in got] == [("chemical", 9), ("code", 2)] and len(got[0].patterns) == 2
    with pytest.raises(NotADirectoryError):
        spans.matcher_folder(str(tmp_path / "none"))


def test_single_texts(spark):
    own = api.Corrector(spark, correction.fixture_resources(spark))
    got = api.correct_text("So Muong gat ngang", corrector=own)
    assert got.corrected == "Số Muỗng gạt ngang" and got.changes and got.metadata["tokens"] == 7 and got.metadata["normalized"] == "so muong gat ngang" and got.metadata["accepted"] == len(got.changes)
    assert api.correct_text("", corrector=own) == api.Result("", "", 1.0)
    with pytest.raises(TypeError):
        api.correct_text(None, corrector=own)
    with pytest.raises(api.InputTooLargeError):
        api.correct_text("x" * 11, corrector=api.Corrector(spark, own.resources, Config(max_chars=10)))
    broken = correction.fixture_resources(spark)
    broken.lexicon = spark.range(1)
    closed = api.Corrector(spark, broken).correct("so muong")
    assert (closed.corrected, closed.confidence, closed.flags[0]["flag"], closed.metadata) == ("so muong", 0.0, "no_safe_correction", {"status": "fail_closed"})
    with pytest.raises(Exception):
        api.Corrector(spark, broken, fail_closed=False).correct("so muong")
    api.use(own)
    assert api.correct_text("quan he").original == "quan he"


def test_command_line(spark, folder, capsys, monkeypatch):
    def run(*args):
        code = cli.main(args, spark)
        return code, capsys.readouterr().out

    code, out = run("lexicon", "info", "--lexicon", folder)
    assert code == 0 and "syllable: 5" in out and "unit: 1" in out
    code, out = run("lexicon", "lookup", "muong", "--lexicon", folder)
    assert "no surface match" in out and "[word] muỗng (confidence 0.9)" in out and "[syllable] mường (confidence 0.5)" in out
    code, out = run("lexicon", "candidates", "muong", "--lexicon", folder)
    assert [x.split()[0] for x in out.splitlines()[1:]] == ["muỗng", "mường"]
    code, out = run("lexicon", "validate", "--lexicon", folder)
    assert code == 1 and "[PASS] units.vi.json" in out and "[FAIL] words.vi.json" in out and "[1] 'surface' is empty" in out and "[FAIL] foreign_words.json" in out
    code, out = run("candidates", "muong", "--lexicon", folder)
    assert code == 0 and out.startswith("[0] 'muong': muong") and "muỗng" in out
    code, out = run("correct", "--json", "hello")
    assert json.loads(out)["corrected"] == "hello"
    monkeypatch.setattr("sys.stdin", iter(["hello\n", "\n", "you\n"]))
    code, out = run("correct", "--interactive")
    assert out.count("Original:") == 2
    assert cli.main(["lexicon", "info"], spark) == 2

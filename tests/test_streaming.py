from emenda.functions import text as T
from emenda.streaming import lines
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Số MÙÔNG\n\n  \nMuỗng gạt\n")
    stream = lines.normalized(lines.line_source(spark, str(tmp_path / "in")))
    q = lines.run(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    got = {(r.text, r.key, r.pattern) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = spark.createDataFrame([("Số MÙÔNG",), ("Muỗng gạt",)], "text string").select("text", T.strip_accents(F.col("text")), T.case_pattern(F.col("text")))
    assert got == {tuple(r) for r in want.collect()}


def test_correction_of_a_stream_equals_batch(spark, tmp_path):
    """Equal lines in one batch are corrected each for itself."""
    from emenda.catalog import correction
    from emenda.plans import correct as P

    (tmp_path / "in").mkdir()
    texts = ["so muong gat ngang", "so muong gat ngang", "MOI QUAN HE.", "hello"]
    (tmp_path / "in" / "a.txt").write_text("\n".join(texts) + "\n")
    resources = correction.fixture_resources(spark)
    q = lines.run(lines.line_source(spark, str(tmp_path / "in")), lambda df: P.correct(df, resources), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = sorted((r.text, r.corrected, r.confidence) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = P.correct(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), resources)
    assert len(got) == 4 and got == sorted((r.text, r.corrected, r.confidence) for r in batch.collect())

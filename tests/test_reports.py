from pyspark.sql import functions as F

from paperloom.operators import extraction, reports


def test_views(spark):
    done = spark.createDataFrame([("a", "layout", True, None, 2.0), ("b", None, None, "bad", 4.0)], "document_id string, strategy string, escalated boolean, error string, seconds double")
    assert tuple(reports.batch_summary(done).first()) == (2, 1, 1, 1, 3.0)
    reasons = [r[0] for r in done.select(reports.strategy_reason(F.col("strategy"), F.coalesce("escalated", F.lit(False)))).collect()]
    assert reasons == ["layout was analysed after a page fell below the gate", "pages were read by several strategies"]
    rows = spark.createDataFrame([("one, two;;\n three", "x" * 200 + "Two" + "y" * 300)], "t string, body string")
    assert rows.select(reports.topics(F.col("t"))).first()[0] == ["one", "two", "three"]
    cut = rows.select(reports.topic_excerpt(F.col("body"), F.lit("TWO"))).first()[0]
    assert cut.startswith("x" * 80 + "Two") and len(cut) == 280
    assert reports.manifest(spark, {"a": ["1.pdf", "2.pdf"], "b": ["3.pdf"]}).count() == 3


def test_page_rules(spark):
    rows = spark.createDataFrame([("x" * 90, 0.0, 1, False), ("x", 0.0, 1, False), ("x" * 90, 0.0, 3, False), ("x" * 90, 0.8, 1, True)], "t string, i double, n int, b boolean")
    assert [r[0] for r in rows.select(extraction.page_plan(F.col("t"), F.col("i"), F.col("n"), F.col("b"))).collect()] == ["fast_text", "vision", "layout", "vision"]
    notes = spark.createDataFrame([(0, 0.0, False), (200, 0.95, True), (200, 0.8, True), (200, 0.1, True), (200, 0.1, False)], "c int, w double, t boolean")
    assert [r[0] for r in notes.select(extraction.noted_plan(F.col("c"), F.col("w"), F.col("t"))).collect()] == ["vision", "vision", "fast_text", "layout", "fast_text"]

from pyspark.sql import functions as F

from paperloom.operators import extraction, records

PAGE = "document_id string, page_num int, text string, confidence double, strategy string"


def test_ladder_and_routes(spark):
    rows = spark.createDataFrame([("fast_text",), ("layout",), ("vision",), ("other",)], "s string")
    assert [r[0] for r in rows.select(extraction.next_strategy(F.col("s"))).collect()] == ["layout", "vision", "vision", "vision"]
    docs = spark.createDataFrame([("native_digital", "multi_column", "x", None), ("native_digital", "single_column", "x", "vision"), ("mixed", "x", "x", "hybrid"), ("unknown", "x", "fast_text", None)], "o string, l string, r string, f string")
    assert [r[0] for r in docs.select(extraction.routed(F.col("o"), F.col("l"), F.col("r"), F.col("f"))).collect()] == ["layout", "vision", "layout", "fast_text"]


def test_escalation_replaces_low_pages_once(spark):
    pages = spark.createDataFrame([("d", 1, "a", 0.69, "fast_text"), ("d", 2, "b", 0.7, "fast_text"), ("d", 3, "c", 0.1, "layout")], PAGE)
    more = spark.createDataFrame([("d", 1, "A", 0.2, "layout"), ("d", 2, "B", 0.9, "layout")], PAGE)
    got = [(r.page_num, r.text, r.confidence, r.strategy, r.escalated) for r in extraction.escalated(pages, more).orderBy("page_num").collect()]
    assert got == [(1, "A", 0.2, "layout", True), (2, "b", 0.7, "fast_text", False), (3, "c", 0.1, "vision", True)]
    rolled = extraction.extraction_rollup(extraction.escalated(pages, more)).first()
    assert (rolled.pages_processed, rolled.n_escalated, rolled.escalated) == (3, 2, True)


def test_confidences(spark):
    rows = spark.createDataFrame([(150, 0), (150, 1), (10, 0)], "n int, t int")
    got = [tuple(round(x, 4) for x in r) for r in rows.select(extraction.layout_confidence(F.col("n"), F.col("t")), extraction.fast_text_confidence(F.col("n"), F.lit(0.0))).collect()]
    assert got == [(0.65, 0.8375), (0.8, 0.8375), (0.35, round(0.7 * (0.2 + 0.85 * 0.05), 4))]
    words = spark.createDataFrame([([90.0, 0.0, 70.0],), ([-1.0],)], "c array<double>")
    assert [r[0] for r in words.select(extraction.ocr_confidence(F.col("c"))).collect()] == [0.8, 0.5]


def test_tables_of_text(spark):
    md = "# One\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\ntail\n\n# Two\n\nno table"
    rows = spark.createDataFrame([(md,)], "m string")
    pages, tables, rest = rows.select(extraction.markdown_pages(F.col("m")), extraction.markdown_tables(F.col("m")), extraction.without_tables(F.col("m"))).first()
    assert len(pages) == 2 and pages[1].startswith("# Two")
    assert tables[0].headers == ["a", "b"] and tables[0].data == [["1", "2"], ["3", "4"]] and "|" not in rest
    spaced = spark.createDataFrame([("Name  Age\nAnn  5\nBob  6\nend",), ("plain",)], "t string").select(extraction.spaced_table(F.col("t")).alias("x")).collect()
    assert spaced[0].x.headers == ["Name", "Age"] and spaced[0].x.rows == 2 and spaced[1].x is None
    grid = spark.createDataFrame([([[" a ", None], ["", " "], ["1", "2"]],)], "g array<array<string>>").select(extraction.cell_table(F.col("g")).alias("x")).first().x
    assert grid.headers == ["a"] and grid.data == [["1", "2"]] and grid.columns == 2


def test_headers_and_rows(spark):
    rows = spark.createDataFrame([(["Net Profit", "net-profit", None, ""], ["1"])], "h array<string>, r array<string>")
    head = extraction.numbered_headers(F.col("h"))
    got = rows.select(head.alias("h"), "r").select("h", extraction.row_map(F.col("h"), F.col("r")).alias("m")).first()
    assert got.h == ["net_profit", "net_profit_2", "column", "column_2"] and got.m == {"net_profit": "1", "net_profit_2": "", "column": "", "column_2": ""}


def test_records(spark):
    steps = spark.createDataFrame([("a", "completed", 1.5, 0.8), ("a", "completed", 0.5, 0.6), ("b", "failed", 1.0, None), ("c", "running", 1.0, 0.1)], "chain_id string, status string, seconds double, quality double")
    got = {r.chain_id: (r.status, r.total_duration, r.completion) for r in records.chain_status(steps).collect()}
    assert got == {"a": ("completed", 2.0, 100.0), "b": ("failed", 1.0, 0.0), "c": ("running", 1.0, 0.0)}
    runs = spark.createDataFrame([("d", "layout", 0.65449, 3, 29.994, True), ("e", "vision", 0.5, 1, 60.0, False)], "document_id string, strategy string, average_confidence double, pages_processed int, seconds double, escalated boolean")
    assert [(r.confidence, r.processing_time, r.efficiency, r.cost) for r in records.ledger(runs).orderBy("document_id").collect()] == [(0.654, 29.99, "high", 0.0), (0.5, 60.0, "low", 0.0)]
    last = records.latest(spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "k string, n int, v string"), "k", [F.col("n")])
    assert [tuple(r) for r in last.collect()] == [("d", 2, "b")]


def test_headers_are_cleaned_once(spark):
    """A header is cleaned at one place of the plan, not again for each that stands before it."""
    rows = spark.createDataFrame([([" Net  Profit ", "net-profit", "__", "É", "a_", "NET PROFIT", None],), (None,)], "h array<string>")
    out = rows.select(extraction.numbered_headers(F.col("h")).alias("h"))
    assert [r.h for r in out.collect()] == [["net_profit", "net_profit_2", "column", "column_2", "a", "net_profit_3", "column_3"], None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1

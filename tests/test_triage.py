from pyspark.sql import functions as F

from paperloom.operators import calibration, triage
from paperloom.sources import readers, writers


def metrics(spark, rows):
    """(pages: (chars, image ratio, searchable), fonts)"""
    cols = "document_id string, page_num int, chars int, image_area_ratio double, is_searchable boolean, table_hit boolean, has_watermarks boolean, has_signatures boolean"
    data = [(f"d{k}", n, c, i, s, False, False, False) for k, (pages, _) in enumerate(rows) for n, (c, i, s) in enumerate(pages)]
    fonts = {f"d{k}": f for k, (_, f) in enumerate(rows)}
    has = F.coalesce(*[F.when(F.col("document_id") == k, f) for k, f in fonts.items()])
    return triage.document_metrics(spark.createDataFrame(data, cols), fonts=has)


def test_origin_types(spark):
    good, scan = [(1600, 0.05, True)] * 2, [(9, 0.9, False)] * 2
    found = metrics(spark, [(good * 2, True), (scan * 2, False), (good + scan, True)])
    got = [r[0] for r in found.orderBy("document_id").select(triage.origin_type()).collect()]
    assert got == ["native_digital", "scanned_image", "mixed"]


def test_layout_and_rules(spark):
    rows = spark.createDataFrame([(1, 0, 0.05), (3, 0, 0.05), (2, 6, 0.05), (1, 0, 0.5)], "column_count int, table_count int, image_area_ratio double")
    assert [r[0] for r in rows.select(triage.layout_complexity()).collect()] == ["single_column", "multi_column", "table_heavy", "figure_heavy"]
    base = rows.withColumns({"avg_chars_per_page": F.lit(1500.0), "scanned_pages": F.lit(0), "total_pages": F.lit(4), "origin_type": F.lit("native_digital"), "layout_complexity": triage.layout_complexity()})
    got = [tuple(r) for r in base.select(*triage.category()).collect()]
    assert got[1] == ("moderate_complexity", 0.8, "layout")
    assert got[0] == ("moderate_complexity", 1.0, "layout")
    mixed = base.limit(1).withColumns({"origin_type": F.lit("mixed"), "scanned_pages": F.lit(2)}).select(*triage.category()).first()
    assert tuple(mixed) == ("high_complexity", 0.5, "hybrid")


def test_page_sample(spark):
    def expected(total, most=12):
        if total <= most:
            return list(range(total))
        step = max(1, (total - 1) // (most - 4 + 1))
        inner = [k for k in range(step, total - 1, step) if k > 2][: most - 4]
        return sorted({0, 1, 2, total - 1, *inner})[:most]

    rows = spark.createDataFrame([(n,) for n in (0, 1, 12, 13, 14, 40, 161, 1000)], "n int")
    for n, got in rows.select("n", triage.page_sample(F.col("n"))).collect():
        assert got == expected(n), n


def test_domains(spark):
    rows = spark.createDataFrame([("a", "the patient had a diagnosis of tax"), ("b", "legal contract bank account"), ("c", "zzz"), ("d", "")], "document_id string, low string")
    got = [tuple(r) for r in rows.select(*triage.domain_guess(F.col("low"))).collect()]
    assert [g[0] for g in got] == ["medical", "legal", "general", "general"] and got[2][1] == 0.5
    words = spark.createDataFrame([(d, k, w) for k, (d, some) in enumerate(triage.DOMAINS.items()) for w in some], "domain string, ord int, keyword string")
    joined = {r.document_id: r.domain_hint for r in triage.domain_by_join(rows, words).collect()}
    assert joined == {"a": "medical", "b": "legal", "c": "general", "d": "general"}


def test_profiles_of_nulls_and_nothing(spark):
    pages = spark.createDataFrame([("a", 1, None), ("a", 2, "the and or but in on " * 40), ("b", 1, "")], "document_id string, page_num int, text string")
    got = {r.document_id: r for r in triage.profiles(pages).collect()}
    assert got["a"].language == "en" and got["b"].origin_type == "mixed" or got["b"].origin_type == "scanned_image"
    assert triage.profiles(pages.limit(0)).count() == 0


def test_calibrated_rules_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(float(x), x / 100, x % 5) for x in range(1, 101)], "avg_chars_per_page double, image_area_ratio double, table_count int")
    table = calibration.thresholds(rows, rows.columns)
    found = calibration.collected(table)
    assert found["avg_chars_per_page"]["p50"] == 50.5 and found["avg_chars_per_page"]["p0"] == 1
    rules = calibration.rules(found)
    (tmp_path / "rules.yaml").write_text(writers.rules_yaml(rules, 100))
    back = {r.category: r for r in readers.category_rules(str(tmp_path / "rules.yaml"))}
    assert back == {r.category: r for r in rules}
    assert readers.category_rules(str(tmp_path / "none.yaml")) == triage.RULES


def test_columns_and_blocks(spark):
    rows = spark.createDataFrame([("a", 10.0)] * 6 + [("a", 300.0)] * 6 + [("b", 1.0)] * 3 + [("c", None)], "k string, x double")
    assert {r.k: r.column_count for r in calibration.column_estimate(rows, "k", "x").collect()} == {"a": 2, "b": 1}
    blocks = spark.createDataFrame([([[1.0, 50.0], [1.0, 100.0], [1.0]],), ([[1.0], [2.0]],)], "lines array<array<double>>")
    assert [r[0] for r in blocks.select(calibration.table_blocks(F.col("lines"))).collect()] == [True, False]


def test_pages_of_little_text_in_a_scanned_document_count_as_scanned(spark):
    """Nine scanned pages and one of 150 characters make a scanned document; with the tenth of 400 it is mixed."""
    for last, want in (("y" * 150, "scanned_image"), ("y" * 400, "mixed")):
        pages = spark.createDataFrame([("d", k, "") for k in range(1, 10)] + [("d", 10, last)], "document_id string, page_num int, text string")
        found = triage.document_metrics(triage.page_signals(pages)).select("scanned_pages", triage.origin_type().alias("origin")).first()
        assert (found.scanned_pages, found.origin) == (10 if want == "scanned_image" else 9, want)


def test_profiles_read_a_sample_of_pages(spark):
    """Of 20 pages 12 are read: total_pages counts all, total_chars is the sample's mean times that."""
    pages = spark.createDataFrame([("d", k, "x" * (400 if k <= 3 else 200 + k)) for k in range(1, 21)] + [("e", 1, None)], "document_id string, page_num int, text string")
    read = sorted(r.page_num for r in triage.sampled(pages).filter("document_id = 'd'").collect())
    assert len(read) == 12 and read[:3] == [1, 2, 3] and read[-1] == 20
    got = {r.document_id: r for r in triage.profiles(pages).collect()}
    mean = sum(400 if k <= 3 else 200 + k for k in read) / 12
    assert (got["d"].total_pages, got["d"].total_chars) == (20, int(mean * 20)) and (got["e"].total_pages, got["e"].total_chars) == (1, 0)

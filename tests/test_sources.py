import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.sources import readers, writers
from paperloom.streaming import ingest


def test_files_pages_and_errors(spark, tmp_path):
    (tmp_path / "One.txt").write_text("first\fsecond")
    (tmp_path / "two.txt").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "three.txt").write_text("deep")
    found = readers.files(spark, str(tmp_path), "*.txt")

    def reader(content):
        if content == b"x":
            raise ValueError("bad file")
        return readers.text_pages(content)

    got = {(r.document_id, r.page_num): (r.text, r.error) for r in readers.pages_of_files(found, reader).collect()}
    assert got == {("One", 1): ("first", None), ("One", 2): ("second", None), ("two", None): (None, "ValueError: bad file")}
    names = spark.createDataFrame([("three.txt",), ("ONE",), ("none",)], "name string")
    paths = {r.name: r.path for r in readers.resolve(names, readers.files(spark, str(tmp_path), "*.txt", True)).collect()}
    assert paths["three.txt"].endswith("sub/three.txt") and paths["ONE"].endswith("One.txt") and paths["none"] is None


def test_native_text_or_ocr(spark):
    kind = "document_id string, page_num int, text string"
    native = spark.createDataFrame([("a", 1, "x"), ("a", 2, " "), ("b", 1, "")], kind)
    ocr = spark.createDataFrame([("a", 1, "o"), ("b", 1, "o")], kind)
    got = {(r.document_id, r.page_num): (r.text, r.confidence) for r in readers.first_source(native, ocr).collect()}
    assert got == {("a", 1): ("x", 0.99), ("a", 2): (" ", 0.0), ("b", 1): ("o", None)}


def test_queries_and_parameters(spark):
    rows = spark.createDataFrame([("d", 1.0), ("e", 2.0)], "document_id string, value double")
    assert readers.query(spark, "SELECT value FROM facts WHERE document_id = ?", ["e"], facts=rows).first().value == 2.0
    with pytest.raises(ValueError, match="SELECT"):
        readers.query(spark, "DROP TABLE facts")


def test_sinks(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, None)], "k int, v string")
    merged = writers.upserted(old, new, "k")
    assert {tuple(r) for r in merged.collect()} == {(1, "a"), (2, "B"), (3, None)}
    writers.append(merged, str(tmp_path / "log"))
    writers.append(merged, str(tmp_path / "log"))
    assert readers.json_rows(spark, str(tmp_path / "log"), "k int, v string").count() == 6
    writers.by_key(merged, str(tmp_path / "by"), "k")
    assert (tmp_path / "by" / "k=3").is_dir()
    assert {r.value for r in writers.json_lines(new).collect()} == {'{"k":2,"v":"B"}', '{"k":3,"v":null}'}


def test_row_checks(spark):
    rows = spark.createDataFrame([(0, 5, 0.0), (2, 100, 10.0), (2, 100, 50.4)], "total_pages int, total_chars int, avg_chars_per_page double")
    assert [tuple(r) for r in rows.select(schemas.profile_issue(), schemas.mended_average()).collect()] == [("characters without pages", 0.0), (None, 50.0), (None, 50.4)]
    box = spark.createDataFrame([((1.0, 1.0, 9.0, 2.0, 1, 5.0, 5.0),), ((1.0, 1.0, 2.0, 2.0, 1, None, None),)], f"b {schemas.BBOX}")
    assert [tuple(r) for r in box.select(schemas.bbox_issue(F.col("b")), schemas.bbox_area(F.col("b"))).collect()] == [("wider than the page", 18.0), (None, 4.0)]


def test_stream_takes_each_page_once(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "Revenue was 15 percent. " * 9), ("d", 1, "Revenue was 15 percent. " * 9), ("d", 2, "none")], "document_id string, page_num int, text string").withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000)))
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing new
        ingest.ingest(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/ldus")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/facts")).count() == 9

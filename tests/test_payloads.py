import json

from pyspark.sql import functions as F

from paperloom.operators import answers, chunking, payloads

PAGES = "document_id string, nth int, page_num int, page_number int, text string, tables_json string, confidence double"


def test_repaired_pages_and_tables(spark):
    tables = [{"headers": ["a", "b"], "data": [["1", 2], "no row", None]}, {"table_id": "t9", "page_num": 7, "rows": 5, "columns": 3, "data": {"headers": ["x"], "data": [["y"]]}, "confidence": 0.9}]
    rows = [("d", 1, None, None, None, json.dumps(tables), None), ("d", 2, 4, 9, "text", None, 1.5), ("d", 3, None, 8, "", "broken", -1.0)]
    got = {r.nth: r for r in payloads.repaired(spark.createDataFrame(rows, PAGES)).collect()}
    assert [(got[k].page_num, got[k].text, got[k].confidence) for k in (1, 2, 3)] == [(1, "", 0.0), (4, "text", 1.0), (8, "", 0.0)]
    assert got[2].tables == [] and got[3].tables == []
    two = got[1].tables[1]
    assert (two.table_id, two.page_num, two.rows, two.columns, two.headers, two.data, two.confidence) == ("t9", 7, 5, 3, ["x"], [["y"]], 0.9)
    one = got[1].tables[0]
    assert (one.table_id, one.page_num, one.columns, one.headers, one.confidence) == ("table_1_1", 1, 2, ["a", "b"], 0.6)


def test_metadata_keeps_what_is_given(spark):
    pages = payloads.repaired(spark.createDataFrame([("d", 1, None, None, "abc", '[{"headers": ["a"]}]', 0.5), ("d", 2, None, None, "de", None, 0.5)], PAGES))
    given = spark.createDataFrame([("d", 9, None), ("e", None, "high")], "document_id string, total_pages int, extraction_cost string")
    got = {r.document_id: r for r in payloads.with_metadata(given, pages).collect()}
    assert (got["d"].total_pages, got["d"].total_text_length, got["d"].total_tables, got["d"].pages_processed, got["d"].extraction_cost, got["d"].confidence_threshold) == (9, 5, 1, 2, "medium", 0.7)
    assert (got["e"].total_pages, got["e"].extraction_cost) == (0, "high")


def test_tables_as_json(spark):
    tables = spark.createDataFrame([("d", 2, 1, [{"a": "1"}]), ("d", 1, 1, [{"a": "x"}, {"a": "y"}])], "document_id string, page int, table_index int, rows array<map<string,string>>")
    assert json.loads(payloads.table_json(tables).first().value) == [{"page": 1, "table_index": 1, "rows": [{"a": "x"}, {"a": "y"}]}, {"page": 2, "table_index": 1, "rows": [{"a": "1"}]}]
    assert [json.loads(r.value) for r in payloads.table_json(tables, flatten=True).collect()] == [{"a": "x"}, {"a": "y"}, {"a": "1"}]


def test_page_index(spark):
    pages = spark.createDataFrame([("doc", 1, "before any title of it"), ("doc", 2, "1. Balance Sheet\nassets"), ("doc", 2, "more of it all, in words"), ("doc", 3, "2. Scope\nlast")], "document_id string, page_num int, text string")
    ldus = chunking.page_ldus(pages.withColumn("nth", F.lit(0)))
    tree = json.loads(payloads.page_index_json(ldus).first().value)
    assert tree["document_id"] == "doc" and [p["page_number"] for p in tree["pages"]] == [1, 2, 3]
    assert tree["pages"][0]["section_title"] == "Document Root" and tree["pages"][0]["ldus"][0]["provenance"] == ["doc_page_1", "doc_ldu_1"]
    assert [s["section_title"] for s in tree["sections"]] == ["Financial Performance", "2. Scope"] and tree["children"] == tree["sections"]
    assert [c["title"] for c in tree["sections"][0]["children"]] == ["1. Balance Sheet"] and tree["sections"][1]["children"] == []
    assert tree["pages"][1]["section_title"] == "Financial Performance" and tree["pages"][2]["section_id"] == tree["sections"][1]["section_id"]
    assert payloads.page_index_json(ldus.limit(0)).count() == 0


def test_whole_page_box_and_summaries(spark):
    rows = spark.createDataFrame([(3, "long text"), (4, None)], "n int, t string")
    assert rows.select(payloads.whole_page_box(F.col("n"))).first()[0].asDict() == {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0, "page_num": 3}
    assert [r[0] for r in rows.select(payloads.summarised(F.col("t"))).collect()] == ["long text", None]
    assert [r[0] for r in rows.select(payloads.summarised(F.col("t"), lambda t: "short" if t else None)).collect()] == ["short", None]


def test_ask_goes_through_all_steps(spark):
    pages = spark.createDataFrame([("d", 1, "Total assets 1,200 at 30 June 2022"), ("d", 2, "Other words")], "document_id string, page_num int, text string")
    asked = spark.createDataFrame([(1, "d", "What were the total assets?"), (2, "none", "What were the total assets?")], "question_id long, document_id string, question string")
    got = {r.question_id: (r.answer, r.status) for r in answers.ask(pages, chunking.page_ldus(pages), asked).collect()}
    assert got == {1: ("The document reports total assets of 1,200 on page 1.", "grounded"), 2: (answers.NOTHING, "not_found")}

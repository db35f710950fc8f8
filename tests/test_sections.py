from paperloom.operators import sections

BODY = "this is some running text of a page"


def ldus(spark, docs):
    rows = [(f"{d}_ldu_{k + 1}", d, k + 1, k, t) for d, some in docs.items() for k, t in enumerate(some)]
    return spark.createDataFrame(rows, "ldu_id string, document_id string, page_num int, position int, text string")


def test_titled_chunks_open_sections(spark):
    rows = ldus(spark, {"d": ["leading words only here", "1. First\nx", BODY, "2. Second"], "e": [BODY]})
    got = {(r.document_id, r.section_ord): (r.title, r.page_refs, len(r.ldu_ids)) for r in sections.sections(rows).collect()}
    assert got == {("d", 1): ("1. First", [2, 3], 2), ("d", 2): ("2. Second", [4], 1), ("e", 0): ("Document Body", [1], 1)}


def test_document_title_is_promoted(spark):
    rows = ldus(spark, {"d": ["Annual Report\nx", BODY, "1. Scope"]})
    titles, rest = sections.promoted(sections.sections(rows))
    assert titles.first().document_title == "Annual Report" and [r.title for r in rest.collect()] == ["1. Scope"]


def test_known_sections_are_grouped(spark):
    rows = ldus(spark, {"d": ["1. Scope", "2. Balance Sheet", "3. Cash Flow Notes", "Risk Management", "4. End"]})
    got = [(r.depth, r.title, r.parent_id) for r in sections.flattened(sections.tree(rows)).orderBy("place").collect()]
    assert got == [(0, "d", None), (1, "1. Scope", "d_root"), (1, "Financial Performance", "d_root"), (2, "2. Balance Sheet", "d_root_1"), (2, "3. Cash Flow Notes", "d_root_1"), (1, "Risk Management", "d_root"), (1, "4. End", "d_root")]
    text = sections.outline(sections.tree(rows)).first().outline.split("\n")
    assert text[1:3] == ["- Financial Performance", "  - 2. Balance Sheet"]


def test_pages_have_the_section_of_their_first_chunk(spark):
    rows = ldus(spark, {"d": [BODY, "1. First", BODY], "e": [BODY]})
    got = {(r.document_id, r.page_num): r.section_title for r in sections.page_sections(rows).collect()}
    assert got == {("d", 1): "Document Root", ("d", 2): "1. First", ("d", 3): "1. First", ("e", 1): "Document Body"}

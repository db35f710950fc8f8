from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.functions.packing import ChunkRules, buffered, chunks, filled, hard_split
from paperloom.operators import chunking

RULES = ChunkRules()
words = st.text("abcdefgh", min_size=1, max_size=12)
sentence = st.lists(words, min_size=1, max_size=40).map(lambda w: " ".join(w) + ".")
page = st.lists(st.lists(sentence, min_size=1, max_size=6).map(" ".join), max_size=12).map("\n\n".join)


@settings(max_examples=200, deadline=None)
@given(page)
def test_chunks_keep_their_bounds(text):
    found = chunks(text)
    assert all(RULES.least <= len(c.strip()) and len(c) <= RULES.hard for c in found)
    if len(text) >= RULES.least and len(text) <= RULES.most and text.count("\n\n") < RULES.paragraphs:
        assert found == [text]


@settings(max_examples=100, deadline=None)
@given(page)
def test_hard_split_loses_no_words(text):
    assert " ".join(hard_split(text, RULES)).split() == text.split()
    assert " ".join(buffered(text)).split() == text.split()


def test_filled():
    assert list(filled(["aa", "bb", "cc"], 4)) == [["aa", "bb"], ["cc"]]
    assert list(filled(["aa", "bb"], 4, 1)) == [["aa"], ["bb"]]
    assert list(filled(["toolong"], 3)) == [["toolong"]]


def test_overlap_opens_the_next_chunk():
    first, second = "a " * 450, "b " * 450
    found = chunks(f"{first}\n\n{second}")
    assert len(found) == 2 and found[1].startswith(" ".join(["a"] * 30) + "\n\nb")


def test_short_chunks_and_tables():
    assert chunks("short") == [] and chunks(None) == [] and chunks("  ") == []
    assert chunks("short", has_table=True) == ["short"]
    assert max(map(len, chunks("x " * 2000, has_table=True))) <= RULES.hard


def test_ldus_are_numbered_over_pages(spark):
    rows = spark.createDataFrame([("d", 2, "b " * 300), ("d", 1, "a " * 900), ("d", 3, None), ("e", 1, "c " * 200)], "document_id string, page_num int, text string")
    got = chunking.ldus(rows).orderBy("document_id", "position").collect()
    assert [(r.ldu_id, r.page_num) for r in got] == [("d_ldu_1", 1), ("d_ldu_2", 1), ("d_ldu_3", 2), ("e_ldu_1", 1)]
    assert chunking.issues(chunking.ldus(rows)).count() == 0
    assert chunking.ldus(rows.limit(0)).count() == 0


def test_issues_and_their_documents(spark):
    good = "word " * 60
    rows = spark.createDataFrame([("d", 1, good + "-"), ("e", 1, good + "x")], "document_id string, page_num int, text string")
    found = chunking.page_ldus(rows)
    assert [(r.document_id, r.issue) for r in chunking.issues(found).collect()] == [("d", "ends_inside")]
    assert [r.document_id for r in chunking.valid(found).collect()] == ["e"]
    broken = found.selectExpr("ldu_id", "document_id", "page_num", "position", "text", "'no' AS content_hash", "'' AS parent_section")
    assert {r.issue for r in chunking.issues(broken).collect()} == {"ends_inside", "hash", "no_parent"}
    assert chunking.valid(found, on_invalid="report").count() == 2

import pytest
from pyspark.sql import functions as F

from paperloom.operators import answers, facts, search


def ldus(spark, text, page=1):
    return spark.createDataFrame([("d", "d_ldu_1", page, 0, text)], "document_id string, ldu_id string, page_num int, position int, text string")


def test_facts_golden(spark):
    got = facts.extract(ldus(spark, "Section One\n\nRevenue increased by 15 percent in 2025.")).orderBy("id").collect()
    assert [(r.value, r.unit, r.metric, r.date) for r in got] == [(15.0, "", "One Revenue increased by", "2025"), (202.0, "", "by 15 percent in", "2025")]
    strict = facts.extract(ldus(spark, "In 2025 it was 1,234.5 million."), strict=True).orderBy("id").collect()
    assert [(r.value, r.unit) for r in strict] == [(2025.0, ""), (1234.5, "million")]
    assert facts.extract(ldus(spark, None)).count() == 0


@pytest.mark.parametrize(("text", "found"), [("a1 b", []), ("é5", []), ("12%", [(12.0, "%")]), ("1,000 USD", [(1000.0, "USD")]), ("1234.56", [(123.0, ""), (56.0, "")])])
def test_number_pattern(spark, text, found):
    assert [(r.value, r.unit) for r in facts.extract(ldus(spark, text)).orderBy("id").collect()] == found


def test_question_words(spark):
    rows = spark.createDataFrame([("What were the total assests and food inflation when cash?",)], "q string")
    keys, found, topic = rows.select(facts.keywords(F.col("q")), facts.terms(F.col("q")), facts.topic(F.col("q"))).first()
    assert keys == ["total", "assets", "food", "inflation", "cash"]
    assert found == ["inflation", "food inflation", "total assets", "total", "assets", "food"]
    assert topic == "were"


def test_facts_by_question_rank_and_dedupe(spark):
    text = "The general inflation was 15 % in 2024. Revenue was 20 million. The general inflation was 15 % in 2024."
    asked = spark.createDataFrame([(1, "d", "What was general inflation in 2024?")], "question_id long, document_id string, question string")
    got = facts.by_question(facts.extract(ldus(spark, text)), asked).orderBy("nth").collect()
    assert (got[0].value, got[0].unit) == (15.0, "%") and len({(r.content_hash, r.value) for r in got}) == len(got)


def evidence(spark, page_text, question, page=2):
    pages = spark.createDataFrame([("d", page, page_text)], "document_id string, page_num int, text string")
    asked = spark.createDataFrame([(1, "d", question)], "question_id long, document_id string, question string")
    hits = search.page_search(pages, asked)
    none = spark.createDataFrame([], "question_id long, document_id string, nth int, page_num int, content_hash string, text string")
    secs = spark.createDataFrame([], "question_id long, document_id string, nth int, section_id string, page_refs array<int>, summary string")
    found = facts.by_question(facts.extract(ldus(spark, page_text, page)), asked)
    cited = answers.citations(hits, none, found, secs)
    return answers.answers(asked, pages, hits, found, none, secs, cited).first(), cited


def test_financial_row_golden(spark):
    got, cited = evidence(spark, "Year Revenue Operating Cost Net Profit 2023 180 110 70 2024 210 125 85 next", "What was the net profit in 2024?")
    assert (got.answer, got.status) == ("The document reports net profit of 85 in 2024 on page 2.", "grounded")
    assert 0 < cited.count() <= 10


def test_refusals(spark):
    assert evidence(spark, "nothing at all", "zzzz qqqq")[0].answer == answers.NOTHING
    got, _ = evidence(spark, "cash was held by hand in the bank value", "What value of cash in hand was there?")
    assert got.answer == "No grounded numeric fact found in the extracted text for this question." and got.status == "not_found"


def test_date_answer(spark):
    got, _ = evidence(spark, "The statements were approved and authorised for issue on 12 March 2024 by them.", "When were the statements approved for issue?")
    assert got.answer == "The financial statements were approved and authorised for issue on 12 March 2024."


def test_citations_are_unique_and_ordered(spark):
    key = "question_id long, document_id string, nth int, "
    hits = spark.createDataFrame([(1, "d", k, k, 5, f"p{k}", f"x{k}") for k in (1, 2)], key + "page_num int, score int, content_hash string, excerpt string")
    near = spark.createDataFrame([(1, "d", 1, 3, "h", "t"), (1, "d", 2, 3, "h", "t")], key + "page_num int, content_hash string, text string")
    found = spark.createDataFrame([(1, "d", k, k, f"h{k}", "s") for k in range(1, 9)], key + "page_num int, content_hash string, sentence string")
    secs = spark.createDataFrame([(1, "d", 1, "s1", [1, 2, 3], "sum")], key + "section_id string, page_refs array<int>, summary string")
    got = answers.citations(hits, near, found, secs).orderBy("nth").collect()
    assert [r.source for r in got] == ["page"] * 2 + ["semantic"] + ["fact"] * 7


def test_audit(spark):
    claims = spark.createDataFrame([(1, "d", "Revenue was 20"), (2, "d", "Revenue was 90"), (3, "e", "Revenue was 20")], "question_id long, document_id string, question string")
    cited = spark.createDataFrame([(1, "d"), (2, "d")], "question_id long, document_id string")
    found = spark.createDataFrame([(1, "d", 20.3), (2, "d", 20.3)], "question_id long, document_id string, value double")
    assert {r.question_id: r.verdict for r in answers.audited(claims, cited, found).collect()} == {1: "VERIFIED", 2: "CONTRADICTED", 3: "NOT_FOUND"}


def test_cosine_vectors_and_precision(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha alpha"), (3, ""), (4, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(9, "alpha")], "question_id long, question string")
    got = search.hashed_search(docs, asked).orderBy("nth").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [(2, 1.0), (1, round(3**-0.5, 6))]
    vectors = search.hashed_vector(search.counted(docs, ["chunk_id"], F.col("text"), hashed=True), "chunk_id").collect()
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-6 for r in vectors) and len(vectors) == 2
    p = spark.createDataFrame([([1, 2, 3, 4], [1, 4]), ([1], [1]), ([], [1])], "p array<int>, r array<int>")
    assert [round(r[0], 3) for r in p.select(search.precision_at_k(F.col("p"), F.col("r"))).collect()] == [0.333, 1.0, 0.0]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(("question", "date", "page"), [("When did it end?", True, False), ("whenever it ends", False, False), (" when was it", False, False), ("Tell the update", True, False), ("Which pages say so?", False, True), ("the homepage and page 3", False, False), ("On what page", False, True)])
def test_what_a_question_asks_for(spark, question, date, page):
    assert one(spark, search.asks_for_date(F.col("q")), q=question) is date
    assert one(spark, search.asks_for_pages(F.col("q")), q=question) is page


def test_the_newest_five_facts_of_a_term_take_part(spark):
    """Seven facts of one term: only the last five can be found, though the first would score more by its year."""
    text = " ".join(["Revenue of 2024 was 11 million."] + [f"Then revenue was {20 + k} million." for k in range(5)])
    asked = spark.createDataFrame([(1, "d", "revenue in 2024")], "question_id long, document_id string, question string")
    got = facts.by_question(facts.extract(ldus(spark, text)), asked).orderBy("nth").collect()
    assert [r.value for r in got] == [24.0, 23.0, 22.0, 21.0, 20.0]


def test_fact_sentences(spark):
    say = lambda q, metric, value, unit, date: one(spark, answers.fact_sentence(F.col("q"), F.col("m"), F.col("v").cast("double"), F.col("u"), F.col("d"), F.lit(3)), q=q, m=metric, v=value, u=unit, d=date)
    assert say("What was general inflation in 2023?", "x", "15", "%", "") == "The document reports general inflation of 15.0% for 2023 on page 3."
    assert say("What rate of food inflation?", "x", "12500000", "", "Q1 2024") == "The document reports food inflation of 12500000.0 for Q1 2024 on page 3."
    assert say("Which amount?", "paid to members", "0.5", "USD", "") == "The document reports paid to members of 0.5USD on page 3."


def test_financial_rows(spark):
    say = lambda q, t: one(spark, answers.row_answer(F.col("q"), F.col("t"), F.lit(7)), q=q, t=t)
    assert say("What were the total assets at 30 June 2021?", "Total assets 5 1,200 and 3,400 at 30 June 2021") == "The document reports total assets of 1,200 as of 30 june 2021 on page 7."
    assert say("What were the total assets at 30 June 2022?", "Total assets 1,200 at 30 June 2021") is None
    assert say("Total assets?", "total assets of 900") is None
    assert say("What was the revenue?", "Revenue from contracts with customers: 4,500,000") == "The document reports revenue of 4,500,000 on page 7."
    assert say("revenue in 2023", "Year Revenue Cost Profit revenue from contracts with customers 2022 1 2 3 2023 10 20 30") == "The document reports revenue from contracts with customers of 10 in 2023 on page 7."
    assert say("What was the cost?", "cost 4,500") is None


def test_dates_near_the_question(spark):
    say = lambda q, t: one(spark, answers.date_near(F.col("t"), F.col("q")), q=q, t=t)
    far = "x " * 200
    assert say("When was it approved?", f"1 May 2020 {far} approved on 3 Sept 2021 {far} 4 June 2022") == "3 Sept 2021"
    assert say("When was it approved?", f"1 May 2020 {far} approved") == "1 May 2020"
    assert say("When?", "approved 5 may 2020") == "5 may 2020" and say("When?", "no date") == ""


def test_unsupported_pages_are_not_named(spark):
    got, _ = evidence(spark, "the notes on leases", "Which pages approved the notes on leases?")
    assert got.answer == "No grounded page references found in the extracted text for this question."
    got, _ = evidence(spark, "the approved notes on leases", "Which pages approved the notes on leases?", 4)
    assert (got.answer, got.status) == ("The referenced notes appear on page 4.", "grounded")


def test_page_citations_carry_the_hash_of_the_page(spark):
    import hashlib

    text = "Leases are long. " * 40
    _, cited = evidence(spark, text, "Tell of leases")
    assert cited.first().content_hash == hashlib.sha256(text.encode()).hexdigest()


def test_every_query_vector_has_its_nearest(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 9.0]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (None, [9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, None)], "query_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.nth) for r in search.vector_topk(vectors, queries, 2, block=1).orderBy("query_id", "nth").collect()]
    assert got == [(10, 0, 1), (10, 1, 2), (11, 2, 1), (11, 0, 2)]
    assert search.vector_topk(vectors, queries.limit(0)).count() == 0


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_sections_are_no_rows(spark):
    """A section's words are counted in its own row: sections meet questions in one join, by words and by hashed vectors, with the same scores."""
    secs = spark.createDataFrame([("d", "s0", 0, "alpha beta beta gamma"), ("d", "s1", 1, "delta delta"), ("d", "s2", 2, None), ("d", "s3", 3, "beta"), ("e", "t0", 0, "x")], "document_id string, section_id string, place int, body string")
    asked = spark.createDataFrame([(1, "d", "Beta beta or alpha"), (2, "d", None), (3, "f", "beta")], "question_id long, document_id string, question string")
    for hashed in (False, True):
        found = search.top_sections(secs, asked, hashed=hashed, keep=("body",))
        got = [(r.question_id, r.section_id, r.nth, round(r.score, 9), r.body is None) for r in found.orderBy("question_id", "nth").collect()]
        assert got == [(1, "s0", 1, round(5 / 30**0.5, 9), False), (1, "s3", 2, round(2 / 5**0.5, 9), False), (1, "s1", 3, 0.0, False), (2, "s0", 1, 0.0, False), (2, "s1", 2, 0.0, False), (2, "s2", 3, 0.0, True)]
        assert plan(found).count("Join ") == 1


def test_pages_of_one_number_are_found_each(spark):
    pages = spark.createDataFrame([("d", 1, "leases"), ("d", 1, "leases and more"), ("d", 2, None), ("d", 3, " ")], "document_id string, page_num int, text string")
    asked = spark.createDataFrame([(1, "d", "Tell of leases")], "question_id long, document_id string, question string")
    assert sorted((r.page_num, r.score, r.page_text) for r in search.page_search(pages, asked).collect()) == [(1, 1, "leases"), (1, 1, "leases and more")]


def odd(spark):
    pages = spark.createDataFrame([("d", 1, "Revenue was 20 million."), ("d", 2, None), ("e", 1, " \n"), ("f", 1, None), ("g", 3, "x"), ("h", 1, "INTRO"), ("h", 2, "of leases")], "document_id string, page_num int, text string")
    asked = spark.createDataFrame([(k, d, q) for d in "defghi" for k, q in enumerate(("Which amount of revenue?", "leases", "", None))], "question_id long, document_id string, question string")
    return pages, asked


def test_questions_with_citations_are_known_without_them(spark):
    """answers() needs to know which questions have a citation, not the citations."""
    from paperloom.operators import chunking

    pages, asked = odd(spark)
    cited = answers.evidence(pages, chunking.page_ldus(pages), asked)["cited"]
    keys = lambda rows: {(r.question_id, r.document_id) for r in rows.collect()}
    known = answers.with_citations(chunking.page_ldus(pages), asked)
    assert keys(known) == keys(cited) and {d for _, d in keys(known)} == {"d", "g", "h"} and known.count() == 12


def test_an_audit_reads_no_evidence_but_facts(spark):
    """Verdicts need facts and which documents have chunks: neither pages nor sections nor chunks are searched."""
    from paperloom.plans import queries

    assert plan(queries.audit_claims(spark, "/root/testdata/sf0.001")).count("Window ") <= 3

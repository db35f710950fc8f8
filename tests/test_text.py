from pyspark.sql import functions as F

from paperloom.functions import text as T


def values(spark, some, *columns):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(some)], "k int, t string")
    return [tuple(r) for r in rows.select("k", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("k").drop("k").collect()]


def test_titles(spark):
    t = F.col("t")
    cases = {
        "## 1. Introduction\nbody": "1. Introduction",
        "FINANCIAL POSITION\nx": "FINANCIAL POSITION",
        "Chapter seven of it": "Chapter seven of it",
        "- Risk &amp; Reward Policy": "Risk & Reward Policy",
        "this is an ordinary line of text": None,
        "content": None,
        "": None,
        "12 units were sold": "12 units were sold",
        "Section Two:": "Section Two",
    }
    assert [x[0] for x in values(spark, list(cases), T.title(t))] == list(cases.values())


def test_sentences_dates_numbers(spark):
    t = F.col("t")
    rows = values(spark, ["One. Two!  Three?\nFour", "On 5 March 2024 in Q2 2023, 12", "", None], T.sentences(t), T.full_date(t), T.date_hint(t), T.first_number(t))
    assert rows[0][0] == ["One.", "Two!", "Three?", "Four"]
    assert rows[1][1:] == ("5 March 2024", "Q2 2023", 5.0)
    assert rows[2] == ([], "", "", None)
    assert rows[3][0] is None


def test_first_sentence_and_excerpt(spark):
    t = F.col("t")
    rows = values(spark, ["Who?  Me. You! ok", "no end here", "x" * 100 + " needle " + "y" * 400], T.first_sentence(t), T.excerpt(t, F.array(F.lit("needle"))))
    assert rows[0][0] == "Who? Me."
    assert rows[1][0] == "no end here"
    assert rows[2][1].startswith("x" * 60 + " needle"[:1]) or "needle" in rows[2][1]
    assert len(rows[2][1]) == 320


def test_document_titles(spark):
    rows = spark.createDataFrame([("Annual Report 2024", "x"), ("cbe annual", "cbe_annual_2024"), ("Scope", "x")], "title string, id string")
    assert [r[0] for r in rows.select(T.names_document(F.col("title"), F.col("id"))).collect()] == [True, True, False]


def test_titles_and_months(spark):
    rows = spark.createDataFrame([("3 Summary", "3rd Sept 2021"), ("Section 2: Risk-Notes", "in May"), ("12.Plan", "4 sep 2020")], "t string, d string")
    got = rows.select(T.normal_title(F.col("t")), T.month(F.col("d")), T.full_date(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("summary", "sept", ""), ("risk notes", "may", ""), ("plan", "sep", "4 sep 2020")]

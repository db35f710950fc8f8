import datetime as dt

from paperloom.llm import url_filter

AT = dt.datetime


def run(spark, pages, events, **more):
    rows = spark.createDataFrame(pages, "page_id long, url string, fetched_at timestamp_ntz")
    listed = spark.createDataFrame(events, "kind string, key string, category string, action string, at timestamp_ntz")
    return sorted(((r.page_id, r.blocked, r.kind, r.key) for r in url_filter.evaluate(rows, listed, **more).collect()), key=str)


EVENTS = [
    ("host", "a.example.com", "spam", "add", AT(2024, 1, 10)),
    ("host", "a.example.com", "spam", "remove", AT(2024, 2, 1)),
    ("domain", "Example.com.", "bad", "add", AT(2024, 1, 20)),
    ("prefix", "a.example.com/x", "path", "add", AT(2024, 1, 5)),
    ("host", "late.org", "x", "add", AT(2025, 1, 1)),
    ("host", None, "x", "add", AT(2024, 1, 1)),
    ("host", "both.org", "x", "add", AT(2024, 1, 1)),
    ("host", "both.org", "x", "remove", AT(2024, 1, 1)),
    ("odd", "a.example.com", "x", "add", AT(2024, 1, 1)),
]


def test_entries_active_when_fetched(spark):
    pages = [
        (1, "http://a.example.com/", AT(2024, 1, 9, 23)),
        (2, "http://a.example.com/", AT(2024, 1, 10)),
        (3, "https://User@A.EXAMPLE.com:80/X/y?z#q", AT(2024, 1, 15)),
        (4, "http://a.example.com/", AT(2024, 2, 1)),
        (5, "http://b.example.com/x", AT(2024, 1, 20)),
        (6, "http://notexample.com", AT(2024, 6, 1)),
        (7, "http://late.org", AT(2024, 6, 1)),
        (8, "http://both.org", AT(2024, 6, 1)),
        (9, None, AT(2024, 6, 1)),
        (10, "http://a.example.com/", None),
        (11, "no url", AT(2024, 6, 1)),
        (2, "http://a.example.com/", AT(2024, 1, 10)),
    ]
    want = {1: (False, None, None), 2: (True, "host", "a.example.com"), 3: (True, "prefix", "a.example.com/x"), 4: (True, "domain", "example.com"), 5: (True, "domain", "example.com")}
    got = run(spark, pages, EVENTS)
    assert got == sorted(((p[0], *want.get(p[0], (False, None, None))) for p in pages), key=str)
    assert run(spark, pages, EVENTS, small_list=0) == got  # dealt out by key


def test_empty_list_and_no_pages(spark):
    assert run(spark, [(1, "http://a.b", AT(2024, 1, 1))], []) == [(1, False, None, None)]
    assert run(spark, [], EVENTS) == []

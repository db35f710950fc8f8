from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import decontaminate as D

word = st.sampled_from([b"a", b"b", b"c"])
some_words = st.lists(word, max_size=30)


def brute(words, items, window):
    hit, who = set(), set()
    for k, item in enumerate(items):
        n = min(window, len(item))
        for s in range(len(item) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == item[s : s + n]:
                    hit.update(range(at, at + n))
                    who.add(k)
    return hit, who


@settings(max_examples=300, deadline=None)
@given(some_words, st.lists(some_words, max_size=4), st.integers(1, 5))
def test_wu_manber_finds_every_occurrence(words, items, window):
    spans, who = D.hits(words, D.searchers(enumerate(items), window))
    assert ({k for s, e in spans for k in range(s, e)}, who) == brute(words, items, window)


W = [f"w{k}" for k in range(60)]
ITEMS = [(1, " ".join(W[:20])), (1, "Short, ITEM!"), (30, " ".join(W[10:25])), (4, None), (5, "..."), (None, " ".join(W[40:54])), (6, "é1x")]
DOCS = [(1, "x " * 5 + " ".join(W[3:18])), (2, " ".join(W[:12])), (3, "a short-item b"), (4, None), (5, ""), (6, " ".join(W[40:54])), (7, "É1X é1X"), (8, "z " * 50_000 + " ".join(W[:13])), (1, "other"), (None, " ".join(W))]


def run(spark, docs, items, **more):
    rows = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], list(r.item_ids)) for r in D.search(rows, bench, **more).collect())


def expected(docs, items):
    out = []
    listed = [D.words_of(t.encode() if t else None) for _, t in items]
    for doc_id, text in docs:
        words = D.words_of(text.encode() if text else None)
        hit, who = brute(words, listed, 13) if len(words) < 1000 else (set(range(50_000, 50_013)), {0})
        out.append((str(doc_id), len(words), D.merged((k, k + 1) for k in hit), sorted({str(items[k][0]) for k in who if items[k][0] is not None})))
    return sorted(out)


def test_documents(spark):
    want = expected(DOCS, ITEMS)
    assert run(spark, DOCS, ITEMS) == want
    assert run(spark, DOCS, ITEMS, most_words=15) == want  # several passes


def test_nothing(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, [(1, "a b")], []) == [("1", 2, [], [])]


def test_clean_keeps_columns_and_clean_documents(spark):
    rows = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, hit string, __row int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(i for i, _, spans, _ in expected(DOCS, ITEMS) if not spans)
    for most in (D.MOST_WORDS, 15):
        kept = D.clean(rows, bench, most_words=most)
        assert kept.columns == rows.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == want == ["1", "2", "4", "5"]
    assert D.clean(rows, bench.limit(0)).count() == len(DOCS) and D.clean(rows.limit(0), bench).count() == 0


def test_a_window_of_many_items_is_kept_once():
    items = [W[:20], *[W[:13]] * 50, [*W[:13], "x"]]
    engine = D.searchers(enumerate(items))[0]
    assert max(len(some) for some in engine.bucket.values()) == 1
    assert D.hits(W[:13], [engine])[1] == set(range(52))

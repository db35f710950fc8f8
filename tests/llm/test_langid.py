import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import langid, queries

PIECES = ["", "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab"]


def segmentations(word, pieces):
    if not word:
        return [[]]
    heads = [p for p in pieces if p and word.startswith(p)] or [""]
    if word[0] not in pieces:
        heads = [*[h for h in heads if h], ""]
    return [[h, *rest] for h in heads for rest in segmentations(word[len(h) or 1 :], pieces)]


def test_forward_sums_all_segmentations():
    table = np.random.RandomState(1).uniform(0.01, 0.2, (len(PIECES), 3))
    words = ["▁ab", "▁abab", "▁babab", "▁axb", "▁b"]
    lattice = langid.Lattices(words, langid.Trie(PIECES))
    got = langid.totals(lattice, langid.forward(lattice, table))
    for word, row in zip(words, got, strict=True):
        want = sum(np.prod([table[PIECES.index(p)] for p in s], axis=0) for s in segmentations(word, PIECES))
        assert np.allclose(row, want)


def test_expected_counts_are_posteriors():
    table = np.random.RandomState(2).uniform(0.01, 0.2, (len(PIECES), 1))
    word = "▁abab"
    all_ways = segmentations(word, PIECES)
    chance = np.array([np.prod([table[PIECES.index(p), 0] for p in s]) for s in all_ways])
    want = np.zeros(len(PIECES))
    for s, c in zip(all_ways, chance / chance.sum(), strict=True):
        for p in s:
            want[PIECES.index(p)] += 2 * c
    lattice = langid.Lattices([word], langid.Trie(PIECES))
    assert np.allclose(langid.expected(lattice, table, np.array([[2.0]]))[:, 0], want)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy_on_texts_alone(spark, docs):
    model = queries.language_model(docs)
    assert model.langs == sorted({r[0] for r in docs.select("lang").distinct().collect() if r[0]})
    held = docs.filter(langid.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    got = langid.predicted(held, model)
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n >= 0.95
    bare = {r.doc_id: r.lang_pred for r in langid.predicted(held.select("doc_id", "text"), model).collect()}
    assert bare == {r.doc_id: r.lang_pred for r in got.collect()}


def test_strange_texts(spark, docs):
    model = queries.language_model(docs)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 34"), (4, "日本"), (5, "a" * 100_000), (6, "the"), (6, "the"), (None, "x"), (7, "\u00bd \u00b2 \u2167 \u2460 3")], "doc_id long, text string")
    got = langid.predicted(rows, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert langid.predicted(rows.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    model = queries.language_model(none)
    assert model.langs == [] and {r.lang_pred for r in langid.predicted(none.select("doc_id", "text"), model).collect()} == {"und"}


def test_a_rare_language_is_learned_and_names_may_clash(spark):
    rows = [(k, "the cat and the dog went to the house", "en", 0.5, "own") for k in range(300)] + [(1000 + k, "paka na mbwa walikwenda nyumbani kwetu", "sw", 0.5, "own") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double, lang_pred string")
    model = langid.train(docs, queries.vocabulary_file("piece_bpe_32k.model"), sample_docs=5)
    assert model.langs == ["en", "sw"]
    got = langid.predicted(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert got.filter("lang <> lang_pred").count() == 0

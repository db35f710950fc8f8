"""The pipeline's rows against each stage in plain Python, over sf0.001."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import codes, decontaminate, langid, mixing, queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = queries.table(spark, DIR, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows.select("doc_id").collect())


def test_stages(spark, stages):
    first = queries.table(spark, DIR, "documents")
    assert [len(s) for s in ({f.name for f in d.schema} & set(corpus_pipeline.COLUMNS) for d in stages[:-1])] == [5] * 4
    model = queries.language_model(first)
    told = {r.doc_id: r for r in langid.predicted(first.select("doc_id", "text"), model).collect()}
    assert ids(stages[0]) == sorted(i for i, r in told.items() if r.lang_pred != "und" and r.score >= 0.5)

    from test_nearcopies import brute

    rows = sorted(stages[0].collect(), key=lambda r: r.doc_id)
    classes = brute([r.text for r in rows])
    assert ids(stages[1]) == [r.doc_id for k, r in enumerate(rows) if classes[k] == k]

    items = [decontaminate.words_of((r.text or "").encode()) for r in queries.table(spark, DIR, "benchmark").collect()]
    windows = {tuple(i[k : k + min(13, len(i))]) for i in items for k in range(len(i) - min(13, len(i)) + 1) if i}
    kept = []
    for r in stages[1].collect():
        words, hit = decontaminate.words_of((r.text or "").encode()), set()
        for n in {len(w) for w in windows}:
            hit.update(k for at in range(len(words) - n + 1) if tuple(words[at : at + n]) in windows for k in range(at, at + n))
        if not hit:
            kept.append(r.doc_id)
    assert ids(stages[2]) == sorted(kept)


def test_mix_and_codes(spark, stages):
    from test_mixing import level

    sizes = {}
    for r in stages[2].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(codes.re.findall(r"[^\x20\x09-\x0D]+", r.text))
    got = {r.source: r.n for r in stages[3].groupBy("source").agg(mixing.F.sum(mixing.n_words(mixing.F.col("text"))).alias("n")).collect()}
    longest = max(len(r.text.split()) for r in stages[2].collect())
    assert all(abs(got.get(s, 0) - t) <= longest for s, t in level(sizes).items())

    end = np.array([codes.END_ID], "<u4").tobytes()
    tokens = codes.Tokens(queries.tokenizer_path())
    want = sorted((r.doc_id, len(x) // 4, zlib.crc32(x)) for r in stages[3].collect() for x in [tokens._whole(r.text.encode()) + end])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[4].collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(tuple, stages[4].collect()))


def test_stages_with_empty_and_null_documents(spark):
    """No documents give none at every stage; null ids, texts and sources go through, and only the first stage drops null texts."""
    first = queries.table(spark, DIR, "documents")
    some = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "a", 0), (2, "", None, "a", 0)], first.select(*corpus_pipeline.COLUMNS).schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, first.limit(0), DIR).count() == 0, name
        kept = stage(spark, some, DIR).count()
        # equal empty texts are copies, and documents without words are never mixed in
        assert kept == {"language identification": 0, "near-dedup": 2, "benchmark decontamination": 4, "source mixing": 0, "token codes": 4}[name], name

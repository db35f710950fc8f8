import hashlib
import math
import re

from pyspark.sql import functions as F

from paperloom.llm import mixing

KIND = "doc_id long, source string, size long"


def level(sizes):
    """target by source, by filling: cap what is above twice its size and share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    free, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, KIND)).collect()


ROWS = [(k, ("a", "b", "c", None, "é")[k % 5 if k % 3 else 0], k * 37 % 90) for k in range(200)] + [(7, "a", 5), (7, "a", 5), (None, "b", 9), (None, None, 0)]


def test_targets_and_taken_words(spark):
    got = mixed(spark, ROWS)
    sizes = {}
    for _, s, n in ROWS:
        sizes[s] = sizes.get(s, 0) + n
    want = level(sizes)
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_size.setdefault((r.source_size, r.target), []).append(r.taken)
    assert {k[0] for k in by_size} == set(sizes.values())
    for s, n in sizes.items():
        target = next(t for size, t in by_size if size == n and math.isclose(t, want[s], rel_tol=1e-9))
        assert abs(sum(by_size[n, target]) - target) <= 90  # a document
    assert sum(r.taken for r in got) == sum(sizes.values()) * 3 // 2
    assert len(got) == len(ROWS) and sorted(map(str, got)) == sorted(map(str, mixed(spark, ROWS[::-1])))


def test_taken_words_are_those_of_a_queue_by_finish_time(spark):
    """Brute force: every document's finish times in one list, in order, until the budget is spent."""
    rows = [(k, "abc"[k * k % 3], 1 + k * 31 % 50) for k in range(300)]
    key = lambda k: hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest()
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in "abc"}
    target, turns = level(sizes), []
    for s in "abc":
        done = 0
        for turn in (0, 1):
            for k, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: key(r[0])):
                turns.append(((done + n) / target[s], s, turn, k, n))
                done += n
    left, taken = sum(sizes.values()) * 3 // 2, {k: 0 for k, _, _ in rows}
    for _, _, _, k, n in sorted(turns):
        taken[k] += min(n, left)
        left -= min(n, left)
    assert {r.doc_id: r.taken for r in mixed(spark, rows)} == taken


def test_no_words(spark):
    assert mixed(spark, []) == []
    assert [(r.target, r.taken) for r in mixed(spark, [(1, "a", 0)])] == [(0.0, 0)]


def test_word_count(spark):
    some = ["a b\tc d", "", None, " \n\x0b\x0c\r ", "x" * 100_000]
    rows = spark.createDataFrame([(t,) for t in some], "t string").select(mixing.n_words(F.col("t"))).collect()
    assert [r[0] for r in rows] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in some]


def test_served_documents_keep_near_their_targets(spark):
    docs = spark.createDataFrame([(k, "w " * (n + 1), s, "extra") for k, s, n in ROWS], "doc_id long, text string, source string, finish string").withColumn("row", F.lit(1)).withColumn("__id", F.lit(2))
    sent = mixing.served(docs)
    assert sent.columns == docs.columns
    got = {r.source: r.n for r in sent.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    sizes = {}
    for _, s, n in ROWS:
        sizes[s] = sizes.get(s, 0) + n + 1
    for s, target in level(sizes).items():
        assert abs(got[s] - target) <= 91
    assert mixing.served(docs.limit(0)).count() == 0

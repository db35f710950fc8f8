import random

import numpy as np

import corpus_pipeline
from paperloom.llm import components, nearcopies


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))]


def changed(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def copies(rng):
    """Texts of 200 words, each with copies of 1, 2 and 4 words replaced, chains of changes, and short and blank texts."""
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(40)]
    texts = [*base, *(changed(rng, b, n) for b in base for n in (1, 2, 4, 8))]
    for b in base[:5]:
        for _ in range(6):
            b = changed(rng, b, 4)
            texts.append(b)
    return [*texts, "a b c", "A b  c", "a b c d e f", "", " ", None, "zz"]


def test_roots_are_all_links():
    rng = random.Random(5)
    texts = [t for t in copies(rng) if t and t.strip()]
    got = nearcopies.roots([nearcopies.shingles(t.encode()) for t in texts])
    assert got.tolist() == brute(texts)


def test_stage_drops_copies_of_some_words(spark):
    texts = copies(random.Random(7))
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    classes = brute(texts)
    assert kept == [k for k in range(len(texts)) if classes[k] == k]
    # each base has its copies of 1, 2 and 4 words gone
    assert not {k for k in kept if 40 <= k < 200 and (k - 40) % 4 < 3}


def test_ids_that_repeat(spark):
    rows = [(1, "the same words in both of these rows", "x"), (1, "quite another text under the same id", "x"), (2, "the same words in both of these rows", "x"), (3, "zz", "y"), (3, "zz", "y"), (None, "zz", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = nearcopies.one_of_each(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", rows[0][1]), ("1", rows[1][1]), ("3", "zz"), ("None", "zz")])
    assert nearcopies.one_of_each(docs.limit(0)).count() == 0


def test_stage_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    classes = brute([r.text for r in rows])
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [r.doc_id for k, r in enumerate(rows) if classes[k] == k]


def test_fingerprint_is_the_majority_of_hashes():
    some = nearcopies.shingles(" ".join(f"w{k}" for k in range(600)).encode())
    for n in (0, 1, 2, 7, 596):
        want, hashes = [0] * nearcopies.WORDS, nearcopies.hashes(some[:n]).tolist()
        for word in range(nearcopies.WORDS):
            for bit in (b for b in range(64) if b % 16 < nearcopies.BITS):
                want[word] |= (2 * sum(h[word] >> bit & 1 for h in hashes) + sum(h[word] >> bit & 1 for h in hashes[:1]) > n) << bit
        assert nearcopies.fingerprint(some[:n]).tolist() == want


def test_near_fingerprints_are_those_of_all_pairs():
    """Pairs, chains and crowds under one value, however many are compared in one go."""
    rng = np.random.default_rng(9)
    met = np.zeros(300, nearcopies._MET)
    met["fp"], met["value"] = rng.permutation(300) - 150, np.arange(300) % 3
    for k in range(300):
        flips = [(w, np.uint64(1 << 16 * rng.integers(4) + int(rng.integers(nearcopies.BITS)))) for w in rng.integers(0, 5, 45)]
        met["head"][k] = rng.integers(0, 1 << 63, 5, np.uint64) & nearcopies._LIVE if k < 30 else met["head"][k - 30]
        for w, flip in flips if k >= 30 else []:
            met["head"][k, w] ^= flip
    a, b = np.triu_indices(300, 1)
    near = met["value"][a] == met["value"][b]
    for words, most in nearcopies.RADII:
        near &= np.bitwise_count(met["head"][a, :words] ^ met["head"][b, :words]).sum(axis=1, dtype=int) <= most
    want = [x.tolist() for x in components.forest(met["fp"][a[near]], met["fp"][b[near]])]
    assert 200 < len(want[0]) < 300
    crowd, cells = nearcopies.CROWD, nearcopies._CELLS
    try:
        for nearcopies.CROWD, nearcopies._CELLS in ((1000, cells), (2, cells), (2, 500), (2, 1)):
            assert [x.tolist() for x in nearcopies.met_links(met)] == want
    finally:
        nearcopies.CROWD, nearcopies._CELLS = crowd, cells


def test_candidates_hold_every_link(spark):
    """Pairs of similarity 0.8 meet under a block within the radius, short texts too; texts that share nothing don't."""
    rng = np.random.default_rng(4)
    sets = []
    for c, a, b in [(4, 0, 1), (8, 1, 1), (12, 1, 2), (40, 5, 5), (160, 20, 20), (400, 0, 100)] * 20:
        own = rng.integers(0, 1 << 63, c + a + b, np.uint64)
        sets += [np.sort(x) for x in (own[: c + a], np.concatenate([own[:c], own[c + a :]]))]
    nodes = spark.createDataFrame([(k, nearcopies.fingerprint(s).tobytes()) for k, s in enumerate(sets)], "fp long, bits binary")
    got = {r.node: r.component for r in components.components(nearcopies._near(nodes)).collect()}
    assert got == {k + 1: k for k in range(0, len(sets), 2)}

import random

import xxhash

from paperloom.llm import components, simhash


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    some = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(fps):
    root = {k: k for k in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(fps))]


TEXTS = ["One two THREE four five", "one two three four five", "one\ttwo\nthree  four five", "É é", "é é", None, "", " \n", "a", "a b", "x " * 5000, "a b c a b c a b c", "  nbsp word"]


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text.encode() if text is not None else None) % (1 << 64) == fingerprint(text), text


def test_classes_of_near_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    want = brute(fps)
    for crowd in (2048, 8, 1):  # keys compared as they are, and cut again, once or to the end
        merged = {r.node: r.component for r in components.components(simhash.links(nodes, crowd=crowd)).collect()}
        assert [merged.get(k, k) for k in range(len(fps))] == want


def test_documents(spark):
    rows = [(k * 5 % 17, t, "x") for k, t in enumerate(TEXTS)] + [(3, "one two three four five", "y"), (3, "one two three four five", "y"), (None, "a", "z")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    least = {}
    for i, t, _ in rows:
        if i is not None:
            f = fingerprint(t)
            least[f] = min(least.get(f, i), i)
    reps = sorted(least.items(), key=lambda x: x[1])
    classes = brute([f for f, _ in reps])
    want = {f: reps[c][1] for (f, _), c in zip(reps, classes, strict=True)}
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == sorted((str(i), fingerprint(t), want[fingerprint(t)]) for i, t, _ in rows)


def test_nothing_and_one_of_each(spark):
    docs = spark.createDataFrame([(2, "a b c d"), (1, "A b c d"), (3, "zz"), (None, "q"), (1, "A b c d")], "doc_id long, text string")
    kept = simhash.first_of_each(docs, simhash.near_duplicates(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "A b c d"), ("3", "zz"), ("None", "q")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_components_of_more_than_a_block(spark):
    rng = random.Random(5)
    pairs = [(k + 1, k) for k in range(1000)] + [(2000, 2001 + k) for k in range(400)] + [(3000 + rng.randint(0, 300), 3000 + rng.randint(0, 300)) for _ in range(200)]
    rng.shuffle(pairs)
    want = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert want == {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), block=150).collect()}
    assert all(want[k] == 0 for k in range(1, 1001)) and all(want[2001 + k] == 2000 for k in range(400))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_five_thousand_fingerprints_under_one_key(spark):
    """They agree on the upper half; the groups among them are those of all pairs."""
    rng = random.Random(6)
    low = sorted({rng.getrandbits(32) for _ in range(3000)} | {(k * 2654435761) % (1 << 32) ^ (1 << k % 32) for k in range(2000)} | {(k * 2654435761) % (1 << 32) for k in range(2000)})
    fps = [0x0123456700000000 | x for x in low]
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, rep long")
    merged = {r.node: r.component for r in components.components(simhash.links(nodes)).collect()}
    assert len(fps) > 5000 and [merged.get(k, k) for k in range(len(fps))] == brute_by_flips(fps)


def brute_by_flips(fps):
    """As brute, by looking up every value within two bits."""
    at = {f: k for k, f in enumerate(fps)}
    flips = [0, *(1 << a for a in range(32)), *((1 << a) | (1 << b) for a in range(32) for b in range(a))]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, f in enumerate(fps):
        for x in flips:
            if (j := at.get(f ^ x)) is not None:
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_one_doc_id_with_different_texts(spark):
    """Neither text is lost, whichever class it is in."""
    docs = spark.createDataFrame([(5, "alpha beta gamma delta epsilon", 1), (5, "one two three four five six", 1), (5, "one two three four five six", 2), (9, "alpha beta gamma delta epsilon", 1)], "doc_id long, text string, fp long")
    kept = simhash.first_of_each(docs, simhash.near_duplicates(docs)).collect()
    assert sorted((r.doc_id, r.text[:3]) for r in kept) == [(5, "alp"), (5, "one")]

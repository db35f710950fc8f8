import random

from paperloom.llm import suffix


def texts():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    doc = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [doc(r.randint(1, 200)) for _ in range(40)]
    p = doc(60)
    return [*base, base[3], base[7][:400] + "X" + base[7][401:], base[9] + p, p + base[10], f"pre {p[:230]} post", "a" * 500, "a" * 300, "ab" * 300, "", None, base[3][5:300], f"{p} {p}", "é" * 150, "é" * 99, p[:199], p[:200]]


def test_against_all_strings(spark):
    some = texts()
    rows = [(k if k % 7 else None, t) for k, t in enumerate(some)] + [(5, some[5]), (5, some[5]), (5, "other")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    found = suffix.brute_force([(t or "").encode() for _, t in rows])
    want = sorted((str(i), len((t or "").encode()), str([list(s) for s in f])) for (i, t), f in zip(rows, found, strict=True))
    got = suffix.deduplicated(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, str(r.removed)) for r in got) == want
    for r in got:
        assert len(r.kept) == r.n_bytes - sum(e - s for s, e in r.removed)


def test_phrases_cover_every_start_with_their_trigger(monkeypatch):
    monkeypatch.setattr(suffix, "PARSED_AT_ONCE", 700)
    text = " ".join(random.Random(2).choice("abcdefg") * 3 for _ in range(2000)).encode()
    x, first, last, _ = suffix.parse(text)
    assert first[0] == 0 and last[-1] == len(text) - suffix.LENGTH and (first[1:] == last[:-1] + 1).all()
    assert (x >= last).all() and (x + suffix.TRIGGER <= first + suffix.LENGTH).all()


def test_shared_prefixes():
    some = [b"ab", b"abc", b"abc", b"abd", b"", b"b\0", b"b"]
    assert suffix.shared_with_next(some, 4).tolist() == [2, 3, 2, 0, 0, 1]


def test_a_crowded_trigger_in_many_contexts(spark):
    """One passage of 120 bytes between contexts that occur in other pairings, in and over many tasks."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage, before, after = word(120), [word(150) for _ in range(12)], [word(150) for _ in range(12)]
    texts = [f"{word(40)}{b[k:]}{passage}{a[: 150 - j]}{word(40)}" for b in before for a in after for k, j in [(r.randint(0, 149), r.randint(0, 149))]]
    texts += [passage * 3, word(300) + passage, passage + word(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = suffix.brute_force([t.encode() for t in texts])
    got = {x.doc_id: [tuple(s) for s in x.removed] for x in suffix.deduplicated(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want and sum(map(len, want)) > 40


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.deduplicated(docs).count() == 0
    short = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    assert [(r.n_bytes, r.removed, bytes(r.kept)) for r in suffix.deduplicated(short).orderBy("doc_id").collect()] == [(1, [], b"x"), (0, [], b"")]

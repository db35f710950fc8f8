import numpy as np

from paperloom.llm import vectors

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    fine = lambda e, l: e is not None and l is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
    good = [(i, np.array(e, np.float32).astype(float), l) for i, e, l in rows if i is not None and fine(e, l)]
    links, root = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, (i, v, l) in enumerate(good):
        for j, w, m in good[a + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i is not None, i or 0), links.get(i, 0), find(i) if i is not None else None, find(i) == i if i is not None else None) for i, _, _ in rows)


def check(spark, rows, **more):
    got = vectors.near_duplicates(spark.createDataFrame(rows, KIND), **more).collect()
    assert sorted(((r.vec_id is not None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in got) == brute(rows)


def cloud(n, seed, noise):
    rng = np.random.RandomState(seed)
    base = rng.standard_normal((6, 16))
    return [(k, (base[rng.randint(6)] + noise * rng.standard_normal(16)).astype(float).tolist(), int(rng.randint(3))) for k in range(n)]


def test_against_all_pairs(spark):
    rows = cloud(150, 1, 0.1)
    rows += [(200 + k, rows[3][1], rows[3][2]) for k in range(20)] + [(300, [2 * x for x in rows[3][1]], rows[3][2])]
    check(spark, rows)
    check(spark, rows, crowd=8)  # buckets in parts


def test_odd_vectors(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [1.0, 0.01], 1), (9, [1.0, 0.0], 2), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    check(spark, rows)


def test_nothing(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    check(spark, [(1, None, 1)])


def test_recall_on_a_planted_table(spark):
    """20,000 vectors of two labels, with 2,000 planted pairs close to the threshold: links found against all pairs."""
    rng = np.random.RandomState(9)
    base = rng.standard_normal((18_000, 24)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:2000] + (0.195 / np.sqrt(24) * rng.standard_normal((2000, 24))).astype(np.float32)
    v = np.concatenate([base, near]).astype(np.float32)
    label = np.concatenate([np.arange(18_000) % 2, np.arange(2000) % 2])
    w = v.astype(float)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    want = np.zeros(len(v), int)
    for s in range(0, len(v), 2000):
        want[s : s + 2000] = ((w[s : s + 2000] @ w.T >= 0.98) & (label[s : s + 2000, None] == label[None, :])).sum(axis=1) - 1
    rows = [(k, x, int(y)) for k, (x, y) in enumerate(zip(v.tolist(), label.tolist()))]
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    found = sum(got.values())
    print(f"{found} of {want.sum()} link ends found")
    assert all(got[k] <= n for k, n in enumerate(want.tolist())) and want.sum() > 1000 and found / want.sum() >= 0.99

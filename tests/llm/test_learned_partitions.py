import numpy as np

from tarnwick.llm.learned_partitions import Index, balanced_partition, fit, nearest, neighbour_graph


def data(spark, n=900, copies=200):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(30, size=n)] + 0.35 * rng.normal(size=(n, 16))
    x[:copies] = x[0] * rng.uniform(0.5, 2, (copies, 1))  # a group of copies, not of unit length
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0, 2.0]), (5, rows[5][1]), (None, rows[3][1])]
    return x, spark.createDataFrame(rows, "k long, v array<float>").selectExpr("*", "1 as part", "'a' as q", "0.5 as similarity")


def brute(x, k):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    s = np.round(u @ u.T, 5)
    np.fill_diagonal(s, -9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]] for i in range(len(x))}


def test_recall_and_copies(spark):
    x, df = data(spark)
    true = brute(x, 5)
    found = {}
    for r in nearest(df, "k", "v", k=5, rows_per_part=120).collect():
        found.setdefault(r["k"], []).append((r["place"], r["neighbour"]))
    assert set(found) == set(range(900)) and all(len(v) == 5 for v in found.values())
    hits = sum(len(set(true[i]) & {j for _, j in found[i]}) for i in range(200, 900))
    assert hits / (700 * 5) >= 0.9
    # Copies: all similar alike, so the smallest keys come first.
    assert [j for _, j in sorted(found[0])] == [1, 2, 3, 4, 5] and [j for _, j in sorted(found[150])] == [0, 1, 2, 3, 4]


def test_two_levels_keep_the_recall(spark):
    x, df = data(spark, n=1500, copies=20)
    true = brute(x, 5)
    found = {}
    for r in nearest(df, "k", "v", k=5, rows_per_part=60, max_parts=5).collect():
        found.setdefault(r["k"], set()).add(r["neighbour"])
    assert set(found) == set(range(1500)) and all(len(v) == 5 for v in found.values())
    assert sum(len(set(true[i]) & found[i]) for i in range(20, 1500)) / (1480 * 5) >= 0.9


def test_parts_within_parts_are_numbered_apart():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = fit(x, 3)
    coarse = top.probabilities(x).argmax(axis=1)
    within = {c: fit(x[coarse == c], 4) for c in (0, 2)}
    index = Index(top, within, np.array([0, 4, 5]))
    part = index.parts_of(x)
    assert set(part[coarse == 1]) == {4} and set(part[coarse == 2]) <= {5, 6, 7, 8} and set(part[coarse == 0]) <= {0, 1, 2, 3}
    row, probed = index.probe(x, 20, 1.1)  # all parts of all rows
    assert len(row) == 600 * 9 and len(set(zip(row.tolist(), probed.tolist()))) == 600 * 9
    row, probed = index.probe(x, 3, 0.9)
    assert np.bincount(row).max() <= 6 and np.mean([p in set(probed[row == i]) for i, p in enumerate(part)]) > 0.99


def test_one_part_is_exact(spark):
    x, df = data(spark, 300, 20)
    true = brute(x, 4)
    found = {}
    for r in nearest(df, "k", "v", k=4, queries="k % 10 = 0").collect():
        found.setdefault(r["k"], set()).add(r["neighbour"])
    assert set(found) == set(range(0, 300, 10))
    assert sum(len(found[i] & set(true[i])) for i in found) >= 0.99 * 4 * len(found)


def test_floor_and_empty(spark):
    x, df = data(spark, 200, 10)
    assert min(r["similarity"] for r in nearest(df, "k", "v", k=3, min_similarity=0.9).collect()) >= 0.9
    assert nearest(df.limit(0), "k", "v").count() == 0
    assert nearest(df.filter("k = 3"), "k", "v").count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = balanced_partition(x, neighbour_graph(x, 6), 8)
    assert np.bincount(part, minlength=8).max() <= 400 / 8 * 1.05 + 1
    assert fit(x, 8).probabilities(x).shape == (400, 8)

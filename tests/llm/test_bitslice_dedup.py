import random
import re

import numpy as np
import pytest

from tarnwick.llm import bitslice_dedup as B


def shingles(text, width):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, similarity, width):
    best = {}
    for k, t in rows:
        if k is not None:
            best[k] = max(best.get(k) or "", t or "")
    sets = {k: shingles(t, width) for k, t in best.items()}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize(("similarity", "width"), [(0.5, 3), (0.8, 5)])
def test_against_brute_force(spark, similarity, width):
    rows = [*texts(400, 1), (1000, None), (1001, ""), (1002, "two words"), (1003, "Ünï-cöde wörds HERE too!"), (1004, "ünï cöde, wörds here too"), (3, texts(400, 1)[3][1]), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "k long, t string").selectExpr("*", "1 as class", "'x' as block", "2 n")
    links, members = B.near_duplicates(df, "k", "t", similarity, width)
    found = {(r["key_a"], r["key_b"]) for r in B.record_pairs(links, members, "k").collect()}
    assert found == brute(rows, similarity, width)
    assert members.count() == 405


def test_tiles_of_a_hot_block(spark, monkeypatch):
    monkeypatch.setattr(B, "TILE", 40)
    rng = random.Random(4)
    rows = [(i, "the same three words open every text " + " ".join(f"v{rng.randrange(30)}" for _ in range(8))) for i in range(300)]
    links, members = B.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.5, 3)
    assert {(r["key_a"], r["key_b"]) for r in B.record_pairs(links, members, "k").collect()} == brute(rows, 0.5, 3)


def test_copies_as_a_star(spark):
    rows = [(i, "one two three four five six") for i in range(50)] + [(60, "one two three four five seven")]
    links, members = B.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.5, 3)
    assert {(r["key_a"], r["key_b"]) for r in B.record_pairs(links, members, "k", star=10).collect()} == {(0, i) for i in range(1, 50)} | {(0, 60)}
    assert B.record_pairs(links, members, "k").count() == 50 * 49 // 2 + 50


def test_empty(spark):
    links, members = B.near_duplicates(spark.createDataFrame([], "k long, t string"), "k", "t")
    assert links.count() == 0 and members.count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 2**63, (200, B.WORDS), dtype=np.uint64) * np.uint64(2)
    sketch[50] = sketch[10] ^ np.uint64(5)
    distance = lambda i, j: int(sum(bin(int(a ^ b)).count("1") for a, b in zip(sketch[i], sketch[j])))
    group = np.repeat([0, 1, 2], [90, 30, 80])
    flat = np.full(200, 100)
    i, j = B.near_pairs(group, flat, np.zeros(200, int), np.zeros(200, int), sketch, [64, 128, 192, 120], 0.5)
    true = {(a, b) for a in range(200) for b in range(a + 1, 200) if group[a] == group[b] and distance(a, b) <= 120}
    assert set(zip(i.tolist(), j.tolist())) == true and (10, 50) in true


def test_a_link_passes_at_its_first_shared_shingle():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(4, 40))) for _ in range(2))
        n, m = sorted((a, b), key=len)
        shared = np.intersect1d(n, m)
        if not len(shared) or len(shared) < 0.5 * len(np.union1d(n, m)):
            continue
        place = np.array([np.searchsorted(x, shared[0]) for x in (n, m)])
        sizes = np.array([len(n), len(m)])
        assert B.partners(np.zeros(2, int), sizes, place, 0.5)[0] == 2


def test_sketches_differ_as_often_as_they_should():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(400):
        both = rng.integers(1, 2**63, 60)
        sets += [np.sort(np.concatenate([both, rng.integers(1, 2**63, 30)])) for _ in range(2)]
    sketch = B.sketches(np.concatenate(sets).astype(np.int64), np.full(800, 90))
    distance = np.bitwise_count(sketch[::2] ^ sketch[1::2]).sum(axis=1)
    assert abs(distance.mean() - 64) < 1.5 and 6 < distance.std() < 8 and distance.max() <= B.radius_for(0.5)

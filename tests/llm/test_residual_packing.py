import random

from tarnwick.llm.residual_packing import best_fit, pack
from tarnwick.llm.tokens import counter, token_sizes


def test_best_fit_never_overfills():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins = best_fit(sizes, 100)
    assert max(sum(s for s, b in zip(sizes, bins) if b == k) for k in set(bins)) <= 100
    assert len(set(bins)) <= -(-sum(sizes) // 100) + 3


def check(rows, capacity):
    bins = {}
    for r in rows:
        if r["container_id"] is not None:
            bins.setdefault(r["container_id"], []).append(r)
    assert all(sum(r["size"] for r in b) == b[0]["filled"] <= capacity for b in bins.values())
    return bins


def test_pack_through_several_rounds(spark):
    df = spark.range(4000).selectExpr("id", "cast(pmod(hash(id), 30) + 1 as long) n", "'x' container_id", "0 piece")
    rows = pack(df, "id", "n", 100, bins_per_part=16, fan_in=4).collect()
    bins = check(rows, 100)
    assert sorted(r["id"] for r in rows) == list(range(4000))
    assert len(bins) <= (max(best_fit([r["size"] for r in rows], 100)) + 1) * 1.03
    again = pack(df.repartition(7), "id", "n", 100, bins_per_part=16, fan_in=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_only_oversize_items_are_cut(spark):
    df = spark.createDataFrame([(1, 250), (2, 100), (3, 101), (4, 0), (5, None), (None, 7), (6, 30), (7, -1)], "id long, n long")
    rows = pack(df, "id", "n", 100).collect()
    check(rows, 100)
    assert {r["id"] for r in rows if r["oversize"]} == {1, 3}
    assert {r["id"] for r in rows if r["container_id"] is None} == {4, 5, 7}
    assert {i: sum(r["size"] for r in rows if r["id"] == i) for i in (1, 2, 3, 6)} == {1: 250, 2: 100, 3: 101, 6: 30}
    assert pack(df.limit(0), "id", "n", 100).count() == 0


def test_counts_are_the_tokenizer_s():
    c = counter()
    for text in ["", " ", "a", "It's 5 o'clock, e.g. at 10:30!", "two  blanks\n\nand   more ", "déjà-vu 你好 ​ x\t y\n z", "Tab\there\r\nline  "]:
        assert c.count(text) == len(c.encoding.encode_ordinary(text)), text


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "one two", "a"), (1, "one two three", "b"), (2, None, None), (None, "x", "c")], "id long, text string, s string")
    assert {r["id"]: (r["s"], r["n_tokens"]) for r in token_sizes(df, "id", "text", "s").collect()} == {1: ("b", 3), 2: (None, 0)}

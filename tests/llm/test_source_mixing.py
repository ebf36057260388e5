import numpy as np

from tarnwick.llm.source_mixing import mix, plan_quotas, split_quotas


def test_tree_keeps_quotas():
    blocks = np.array([1000, 3, 0, 77])
    dealt = split_quotas(blocks, 13, 1)
    assert (dealt.sum(axis=0) == blocks).all() and (dealt >= 0).all()
    assert dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 2


def test_quotas_end_at_the_scarcest_source():
    q = plan_quotas({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3), "gone": (0.2, 1)})
    assert q == {"a": (30, 0.5), "b": (30, 0.5)}


def test_mix(spark):
    items = spark.range(3000).selectExpr("id item", "case when id < 2900 then 'big' when id < 2990 then 'small' else 'none' end s", "if(id = 7, null, 10L + id % 5) n", "1 copy")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mix(items, "item", "s", "n", targets, shards=8)
    rows = mixed.collect()
    shares = {r["source"]: r for r in report.collect()}
    assert abs(shares["small"]["actual_share"] - 0.4) < 0.01 and shares["absent"]["size_used"] == 0
    assert shares["small"]["most_uses"] == 4 and shares["big"]["most_uses"] == 1
    assert len({(r["item"], r["copy"]) for r in rows}) == len(rows) and 7 not in {r["item"] for r in rows}
    assert sum(r["size"] for r in rows) == sum(r["size_used"] for r in shares.values())
    for k in {r["shard"] for r in rows}:
        assert sorted(r["place"] for r in rows if r["shard"] == k) == list(range(1, sum(r["shard"] == k for r in rows) + 1))
    again = mix(items.repartition(5), "item", "s", "n", targets, shards=8)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_empty(spark):
    items = spark.createDataFrame([], "item long, s string, n long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(items, "item", "s", "n", targets)
    assert mixed.count() == 0 and report.first()["actual_share"] == 0

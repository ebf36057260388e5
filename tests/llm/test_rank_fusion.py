import math

from tarnwick.llm.rank_fusion import median_rank

SCORES = ["a", "b", "c"]
ROWS = [("q", 1, 9.0, 0.1, 5.0), ("q", 2, 8.0, 0.9, 4.0), ("q", 3, 1.0, 0.8, None), ("q", 4, None, None, None), ("q", 4, None, None, None), (None, 5, 1.0, 1.0, 1.0), ("r", 1, 0.0, float("nan"), 0.0), ("r", 2, 0.0, 0.0, 0.0)]
SCHEMA = "qid string, item long, a double, b double, c double"


def brute(rows, weights=(1, 1, 1)):
    out = {}
    groups = {}
    for q, i, *s in rows:
        if q is not None:
            groups.setdefault(q, {})[i] = [None if x is None or math.isnan(x) else x for x in s]
    for q, items in groups.items():
        places = {}
        for i, s in items.items():
            places[i] = [len(items) if x is None else 1 + sum(o[k] is not None and o[k] > x for o in items.values()) for k, x in enumerate(s)]

        def median(p):
            pairs, half, total, lo, hi = sorted(zip(p, weights)), sum(weights) / 2, 0, None, None
            for v, w in pairs:
                total += w
                lo = v if lo is None and total >= half else lo
                hi = v if hi is None and total > half else hi
            return (lo + hi) / 2

        mean = lambda p: round(sum(v * w for v, w in zip(p, weights)) / sum(weights), 9)
        for n, i in enumerate(sorted(items, key=lambda i: (median(places[i]), mean(places[i]), i)), 1):
            out[q, i] = n
    return out


def ranks(df):
    return {(r["qid"], r["item"]): r["rank"] for r in df.collect()}


def test_nulls_ties_repeats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert ranks(median_rank(df, "qid", "item", SCORES)) == brute(ROWS)


def test_hot_groups_give_the_same(spark):
    df = spark.range(600).selectExpr("concat('q', id % 3 div 2) qid", "id item", "cast(pmod(hash(id), 50) as double) a", "if(id % 7 = 0, null, rand(1)) b", "cast(id % 4 as double) c").cache()
    whole = ranks(median_rank(df, "qid", "item", SCORES))
    assert len(whole) == 600
    assert ranks(median_rank(df, "qid", "item", SCORES, hot_rows=250)) == whole
    assert brute([tuple(r) for r in df.collect()]) == whole


def test_hot_text_items(spark):
    df = spark.range(40).selectExpr("'q' qid", "concat('a', id % 11, if(id % 2 = 0, '', 'b'), id) item", "1.0D a", "1.0D b", "1.0D c")
    assert ranks(median_rank(df, "qid", "item", SCORES, hot_rows=5)) == ranks(median_rank(df, "qid", "item", SCORES))


def test_weights_halving_evenly(spark):
    rows = [("q", i, float(-i), float(i), float(i)) for i in range(4)]
    assert ranks(median_rank(spark.createDataFrame(rows, SCHEMA), "qid", "item", SCORES, [2, 1, 1])) == brute(rows, (2, 1, 1))


def test_latest_delivery_counts(spark):
    df = spark.sql("select 'q' qid, 1L item, 1.0D a, timestamp'2020-01-01' at union all select 'q', 1L, 9.0D, timestamp'2020-01-02' union all select 'q', 2L, 5.0D, null")
    assert ranks(median_rank(df, "qid", "item", ["a"], delivered="at")) == {("q", 1): 1, ("q", 2): 2}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", rank int, median_place int, _rows int")
    assert median_rank(df, "qid", "item", SCORES).count() == 0


def test_items_of_any_type_rank_alike_on_both_ways(spark):
    base = spark.createDataFrame([("q", i, float(i % 5), float(i % 3)) for i in range(40)], "qid string, n int, a double, b double")
    for item in ("date_add(date'2024-01-01', n)", "timestamp_seconds(n)", "n % 2 = 0", "concat('k', n)", "cast(n as decimal(9, 2))"):
        df = base.selectExpr("qid", f"{item} as item", "a", "b")
        window = ranks(median_rank(df, "qid", "item", ["a", "b"]))
        assert ranks(median_rank(df, "qid", "item", ["a", "b"], hot_rows=5)) == window and len(window) in (2, 40)

import math

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.hashing import embed, hashing_embeddings
from tarnwick.operators import evidence_index as I
from tarnwick.operators import layout as L
from tarnwick.operators import neighbours as N
from tarnwick.operators import packing as P
from tarnwick.operators import ranking as R
from tarnwick.operators import search as X
from tarnwick.operators.hot_ranks import ranks_of_split_groups
from tarnwick.operators.paging import number_rows
from tarnwick.operators.vectors import exact_neighbours
from tarnwick.sources import latest

def order():
    return [F.col("score").desc(), F.col("id")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bm25_prefers_the_match(spark):
    chunks = spark.createDataFrame([("a", "Quarterly revenue increased to 125 million."), ("b", "Employee leave policy and holiday schedule."), ("c", None)], "id string, text string")
    index = R.postings(chunks, "id", T.bm25_tokens(F.col("text")))
    total = spark.createDataFrame([(2, 5.0)], "chunks long, avgdl double")
    asked = spark.createDataFrame([("q", "revenue", 1.0), ("q", "million", 1.0)], "qid string, term string, weight double")
    row = R.bm25(index, asked, "id", total).collect()
    assert [r["id"] for r in row] == ["a"] and row[0]["matched"] == 2
    assert row[0]["bm25"] == pytest.approx(2 * math.log(1 + 1.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 5 / 5)), rel=1e-6)


def test_strength_then_diverse(spark):
    rows = [("a-1", "a", 0.95), ("a-2", "a", 0.94), ("a-3", "a", 0.93), ("b-1", "b", 0.70), ("c-1", "c", 0.65)]
    df = spark.createDataFrame([("q", *r) for r in rows], "qid string, id string, doc string, score double")
    out = R.strength_then_diverse(df, "qid", "doc", order(), 3).orderBy("place").collect()
    assert [r["id"] for r in out] == ["a-1", "b-1", "c-1"]


def test_phrases_and_sections(spark):
    assert one(spark, T.phrase_match(F.lit("wake up test"), F.lit("The automatic wake-up test is required."))) == 1.0
    path = F.array(F.lit("ELECTRICAL SAFETY AND CONTROL"), F.lit("General"))
    assert one(spark, T.section_match(F.lit("electrical safety and control"), path)) == 1.0
    assert one(spark, T.major_section_match(F.lit("electrical safety and control"), path)) == 1.0
    assert one(spark, T.section_match(F.lit("electrical safety and control"), F.array().cast("array<string>"))) == 0.0


def test_normalisation(spark):
    assert {"months", "month"} <= set(one(spark, T.search_terms(F.lit("months"))))
    assert "3" not in one(spark, T.search_terms(F.lit("three")))  # one letter, as numbers of one digit are dropped
    assert "12" in one(spark, T.search_terms(F.lit("twelve"))) and "twelve" in one(spark, T.search_terms(F.lit("12")))
    assert one(spark, T.canonical_phrase(F.lit("Three months"))) == "3 months"
    assert one(spark, T.number_word_variant(F.lit("3 month absence"))) == "three month absence"
    assert one(spark, T.terms_v5(F.lit(None).cast("string"))) == []


def test_quality_and_cleaning(spark):
    assert one(spark, T.text_quality(F.lit(""))) == 0.0 and one(spark, T.text_quality(F.lit("word " * 80))) > 0.95
    assert one(spark, T.clean_text(F.lit("a-\nb  c\r\n\n\n\nd "))) == "ab c\n\nd"


def test_rules(spark):
    values = [(30.0, ">=", 25.0), (1.0, ">=", 2.0), (3.0, "<", 3.0), (3.0, "~", 3.0)]
    df = spark.createDataFrame(values, "v double, o string, t double")
    assert [r[0] for r in df.select(I.compare(F.col("v"), F.col("o"), F.col("t"))).collect()] == [True, False, False, False]


def test_neighbours_and_spans(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}") for i in range(10)], "doc string, idx int, id string")
    seeds = spark.createDataFrame([("d", 0), ("d", 8)], "doc string, idx int")
    near = {(r["id"], r["distance"]) for r in N.neighbours(seeds, chunks, ["doc"], "idx", 1).collect()}
    assert near == {("c0", 0), ("c1", 1), ("c7", 1), ("c8", 0), ("c9", 1)}
    spans = spark.createDataFrame([("d", 2, 4)], "doc string, lo int, hi int")
    assert {r["id"] for r in N.in_spans(chunks, spans, ["doc"], "idx", "lo", "hi", bucket=3).collect()} == {"c2", "c3", "c4"}
    anchored = N.latest_anchor(chunks, ["doc"], "idx", F.col("idx") == 3, F.col("id"), 2, "anchor")
    assert {r["idx"]: r["anchor"] for r in anchored.collect()} == {i: ("c3" if 3 <= i <= 5 else None) for i in range(10)}


def test_ranks_of_split_groups(spark):
    df = spark.range(500).selectExpr("id", "id % 2 g", "cast(if(id < 300, 0, id % 37) as double) v", "if(id = 7, null, 1) n").withColumn("v", F.when(F.col("id") != 11, F.col("v")))
    out = ranks_of_split_groups(df, "g", "v", "r").collect()
    rows = [(r["g"], r["v"], r["r"]) for r in out]
    assert len(rows) == 500
    for g, v, r in rows:
        assert r == (None if v is None else 1 + sum(g == h and w is not None and w > v for h, w, _ in rows))


def test_number_rows(spark):
    out = number_rows(spark.range(1000).selectExpr("id", "pmod(hash(id), 91) v"), [F.col("v").desc(), F.col("id").asc()], "n").collect()
    assert [r["n"] for r in sorted(out, key=lambda r: (-r["v"], r["id"]))] == list(range(1, 1001))


def test_latest(spark):
    df = spark.sql("select 1 k, 'a' v, timestamp'2020-01-01' at union all select 1, 'b', timestamp'2021-01-01' union all select 2, null, null")
    assert {(r["k"], r["v"]) for r in latest(df, ["k"], "at").collect()} == {(1, "b"), (2, None)}


def test_search(spark):
    texts = spark.createDataFrame([(1, "the guard shall inform the driver"), (2, "inform the guard"), (3, None)], "id int, text string")
    found = lambda q: {r["id"] for r in texts.filter(X.web_search(q, F.col("text"))).collect()}
    assert found('"shall inform"') == {1} and found("guard -driver") == {2} and found("driver or guard") == {1, 2} and found("") == set()


def test_greedy_steps(spark):
    rows = [{"d": "a", "k": "text", "n": i} for i in range(6)] + [{"d": "b", "k": "table_row", "n": 9}]
    assert [r["n"] for r in P.half_fill_mixed_cap(rows, "d", "k", 4, 1, 2)] == [0, 1, 9]
    assert [b["b"] for b in P.batches([{"s": 5}, {"s": 5}, {"s": 20}, {"s": 1}], "s", 10, "b")] == [0, 0, 1, 2]
    kept = P.diversify([{"t": ["a", "b"], "p": 1}, {"t": ["b", "a"], "p": 2}, {"t": [], "p": 3}, {"t": None, "p": 3}, {"t": ["c"], "p": 3}], "t", ["p"], 9)
    assert [r["p"] for r in kept] == [1, 3, 3]
    pieces = P.paragraphs("one one\n\ntwo two\n\n" + "x" * 25, 16, 8)
    assert all(len(p) <= 16 for p in pieces) and pieces[0] == "one one\n\ntwo two"[:16]
    df = spark.range(100).selectExpr("id % 3 g", "id")
    out = P.by_group(df, ["g"], ["id"], df.schema, lambda r: r[:2]).collect()
    assert {(r["g"], r["id"]) for r in out} == {(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)}


def test_layout():
    words = [{"y0": 10, "y1": 20, "x0": 50, "t": "b"}, {"y0": 11, "y1": 21, "x0": 5, "t": "a"}, {"y0": 40, "y1": 50, "x0": 5, "t": "c"}]
    assert {w["t"]: w["line"] for w in L.lines_of(words)} == {"a": 0, "b": 0, "c": 1}
    assert L.column_positions([10.0, 11.0, 50.0, 52.0, 51.0], 4.0) == [10.5, 51.0]


def test_embedding(spark):
    v = embed(["Signal aspect", "signal ASPECT", "", None], 128)
    assert abs((v**2).sum(axis=1) - 1).max() < 1e-9 and (v[0] == v[1]).all() and (v[2] == v[3]).all()
    df = spark.createDataFrame([(1, "Signal aspect"), (2, None)], "k int, t string")
    assert [len(r["embedding"]) for r in hashing_embeddings(df, "k", "t", 64).collect()] == [64, 64]
    with pytest.raises(ValueError):
        embed(["x"], 10)


def test_exact_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    assert [(r["query_key"], r["k"]) for r in exact_neighbours(df, "k", "v", "k = 1", 1).collect()] == [(1, 2)]


def test_merge_ignores_order(spark):
    rows = [("q", 1, 0.5, "a"), ("q", 1, 0.4, "b"), ("q", 2, 0.99, "a"), ("q", 2, 0.2, "b"), ("q", 2, 0.1, "c")]
    df = spark.createDataFrame(rows, "qid string, k int, s double, m string")
    out = {r["k"]: round(r["s"], 6) for r in R.merge_best(df, ["qid", "k"], "s", "m").collect()}
    assert out == {1: 0.515, 2: 1.0}


def test_splitters():
    pieces = P.table_pieces("h1\nh2\n" + "\n".join(f"row {i}" for i in range(9)), 30)
    assert all(p.startswith("h1\nh2\n") and len(p) <= 30 for p in pieces) and sum(p.count("row") for p in pieces) == 9
    units = P.long_unit("One two. Three four five. " + "x" * 50, 20, 5)
    assert units[0] == "One two." and all(len(u) <= 20 for u in units) and units[-1].endswith("x")

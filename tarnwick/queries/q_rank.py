"""Keyword, vector and fused ranking; selection and diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import block_search as K
from tarnwick.operators import ranking as R
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

ORDER_SQL = "score DESC NULLS LAST, lower(filename), page_number, coalesce(chunk_index, -1), chunk_id"

INDEX_SQL = f"""
{S.CHUNKS}, split AS (SELECT chunk_key, {S.bm25_tokens("text")} AS terms FROM chunks),
long AS (SELECT chunk_key, len(terms) AS dl, unnest(terms) AS term FROM split),
post AS (SELECT term, chunk_key, dl, count(*) AS tf FROM long GROUP BY ALL),
total AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM split),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT qid, unnest(list_distinct({S.bm25_tokens("question")})) AS term FROM query_plans),
scored AS (
  SELECT qid, chunk_key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))))) AS bm25, count(*) AS matched
  FROM asked JOIN post USING (term) JOIN freq USING (term), total GROUP BY qid, chunk_key)
"""


def _best_scores(spark, d, most, **marks):
    """(qid, chunk_key, bm25, met, met_first, having) of the best `most` chunks of each question; `marks` are columns of the plans and `most_having`, as in `search`."""
    most_having = marks.pop("most_having", 0)
    made, frequency, total = K.blocks(C.chunks(spark, d, "text"), "chunk_key", T.bm25_tokens(F.col("text")), T.terms_smart(F.col("text")) if marks else None)
    plans = C.plans(spark, d)
    asked = plans.select("qid", F.explode(F.array_distinct(T.bm25_tokens(F.col("question")))).alias("term"), F.lit(1.0).alias("weight"))
    queries = K.weigh(asked, frequency, total)
    if marks:
        queries = plans.select("qid", *[K.hashed(terms).alias(name) for name, terms in marks.items()]).join(queries, "qid", "left")
    return K.search(made, queries, "chunk_key", most, most_having)


@query("r1_bm25_top", "A9", "T8", sql=f"""WITH {INDEX_SQL}
SELECT qid, chunk_key, round(bm25, 6) AS bm25, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, chunk_key) AS rank FROM scored) WHERE rank <= 10""")
def r1_bm25_top(spark, d):
    best = R.rank_in(_best_scores(spark, d, 10), ["qid"], [F.round("bm25", 9).desc(), F.col("chunk_key").asc_nulls_last()])
    return best.select("qid", "chunk_key", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


@query("r24_hybrid_chunk_search", "R24", "S6", "W25", "J2", sql=f"""WITH {INDEX_SQL}, {S.CANDIDATES},
keyed AS (SELECT qid, chunk_key, bm25 / (bm25 + 0.18) AS keyword FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, chunk_key) AS n FROM scored) WHERE n <= 40),
vec AS (SELECT qid, chunk_key, vector_score AS vector FROM candidates WHERE vector_score IS NOT NULL),
fused AS (SELECT coalesce(keyed.qid, vec.qid) AS qid, coalesce(keyed.chunk_key, vec.chunk_key) AS chunk_key, coalesce(vector, 0) AS v, coalesce(keyword, 0) AS k
  FROM keyed FULL JOIN vec ON keyed.qid = vec.qid AND keyed.chunk_key = vec.chunk_key),
scored2 AS (SELECT qid, chunk_key, round(least(1.0, greatest(v, k) * 0.82 + least(v, k) * 0.18 + CASE WHEN v > 0 AND k > 0 THEN 0.04 ELSE 0 END), 9) AS score FROM fused)
SELECT qid, chunk_key, score, rank FROM (
  SELECT qid, chunk_key, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS rank
  FROM scored2 JOIN chunks USING (chunk_key)) WHERE rank <= 20""")
def r24_hybrid_chunk_search(spark, d):
    keyword = _best_scores(spark, d, 40).select("qid", "chunk_key", R.squash(F.col("bm25")).alias("keyword"))
    vector = C.candidates(spark, d).filter("vector_score IS NOT NULL").select("qid", "chunk_key", F.col("vector_score").alias("vector"))
    fused = keyword.join(vector, ["qid", "chunk_key"], "full").withColumn("score", F.round(R.fuse_two(F.col("vector"), F.col("keyword")), 9))
    named = fused.join(C.chunks(spark, d, "chunk_id", "filename", "page_number", "chunk_index"), "chunk_key")
    best = R.rank_in(R.top_in(named, ["qid"], R.canonical_order(), 20), ["qid"], R.canonical_order())
    return best.select("qid", "chunk_key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _arms(spark, d):
    c = C.candidates(spark, d)
    one = lambda name, score: c.filter(F.col(score).isNotNull()).select("qid", "chunk_key", F.lit(name).alias("arm"), F.col(score).alias("arm_score"))
    return one("vector", "vector_score").unionByName(one("keyword", "keyword_score")).unionByName(one("section", "score"))


ARMS_SQL = f"""{S.CANDIDATES}, arms AS (
  SELECT qid, chunk_key, 'vector' AS arm, vector_score AS s FROM candidates WHERE vector_score IS NOT NULL
  UNION ALL SELECT qid, chunk_key, 'keyword', keyword_score FROM candidates WHERE keyword_score IS NOT NULL
  UNION ALL SELECT qid, chunk_key, 'section', score FROM candidates WHERE score IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, arm ORDER BY s DESC, chunk_key) AS rank FROM arms)"""


@query("w6_rank_per_arm", "W6", sql=f"WITH {ARMS_SQL} SELECT qid, arm, chunk_key, rank FROM ranked")
def w6_rank_per_arm(spark, d):
    ranked = R.rank_in(_arms(spark, d), ["qid", "arm"], [F.col("arm_score").desc(), F.col("chunk_key")])
    return ranked.select("qid", "arm", "chunk_key", F.col("rank").cast("long").alias("rank"))


@query("r3_rrf_merge", "R3", "W7", "U2", sql=f"""WITH {ARMS_SQL}, summed AS (
  SELECT qid, chunk_key, sum(1.0 / (60 + rank)) AS rrf, string_agg(DISTINCT arm, '+' ORDER BY arm) AS method FROM ranked GROUP BY qid, chunk_key),
norm AS (SELECT qid, chunk_key, method, rrf / max(rrf) OVER (PARTITION BY qid) AS rrf FROM summed)
SELECT qid, chunk_key, method, round(rrf, 6) AS rrf,
  round(0.50 * rrf + 0.30 * coalesce(vector_score, 0) + 0.20 * least(1.0, coalesce(keyword_score, 0) * 5.0), 6) AS score
FROM norm JOIN candidates USING (qid, chunk_key)""")
def r3_rrf_merge(spark, d):
    merged = R.reciprocal_ranks(_arms(spark, d), ["qid", "chunk_key"])
    both = merged.join(C.candidates(spark, d).select("qid", "chunk_key", "vector_score", "keyword_score"), ["qid", "chunk_key"])
    v, k = F.coalesce("vector_score", F.lit(0.0)), F.least(F.lit(1.0), F.coalesce("keyword_score", F.lit(0.0)) * 5)
    return both.select("qid", "chunk_key", F.concat_ws("+", "methods").alias("method"), F.round("rrf", 6).alias("rrf"), F.round(0.50 * F.col("rrf") + 0.30 * v + 0.20 * k, 6).alias("score"))


@query("w25_canonical_sort", "W25", "W23", sql=f"""WITH {S.CANDIDATES} SELECT qid, chunk_key, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS place FROM candidates""")
def w25_canonical_sort(spark, d):
    ranked = R.rank_in(C.candidates(spark, d), ["qid"], R.canonical_order(), "place")
    return ranked.select("qid", "chunk_key", F.col("place").cast("long").alias("place"))


@query("w1_top_per_document", "W1", "W3", "W4", "J3", "J4", "V7", sql=f"""WITH {S.CANDIDATES}
SELECT qid, document_id, chunk_key, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY {ORDER_SQL}) AS n FROM candidates) WHERE n <= 2""")
def w1_top_per_document(spark, d):
    ranked = R.rank_in(C.candidates(spark, d), ["qid", "document_id"], R.canonical_order(), "place").filter("place <= 2")
    return ranked.select("qid", "document_id", "chunk_key", F.col("place").cast("long").alias("place"))


@query("w9_soft_cap", "W9", sql=f"""WITH {S.CANDIDATES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY {ORDER_SQL}) AS doc, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS al FROM candidates),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN doc > 8 THEN 1 ELSE 0 END, al) AS place FROM r)
SELECT qid, chunk_key, place FROM p WHERE place <= 12""")
def w9_soft_cap(spark, d):
    chosen = R.soft_cap(C.candidates(spark, d), "qid", "document_id", R.canonical_order(), 12)
    return chosen.select("qid", "chunk_key", F.col("place").cast("long").alias("place"))


STRONG_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order} ) AS al FROM candidates),
s AS (SELECT *, max(CASE WHEN al <= {strong} THEN 1 ELSE 0 END) OVER (PARTITION BY qid, document_id) AS seen, row_number() OVER (PARTITION BY qid, document_id ORDER BY al) AS f FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN al <= {strong} THEN 0 WHEN seen = 0 AND f = 1 THEN 1 ELSE 2 END, al) AS p FROM s)
SELECT qid, chunk_key, row_number() OVER (PARTITION BY qid ORDER BY al) AS place FROM t WHERE p <= 10"""


@query("w10_strength_then_diverse", "W10", sql=f"WITH {S.CANDIDATES}, " + STRONG_SQL.format(order=ORDER_SQL, strong=5))
def w10_strength_then_diverse(spark, d):
    chosen = R.strength_then_diverse(C.candidates(spark, d), "qid", "document_id", R.canonical_order(), 10)
    return chosen.select("qid", "chunk_key", F.col("place").cast("long").alias("place"))


@query("w11_strong_sixty", "W11", sql=f"WITH {S.CANDIDATES}, " + STRONG_SQL.format(order=ORDER_SQL, strong=6))
def w11_strong_sixty(spark, d):
    chosen = R.strength_then_diverse(C.candidates(spark, d), "qid", "document_id", R.canonical_order(), 10, 0.6)
    return chosen.select("qid", "chunk_key", F.col("place").cast("long").alias("place"))


@query("w15_round_robin", "W15", "W13", sql=f"""WITH {S.CANDIDATES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY {ORDER_SQL}) AS doc, max(score) OVER (PARTITION BY qid, document_id) AS best FROM candidates),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc, best DESC, document_id, {ORDER_SQL}) AS place FROM r WHERE doc <= 3)
SELECT qid, chunk_key, place FROM p WHERE place <= 12""")
def w15_round_robin(spark, d):
    # The best score is taken before the cut, which keeps each document's best row anyway.
    chosen = R.round_robin(C.candidates(spark, d), "qid", "document_id", R.canonical_order(), "score", 3, 12)
    return chosen.select("qid", "chunk_key", F.col("place").cast("long").alias("place"))


@query("w31_half_fill_cap", "W31", "W14", sql=f"""WITH {S.CANDIDATES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY {ORDER_SQL}) AS doc, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS al FROM candidates),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY al) AS place FROM r WHERE al <= 8 OR doc <= 2)
SELECT qid, chunk_key, place FROM p WHERE place <= 16""")
def w31_half_fill_cap(spark, d):
    chosen = R.half_fill_cap(C.candidates(spark, d), "qid", "document_id", R.canonical_order(), 16, 2)
    return chosen.select("qid", "chunk_key", F.col("place").cast("long").alias("place"))


@query("w29_reading_order", "W29", "R27", sql=f"""WITH {S.CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS al FROM candidates),
m AS (SELECT *, min(al) OVER (PARTITION BY qid, document_id) AS first FROM r)
SELECT qid, chunk_key, row_number() OVER (PARTITION BY qid ORDER BY first, page_number, chunk_index, chunk_id) AS place FROM m""")
def w29_reading_order(spark, d):
    ranked = R.rank_in(C.candidates(spark, d), ["qid"], R.canonical_order(), "al")
    first = ranked.withColumn("first", F.min("al").over(R.Window.partitionBy("qid", "document_id")))
    placed = R.rank_in(first, ["qid"], [F.col("first"), F.col("page_number"), F.col("chunk_index"), F.col("chunk_id")], "place")
    return placed.select("qid", "chunk_key", F.col("place").cast("long").alias("place"))


@query("f21_relevance_cutoff", "F21", sql=f"""WITH {S.CANDIDATES}, m AS (SELECT *, max(vector_score) OVER (PARTITION BY qid) AS best FROM candidates)
SELECT qid, chunk_key, vector_score FROM m WHERE best >= 0.08 AND vector_score >= greatest(0.10, best * 0.92)""")
def f21_relevance_cutoff(spark, d):
    return R.relevance_cutoff(C.candidates(spark, d), "qid", "vector_score", relative=0.92).select("qid", "chunk_key", "vector_score")


@query("a16_merge_agreement", "A16", "A12", "U1", "R37", sql=f"""WITH {ARMS_SQL}, m AS (
  SELECT qid, chunk_key, max(s) AS best, count(DISTINCT arm) AS n, string_agg(DISTINCT arm, '+' ORDER BY arm) AS methods FROM arms WHERE arm != 'section' GROUP BY qid, chunk_key)
SELECT qid, chunk_key, round(least(1.0, best + least(0.06, (n - 1) * 0.015)), 6) AS score, methods FROM m""")
def a16_merge_agreement(spark, d):
    merged = R.merge_best(_arms(spark, d).filter("arm != 'section'"), ["qid", "chunk_key"], "arm_score", "arm")
    return merged.select("qid", "chunk_key", F.round("arm_score", 6).alias("score"), F.concat_ws("+", "methods").alias("methods"))


@query("v4_exact_neighbours", "V3", "V4", "V5", sql=f"""WITH {S.VECTORS}, good AS (
  SELECT vec_key, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM vectors WHERE embedding IS NOT NULL),
pairs AS (SELECT q.vec_key AS query_key, b.vec_key AS vec_key, round(greatest(0, list_dot_product(q.e, b.e) / (q.n * b.n)), 6) AS similarity
  FROM good q, good b WHERE q.vec_key % 100 = 0 AND q.vec_key != b.vec_key AND q.n > 0 AND b.n > 0)
SELECT query_key, vec_key, similarity, place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY similarity DESC, vec_key) AS place FROM pairs) WHERE place <= 5""")
def v4_exact_neighbours(spark, d):
    from tarnwick.operators.vectors import exact_neighbours

    return exact_neighbours(C.vectors(spark, d), "vec_key", "embedding", "vec_key % 100 = 0", 5)

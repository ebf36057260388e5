"""Composite rankings, tiers and gates over whole batches of queries; layout on inline rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.hashing import hashing_embeddings
from tarnwick.operators import layout as L
from tarnwick.operators import ranking as R
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col
ORDER_SQL = "score DESC NULLS LAST, lower(filename), page_number, coalesce(chunk_index, -1), chunk_id"


@query("r12_relevance_score", "R12", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, x AS (SELECT qid, chunk_key, coalesce(vector_score, 0) AS r, {S.terms_smart('question')} AS q, {S.terms_smart('chunks.text')} AS b, {S.terms_smart("array_to_string(chunks.section_path, ' ')")} AS h,
 length(regexp_replace(chunks.text, '[^A-Za-z0-9]', '', 'g')) < 18 AS low FROM candidates JOIN query_plans USING (qid) JOIN chunks USING (chunk_key)),
y AS (SELECT *, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(q) END AS cov, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, h)) / len(q) END AS head FROM x)
SELECT qid, chunk_key, round(greatest(0.0, least(1.0, (least(1.0, greatest(0.0, r)) * 0.36 + cov * 0.34 + head * 0.12 + least(1.0, cov) * 0.08) * CASE WHEN low THEN 0.12 ELSE 1 END * CASE WHEN len(q) > 0 AND cov < 0.12 THEN 0.55 ELSE 1 END)), 6) AS relevance FROM y""")
def r12_relevance_score(spark, d):
    rows = C.candidates(spark, d).select("qid", "chunk_key", F.coalesce("vector_score", F.lit(0.0)).alias("r")).join(C.plans(spark, d).select("qid", "question"), "qid").join(C.chunks(spark, d, "text", "section_path"), "chunk_key")
    q = T.terms_smart(c("question"))
    rows = rows.select("qid", "chunk_key", "r", F.size(q).alias("n"), T.coverage(q, T.terms_smart(c("text"))).alias("cov"), T.coverage(q, T.terms_smart(F.array_join("section_path", " "))).alias("head"), (F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) < 18).alias("low"))
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("r"))) * 0.36 + c("cov") * 0.34 + c("head") * 0.12 + F.least(F.lit(1.0), c("cov")) * 0.08
    score = base * F.when(c("low"), 0.12).otherwise(1.0) * F.when((c("n") > 0) & (c("cov") < 0.12), 0.55).otherwise(1.0)
    return rows.select("qid", "chunk_key", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("relevance"))


@query("w17_route_guarantee", "W16", "W17", "W12", sql=f"""WITH {S.CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS al, row_number() OVER (PARTITION BY qid, document_id ORDER BY {ORDER_SQL}) AS doc FROM candidates),
p AS (SELECT qid, chunk_key, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN doc = 1 THEN 0 ELSE 1 END, al) AS place FROM r) SELECT * FROM p WHERE place <= 15""")
def w17_route_guarantee(spark, d):
    ranked = R.rank_in(R.rank_in(C.candidates(spark, d), ["qid"], R.canonical_order(), "al"), ["qid", "document_id"], [c("al")], "doc")
    placed = R.rank_in(ranked, ["qid"], [F.when(c("doc") == 1, 0).otherwise(1), c("al")], "place").filter("place <= 15")
    return placed.select("qid", "chunk_key", c("place").cast("long").alias("place"))


@query("w32_forced_tiers", "W32", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, k AS (SELECT qid, chunk_key, CASE WHEN content_type = 'table_row' THEN 0 WHEN content_type = 'table' THEN 1 WHEN content_type = 'list' THEN 2 ELSE 3 END AS tier,
 row_number() OVER (PARTITION BY qid ORDER BY candidates.score DESC NULLS LAST, lower(candidates.filename), candidates.page_number, coalesce(candidates.chunk_index, -1), candidates.chunk_id) AS al FROM candidates JOIN (SELECT chunk_key, content_type FROM chunks) USING (chunk_key)),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, tier ORDER BY al) AS n FROM k) SELECT qid, chunk_key, row_number() OVER (PARTITION BY qid ORDER BY tier, al) AS place FROM t WHERE n <= CASE tier WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 8 END""")
def w32_forced_tiers(spark, d):
    ranked = R.rank_in(C.candidates(spark, d), ["qid"], R.canonical_order(), "al").join(C.chunks(spark, d, "content_type"), "chunk_key")
    kind = c("content_type")
    tier = F.when(kind == "table_row", 0).when(kind == "table", 1).when(kind == "list", 2).otherwise(3)
    rows = R.rank_in(ranked.withColumn("tier", tier), ["qid", "tier"], [c("al")], "n")
    kept = rows.filter(c("n") <= F.when(c("tier") == 0, 4).when(c("tier") == 1, 2).when(c("tier") == 2, 3).otherwise(8))
    return R.rank_in(kept, ["qid"], [c("tier"), c("al")], "place").select("qid", "chunk_key", c("place").cast("long").alias("place"))


@query("q13_rerank_merge", "Q13", sql=f"""WITH {S.CANDIDATES}, j AS (SELECT qid, chunk_key, keyword_score / (keyword_score + 1) AS relevance FROM candidates WHERE keyword_score IS NOT NULL)
SELECT qid, chunk_key, CAST(round(CASE WHEN relevance IS NULL THEN coalesce(vector_score, 0) - 0.12 ELSE 0.32 * coalesce(vector_score, 0) + 0.68 * relevance END, 6) AS DOUBLE) AS score FROM candidates LEFT JOIN j USING (qid, chunk_key)""")
def q13_rerank_merge(spark, d):
    rows = C.candidates(spark, d).select("qid", "chunk_key", F.coalesce("vector_score", F.lit(0.0)).alias("s"), "keyword_score")
    # Judgments of a reranker are an input; keyword scores stand in for them.
    judged = rows.filter("keyword_score IS NOT NULL").select("qid", "chunk_key", R.squash(c("keyword_score"), 1.0).alias("relevance"))
    score = F.when(c("relevance").isNull(), c("s") - 0.12).otherwise(0.32 * c("s") + 0.68 * c("relevance"))
    return rows.join(judged, ["qid", "chunk_key"], "left").select("qid", "chunk_key", F.round(score, 6).alias("score"))


@query("f24_contributors", "F24", sql=f"""WITH {S.CANDIDATES}, d AS (SELECT qid, document_id FROM candidates GROUP BY ALL HAVING count(*) >= 3), n AS (SELECT qid FROM d GROUP BY qid)
SELECT qid, chunk_key FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS al FROM candidates) x WHERE EXISTS (SELECT 1 FROM d WHERE d.qid = x.qid AND d.document_id = x.document_id) OR (al <= 12 AND NOT EXISTS (SELECT 1 FROM n WHERE n.qid = x.qid))""")
def f24_contributors(spark, d):
    ranked = R.rank_in(C.candidates(spark, d), ["qid"], R.canonical_order(), "al")
    sized = ranked.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("qid", "document_id")))
    sized = sized.withColumn("most", F.max("own").over(Window.partitionBy("qid")))
    return sized.filter((c("own") >= 3) | ((c("most") < 3) & (c("al") <= 12))).select("qid", "chunk_key")


@query("w19_forward_fill", "W19", sql=f"""WITH {S.CHUNKS}, a AS (SELECT chunk_key, document_id, chunk_index, CASE WHEN len(context_tags) = 1 THEN context_tags[1] END AS own FROM chunks)
SELECT chunk_key, (SELECT arg_max(b.own, b.chunk_index) FROM a b WHERE b.document_id = a.document_id AND b.own IS NOT NULL AND b.chunk_index BETWEEN a.chunk_index - 8 AND a.chunk_index) AS scope FROM a""")
def w19_forward_fill(spark, d):
    rows = C.chunks(spark, d, "document_id", "chunk_index", "context_tags")
    own = F.when(F.size("context_tags") == 1, c("context_tags")[0])
    span = Window.partitionBy("document_id").orderBy("chunk_index").rangeBetween(-8, 0)
    return rows.withColumn("scope", F.last(own, ignorenulls=True).over(span)).select("chunk_key", "scope")


@query("q1_intent", "Q1", sql=f"""WITH x AS (SELECT qid, trim(lower(question)) AS q, {S.tokens('question', '[a-z0-9]+')} AS t FROM query_plans)
SELECT qid, CASE WHEN starts_with(q, 'what ') AND len(list_intersect(t, ['do', 'action', 'actions', 'steps'])) > 0 AND len(list_intersect(t, ['if', 'when'])) > 0 THEN 'procedure'
 WHEN len(list_intersect(t, ['compare', 'comparison', 'difference', 'differences', 'versus', 'vs'])) > 0 THEN 'comparison' WHEN len(list_intersect(t, ['troubleshoot', 'troubleshooting', 'fault', 'failure', 'error', 'alarm'])) > 0 THEN 'troubleshooting'
 WHEN starts_with(q, 'how ') OR len(list_intersect(t, ['process', 'procedure', 'steps', 'reset', 'isolate', 'operate'])) > 0 THEN 'procedure'
 WHEN len(list_intersect(t, ['required', 'requirement', 'requirements', 'must', 'shall', 'prerequisite', 'rules', 'rule'])) > 0 THEN 'requirement' WHEN starts_with(q, 'what does ') OR list_contains(t, 'define') OR starts_with(q, 'what is ') THEN 'definition'
 WHEN len(list_intersect(t, ['summarize', 'summary', 'overview'])) > 0 THEN 'summary' WHEN len(list_intersect(t, ['list', 'types'])) > 0 THEN 'list' ELSE 'fact_lookup' END AS intent FROM x""")
def q1_intent(spark, d):
    q, words = F.trim(F.lower("question")), T.tokens(c("question"), "[a-z0-9]+")
    any_of = lambda text: F.arrays_overlap(words, T.literal_array(text.split()))
    intent = (
        F.when(q.startswith("what ") & any_of("do action actions steps") & any_of("if when"), "procedure")
        .when(any_of("compare comparison difference differences versus vs"), "comparison")
        .when(any_of("troubleshoot troubleshooting fault failure error alarm"), "troubleshooting")
        .when(q.startswith("how ") | any_of("process procedure steps reset isolate operate"), "procedure")
        .when(any_of("required requirement requirements must shall prerequisite rules rule"), "requirement")
        .when(q.startswith("what does ") | any_of("define") | q.startswith("what is "), "definition")
        .when(any_of("summarize summary overview"), "summary")
        .when(any_of("list types"), "list")
        .otherwise("fact_lookup")
    )
    return C.plans(spark, d).select("qid", intent.alias("intent"))


@query("v1_unit_length", "V1", sql=f"WITH {S.CHUNKS} SELECT chunk_key, 128 AS dimensions, TRUE AS unit_length FROM chunks")
def v1_unit_length(spark, d):
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v1_hashing_embedding(spark, d).select("chunk_key", F.size("embedding").cast("long").alias("dimensions"), (F.abs(norm - 1) < 1e-4).alias("unit_length"))


@query("v1_hashing_embedding", "V1")
def v1_hashing_embedding(spark, d):
    return hashing_embeddings(C.chunks(spark, d, "text"), "chunk_key", "text", 128)



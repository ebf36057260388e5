"""Smaller predicates, five-arm and corpus-scan rankings, gates, generations and ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwick.functions import patterns as P
from tarnwick.functions import text as T
from tarnwick.functions import words as W
from tarnwick.operators import block_search as K
from tarnwick.operators import ranking as R
from tarnwick.queries import registry_sql as S
from tarnwick.queries.q_rank import INDEX_SQL, ORDER_SQL, _best_scores
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C
from tarnwick.sources import generations as G
from tarnwick.session import shared_folder
from tarnwick.sources import load

c = F.col


@query("t11_phrase_match", "T11", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, heads AS (SELECT chunk_key, lower(regexp_replace(section_path[len(section_path)], '^[0-9.]+ ', '')) AS head FROM chunks WHERE len(section_path) > 0)
SELECT chunk_key, length({S.canonical_phrase('head')}) >= 4 AND contains({S.canonical_phrase('text')}, {S.canonical_phrase('head')}) AS match FROM heads JOIN chunks USING (chunk_key)""")
def t11_phrase_match(spark, d):
    rows = C.chunks(spark, d, "text", "section_path").filter(F.size("section_path") > 0)
    head = F.lower(F.regexp_replace(F.element_at("section_path", -1), "^[0-9.]+ ", ""))
    return rows.select("chunk_key", (T.phrase_match(head, c("text")) == 1.0).alias("match"))


@query("w2_alias_rows", "W2", "W5", sql=f"""WITH {S.CHUNKS}, h AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN content_type = 'table_row' THEN 0 ELSE 1 END, CASE WHEN heading IS NOT NULL THEN 0 ELSE 1 END, page_number, chunk_index, chunk_key) AS n FROM chunks WHERE regexp_matches(text, '(^|[^A-Za-z0-9])(signal|door)([^A-Za-z0-9]|$)'))
SELECT document_id, chunk_key, n AS place FROM h WHERE n <= 3""")
def w2_alias_rows(spark, d):
    rows = C.chunks(spark, d, "document_id", "content_type", "heading", "page_number", "chunk_index", "text").filter(c("text").rlike("(^|[^A-Za-z0-9])(signal|door)([^A-Za-z0-9]|$)"))
    order = [F.when(c("content_type") == "table_row", 0).otherwise(1), F.when(c("heading").isNotNull(), 0).otherwise(1), c("page_number"), c("chunk_index"), c("chunk_key")]
    return R.rank_in(rows, ["document_id"], order, "place").filter("place <= 3").select("document_id", "chunk_key", c("place").cast("long").alias("place"))


_N, _LONG = S.canonical_phrase("question"), "len(string_split(n, ' ')) >= 2"


def _stems(text: str) -> str:
    return f"list_transform({S.bm25_tokens(text)}, lambda t: {S.stem('t', W.STEM_V5)})"


STEMMED_SQL = INDEX_SQL.replace(S.bm25_tokens("text"), _stems("text")).replace(S.bm25_tokens("question"), _stems("question"))
BLEND = f"""WITH {INDEX_SQL}, {S.CANDIDATES}, parts AS (SELECT chunk_key, {S.canonical_phrase('x')} AS p FROM (SELECT chunk_key, unnest(section_path) AS x FROM chunks)),
a AS (SELECT qid, chunk_key, coalesce(vector_score, 0) AS v, coalesce(bm25 / (bm25 + 4.0), 0) AS kw, {S.terms_smart('question')} AS q, {S.terms_smart('text')} AS b, {_N} AS n, {S.canonical_phrase('text')} AS t
  FROM candidates LEFT JOIN scored USING (qid, chunk_key) JOIN query_plans USING (qid) JOIN chunks USING (chunk_key)),
s AS (SELECT qid, chunk_key, max(CASE WHEN p = '' OR length(n) < 3 THEN 0 WHEN p = n THEN 1 WHEN {_LONG} AND contains(' ' || p || ' ', ' ' || n || ' ') THEN 0.88
  WHEN {_LONG} AND contains(' ' || n || ' ', ' ' || p || ' ') THEN 0.72 ELSE 0 END) AS section FROM a JOIN parts USING (chunk_key) GROUP BY ALL),
y AS (SELECT qid, chunk_key, v, kw, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(q) END AS lex, CASE WHEN length(n) >= 4 AND contains(t, n) THEN 1 ELSE 0 END AS phrase, CAST(coalesce(section, 0) AS DOUBLE) AS section FROM a LEFT JOIN s USING (qid, chunk_key))"""


def _stemmed(text):
    """Tokens of the keyword index under the light stemmer."""
    return F.transform(T.bm25_tokens(text), lambda t: T.stem(t, W.STEM_V5))


# Scores have few decimals, so that half a unit of the last one kept may occur: 1e-10 settles how it is rounded.
def _blend(spark, d, stemmed=False):
    candidates = C.candidates(spark, d).select("qid", "chunk_key", F.coalesce("vector_score", F.lit(0.0)).alias("v"))
    asked, scores = C.plans(spark, d).select("qid", "question"), {"kw": T.bm25_tokens} | ({"stem_kw": _stemmed} if stemmed else {})
    q, text = c("question"), c("text")
    for name, tokens in scores.items():
        terms = C.plans(spark, d).select("qid", F.explode(F.array_distinct(tokens(q))).alias("term"), F.lit(1.0).alias("weight"))
        weighed = K.weigh(terms, *K.frequencies(C.chunks(spark, d, "text"), tokens(text)))
        asked = asked.join(weighed.select("qid", *[c(x).alias(f"{name}_{x}") for x in ("terms", "weights", "avgdl")]), "qid", "left")
    rows = candidates.join(asked, "qid").join(C.chunks(spark, d, "text", "section_path"), "chunk_key")
    lex = T.coverage(T.terms_smart(q), T.terms_smart(text))
    more = [T.phrase_match(q, text).alias("phrase"), T.section_match(q, c("section_path")).alias("section")] if stemmed else []
    given = [column for name, tokens in scores.items() for column in (K.hashed(tokens(text)).alias(f"{name}_words"), *(f"{name}_{x}" for x in ("terms", "weights", "avgdl")))]
    scored = K.pair_scores(rows.select("qid", "chunk_key", "v", lex.alias("lex"), *more, *given), *scores)
    return scored.select("qid", "chunk_key", "v", *[R.squash(c(name), 4.0).alias(name) for name in scores], "lex", *(["phrase", "section"] if stemmed else []))


def _five_arms():
    """The weighted sum of v, kw, lex, phrase and section; a section that matches sets a floor."""
    blended = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("v") * 0.36 + c("kw") * 0.24 + c("lex") * 0.18 + c("phrase") * 0.10 + c("section") * 0.12))
    return F.when(c("section") > 0, F.greatest(blended, 0.78 + c("section") * 0.18)).otherwise(blended)


@query("r5_five_arm_blend", "R5", "R6", sql=f"""WITH x AS (SELECT *, least(1.0, greatest(0.0, v * 0.36 + kw * 0.24 + lex * 0.18 + phrase * 0.10 + section * 0.12)) AS blend FROM ({BLEND} SELECT * FROM y)),
o AS (WITH {STEMMED_SQL}, {S.CANDIDATES} SELECT qid, chunk_key, bm25 / (bm25 + 4.0) AS kw FROM scored JOIN candidates USING (qid, chunk_key))
SELECT qid, chunk_key, round(CASE WHEN section > 0 THEN greatest(blend, 0.78 + section * 0.18) ELSE blend END + 1e-10, 6) AS score, round(least(0.93, 0.36 + 0.38 * coalesce(o.kw, 0) + 0.20 * lex), 6) AS stemmed FROM x LEFT JOIN o USING (qid, chunk_key)""")
def r5_five_arm_blend(spark, d):
    return _blend(spark, d, True).select("qid", "chunk_key", F.round(_five_arms() + 1e-10, 6).alias("score"), F.round(F.least(F.lit(0.93), 0.36 + 0.38 * c("stem_kw") + 0.20 * c("lex")), 6).alias("stemmed"))


@query("r8_smart_blend", "R8", sql=BLEND + " SELECT qid, chunk_key, round(least(1.0, v * 0.46 + kw * 0.30 + lex * 0.24 + 1e-10), 6) AS score, round(least(1.0, 0.42 + 0.38 * kw + 0.20 * lex + 1e-10), 6) AS scan FROM y")
def r8_smart_blend(spark, d):
    return _blend(spark, d).select("qid", "chunk_key", F.round(F.least(F.lit(1.0), c("v") * 0.46 + c("kw") * 0.30 + c("lex") * 0.24 + 1e-10), 6).alias("score"), F.round(F.least(F.lit(1.0), 0.42 + 0.38 * c("kw") + 0.20 * c("lex") + 1e-10), 6).alias("scan"))


_PRIORITY = f"list_slice(list_sort({S.priority_terms('question')}), 1, 5)"


@query("r9_corpus_scan", "R9", sql=f"""WITH {INDEX_SQL}, k AS (SELECT qid, chunk_key, bm25, bm25 / (bm25 + 4.0) AS kw, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, chunk_key) AS n FROM scored),
t AS (SELECT qid, {S.terms_smart('question')} AS q, {S.priority_terms('question')} AS p, {_PRIORITY} AS need FROM query_plans), b AS (SELECT chunk_key, {S.terms_smart('text')} AS b FROM chunks),
w AS (SELECT qid, chunk_key, kw, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(q) END AS lex, CASE WHEN len(p) = 0 THEN NULL ELSE len(list_intersect(p, b)) / len(p) END AS first FROM k JOIN t USING (qid) JOIN b USING (chunk_key) WHERE n <= 160),
s AS (SELECT qid, chunk_key, least(1.0, 0.42 + 0.38 * kw + 0.20 * coalesce(least(1.0, first * 0.74 + lex * 0.26), lex)) AS score FROM w
  UNION ALL SELECT qid, chunk_key, least(1.0, 0.82 + 0.16 * kw) FROM (SELECT qid, chunk_key, coalesce(kw, 0) AS kw, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(bm25, 0), 9) DESC, chunk_key) AS n FROM t JOIN b ON len(need) > 0 AND list_has_all(b, need) LEFT JOIN k USING (qid, chunk_key)) WHERE n <= 80)
SELECT qid, chunk_key, round(max(score) + 1e-10, 6) AS score FROM s GROUP BY qid, chunk_key""")
def r9_corpus_scan(spark, d):
    """The reference's fallback over the whole corpus: its limits are 160 chunks by keyword and 80 with all of the first five priority terms."""
    q, kw = c("question"), R.squash(c("bm25"), 4.0)
    first = T.priority_terms(q)
    rows = _best_scores(spark, d, 160, every=T.terms_smart(q), first=first, need=F.slice(F.array_sort(first), 1, 5), most_having=80)
    rows = rows.join(C.plans(spark, d).select("qid", F.size(T.terms_smart(q)).alias("n"), F.size(first).alias("n_first")), "qid")
    every = F.when(c("n") > 0, c("met") / c("n")).otherwise(0.0)
    lexical = F.when(c("n_first") > 0, F.least(F.lit(1.0), c("met_first") / c("n_first") * 0.74 + every * 0.26)).otherwise(every)
    score = F.least(F.lit(1.0), F.when(c("having"), 0.82 + 0.16 * kw).otherwise(0.42 + 0.38 * kw + 0.20 * lexical))
    return rows.groupBy("qid", "chunk_key").agg(F.round(F.max(score) + 1e-10, 6).alias("score"))


@query("r18_scoped_candidates", "R18", sql=f"""WITH {S.CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS rank FROM candidates), d AS (SELECT qid, document_id, max(coalesce(vector_score, 0)) AS route FROM candidates GROUP BY ALL)
SELECT qid, chunk_key, round(0.54 * coalesce(vector_score, 0) + 0.24 * route + 0.22 / (1 + rank / 8.0), 6) AS score FROM r JOIN d USING (qid, document_id)""")
def r18_scoped_candidates(spark, d):
    ranked = R.rank_in(C.candidates(spark, d), ["qid"], R.canonical_order())
    v = F.coalesce("vector_score", F.lit(0.0))
    rows = ranked.withColumn("route", F.max(v).over(R.Window.partitionBy("qid", "document_id")))
    return rows.select("qid", "chunk_key", F.round(0.54 * v + 0.24 * c("route") + 0.22 / (1 + c("rank") / 8.0), 6).alias("score"))


@query("r40_backbone", "R40", "Q8", sql="""SELECT qid, coalesce(intent IN ('procedure', 'troubleshooting', 'requirement'), false) OR regexp_matches(question, '[A-Z]{2}-[0-9]+') AS backbone, trim(regexp_replace(regexp_replace(question, '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) AS relaxed,
 length(question) <= 900 AND length(question) > 0 AS safe FROM query_plans""")
def r40_backbone(spark, d):
    q = c("question")
    procedural = F.coalesce(c("intent").isin("procedure", "troubleshooting", "requirement"), F.lit(False))
    relaxed = F.trim(F.regexp_replace(F.regexp_replace(q, "[0-9]+", ""), r"\s+", " "))
    return C.plans(spark, d).select("qid", (procedural | q.rlike("[A-Z]{2}-[0-9]+")).alias("backbone"), relaxed.alias("relaxed"), F.char_length(q).between(1, 900).alias("safe"))


@query("r29_valid_claims", "R29", "R34", sql=f"""WITH {S.AUDIT}, s AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(response, '\\[S([0-9]+)\\]', 1), lambda n: CAST(n AS INT)))) AS source_no FROM audit WHERE response IS NOT NULL), valid AS (SELECT unnest([1, 2, 3, 4]) AS source_no)
SELECT id, count(*) FILTER (WHERE source_no IN (SELECT source_no FROM valid)) AS valid, count(*) AS cited FROM s GROUP BY id""")
def r29_valid_claims(spark, d):
    rows = C.audit(spark, d).filter("response IS NOT NULL")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("response", F.lit(r"\[S([0-9]+)\]"), F.lit(1)), lambda n: n.cast("int")))
    cited = rows.select("id", F.explode(numbers).alias("source_no"))
    valid = spark.createDataFrame([(n, True) for n in range(1, 5)], "source_no int, ok boolean")
    return cited.join(F.broadcast(valid), "source_no", "left").groupBy("id").agg(F.count_if(c("ok")).alias("valid"), F.count("*").alias("cited"))


@query("s23_document_audit", "S23", sql=f"""WITH {S.CHUNKS}, {S.FILES} SELECT f.filename, chunk_key, k.page_number, strpos(lower(text), 'register') AS at FROM chunks k JOIN files f USING (document_id) WHERE f.filename LIKE '%Operating%' AND contains(lower(text), 'register')""")
def s23_document_audit(spark, d):
    named = C.files(spark, d).filter(c("filename").like("%Operating%")).select("document_id", "filename")
    rows = C.chunks(spark, d, "document_id", "page_number", "text").filter(F.contains(F.lower("text"), F.lit("register")))
    return rows.join(named, "document_id").select("filename", "chunk_key", "page_number", F.locate("register", F.lower("text")).cast("long").alias("at"))


def _folder(spark) -> str:
    """A folder of its own that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("s11_generations", "S10", "S11", sql=f"""WITH {S.CHUNKS} SELECT document_id, CASE WHEN min(page_number) > 1 OR document_id LIKE '0%' THEN 'r2' ELSE 'r1' END AS run_id, count(*) AS chunks FROM chunks GROUP BY document_id""")
def s11_generations(spark, d):
    counts = C.chunks(spark, d, "document_id", "page_number").groupBy("document_id").agg(F.count("*").alias("chunks"), F.min("page_number").alias("first"))
    root = _folder(spark)
    G.publish(counts, root, "chunk_counts", "r1")
    G.publish(counts.filter("first > 1 OR document_id LIKE '0%'"), root, "chunk_counts", "r2")
    return G.active(spark, root, "chunk_counts").select("document_id", "run_id", "chunks")


@query("x6_stream_ingest", "X6", sql="SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def x6_stream_ingest(spark, d):
    from tarnwick.streaming.ingest import ingest, settled

    root = _folder(spark)
    ingest(spark, f"{d}/events.parquet*", load(spark, d, "events").schema, f"{root}/events", f"{root}/state").awaitTermination()
    return settled(spark, f"{root}/events", ["event_id"], "ts").groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))

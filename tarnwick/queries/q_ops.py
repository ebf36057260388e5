"""Aggregates, distinct, listings, diagnostics, history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C
from tarnwick.sources import load

c = F.col


@query("s7_document_listing", "S7", "S25", sql=f"WITH {S.FILES} SELECT document_id, filename, status, row_number() OVER (ORDER BY created_at DESC, document_id) AS place FROM files")
def s7_document_listing(spark, d):
    from tarnwick.operators.paging import number_rows

    return number_rows(C.files(spark, d).select("document_id", "filename", "status", "created_at"), [c("created_at").desc_nulls_last(), c("document_id").asc()], "place").drop("created_at")


@query("s8_opening_text", "S8", "A6", sql=f"""WITH {S.CHUNKS} SELECT document_id, string_agg(left(text, 80), chr(10) ORDER BY chunk_index, chunk_key) AS opening FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_key) AS n FROM chunks) WHERE n <= 2 GROUP BY document_id""")
def s8_opening_text(spark, d):
    rows = C.chunks(spark, d, "document_id", "chunk_index", "text").select("document_id", "chunk_index", "chunk_key", F.substring("text", 1, 80).alias("text"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_key"))).filter("n <= 2")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])  # two parts
    return first.groupBy("document_id").agg(F.array_join(parts, "\n").alias("opening"))


@query("s9_identity_pages", "S9", sql=f"WITH {S.CHUNKS}, {S.FILES} SELECT chunk_key, page_number FROM chunks WHERE page_number <= 2 AND document_id IN (SELECT document_id FROM files WHERE page_count >= 20)")
def s9_identity_pages(spark, d):
    large = C.files(spark, d).filter("page_count >= 20").select("document_id")
    return C.chunks(spark, d, "page_number", "document_id").filter("page_number <= 2").join(large, "document_id", "left_semi").select("chunk_key", "page_number")


@query("s13_upsert_latest", "S13", "A13", sql=f"WITH {S.CANDIDATES} SELECT qid, chunk_key, score, vector_score, keyword_score FROM candidates")
def s13_upsert_latest(spark, d):
    return C.candidates(spark, d).select("qid", "chunk_key", "score", "vector_score", "keyword_score")


@query("s17_eviction", "S17", sql=f"""WITH {S.FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY uploaded_by ORDER BY coalesce(processed_at, created_at) DESC, document_id) AS n FROM files)
SELECT document_id, n <= 3 AS kept FROM r""")
def s17_eviction(spark, d):
    at = F.coalesce("processed_at", "created_at")
    rank = F.row_number().over(Window.partitionBy("uploaded_by").orderBy(at.desc(), "document_id"))
    return C.files(spark, d).select("document_id", (rank <= 3).alias("kept"))


@query("s21_batch_claim", "S21", "S22", sql=f"""WITH {S.FILES} SELECT status, count(*) AS documents, count(*) FILTER (WHERE processed_at IS NULL) AS claimable, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM files GROUP BY status""")
def s21_batch_claim(spark, d):
    return C.files(spark, d).groupBy("status").agg(F.count("*").alias("documents"), F.count_if(c("processed_at").isNull()).alias("claimable"), F.sum("chunk_count").alias("chunks"))


@query("a2_ambiguous_headings", "A2", "A3", sql=f"""WITH {S.CHUNKS} SELECT heading, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM chunks WHERE heading IS NOT NULL GROUP BY heading HAVING count(DISTINCT document_id) > 1""")
def a2_ambiguous_headings(spark, d):
    rows = C.chunks(spark, d, "heading", "document_id").filter("heading IS NOT NULL")
    return rows.groupBy("heading").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("chunks")).filter("documents > 1")


@query("a4_dashboard", "A4", "A5", "A19", sql=f"""WITH {S.CHUNKS}, {S.FILES}, {S.PAGES}, {S.VECTORS} SELECT (SELECT count(*) FROM files) AS documents, (SELECT count(*) FROM files WHERE status = 'ready') AS ready,
 (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages WHERE ocr_used) AS scanned, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM vectors WHERE embedding IS NOT NULL) AS vectors,
 (SELECT CAST(sum(len(warnings)) AS BIGINT) FROM files) AS warnings, (SELECT round(100.0 * count(*) FILTER (WHERE status = 'ready') / greatest(count(*), 1), 2) FROM files) AS ready_percent""")
def a4_dashboard(spark, d):
    files = C.files(spark, d).agg(F.count("*").alias("documents"), F.count_if(c("status") == "ready").alias("ready"), F.sum(F.size(F.coalesce("warnings", F.array().cast("array<string>")))).alias("warnings"))
    files = files.withColumn("ready_percent", F.round(100.0 * c("ready") / F.greatest("documents", F.lit(1)), 2))
    pages = C.pages(spark, d).select("page_id", "ocr_used").agg(F.count("*").alias("pages"), F.count_if("ocr_used").alias("scanned"))
    chunks = C.chunks(spark, d, "document_id").agg(F.count("*").alias("chunks"))
    vectors = C.vectors(spark, d).agg(F.count("embedding").alias("vectors"))
    out = files
    for one in (pages, chunks, vectors):
        out = out.join(F.broadcast(one))  # one row each
    return out


@query("a8_facets", "A8", sql=f"WITH {S.CHUNKS} SELECT content_type, settings_profile, count(*) AS chunks, count(*) FILTER (WHERE ocr_used) AS scanned FROM chunks GROUP BY ALL")
def a8_facets(spark, d):
    return C.chunks(spark, d, "content_type", "settings_profile", "ocr_used").groupBy("content_type", "settings_profile").agg(F.count("*").alias("chunks"), F.count_if("ocr_used").alias("scanned"))


@query("a11_section_rollup", "A11", sql=f"""WITH {S.CHUNKS} SELECT document_id, heading, min(page_number) AS page_start, max(coalesce(page_end, page_number)) AS page_end, min(chunk_index) AS first_index, max(chunk_index) AS last_index, count(*) AS chunks
FROM chunks WHERE heading IS NOT NULL GROUP BY ALL""")
def a11_section_rollup(spark, d):
    rows = C.chunks(spark, d, "document_id", "heading", "page_number", "page_end", "chunk_index").filter("heading IS NOT NULL")
    return rows.groupBy("document_id", "heading").agg(F.min("page_number").alias("page_start"), F.max(F.coalesce("page_end", "page_number")).alias("page_end"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count("*").alias("chunks"))


METHOD = "lower(regexp_replace(retrieval_method, '[^A-Za-z]+', '+', 'g'))"


@query("a20_document_signals", "A20", "A21", "R16", sql=f"""WITH {S.CANDIDATES} SELECT qid, document_id, max(vector_score) AS vector, max(keyword_score) AS keyword, count(*) AS hits, count(DISTINCT {METHOD}) AS methods, min(page_number) AS first_page,
CASE WHEN count(*) >= 3 AND max(vector_score) >= 0.5 THEN 'deep' WHEN count(*) >= 2 THEN 'routed' ELSE 'incidental' END AS decision FROM candidates GROUP BY ALL""")
def a20_document_signals(spark, d):
    method = F.lower(F.regexp_replace("retrieval_method", "[^A-Za-z]+", "+"))
    signals = C.candidates(spark, d).groupBy("qid", "document_id").agg(F.max("vector_score").alias("vector"), F.max("keyword_score").alias("keyword"), F.count("*").alias("hits"), F.countDistinct(method).alias("methods"), F.min("page_number").alias("first_page"))
    decision = F.when((c("hits") >= 3) & (c("vector") >= 0.5), "deep").when(c("hits") >= 2, "routed").otherwise("incidental")
    return signals.withColumn("decision", decision)


@query("r10_route_documents", "R10", sql=f"""WITH {S.CANDIDATES}, s AS (SELECT qid, document_id, sum(0.24 / (6 + rank)) + max(coalesce(vector_score, 0)) * 0.5 AS signal FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, lower(filename), page_number, coalesce(chunk_index, -1), chunk_id) AS rank FROM candidates) GROUP BY ALL),
n AS (SELECT qid, document_id, round(signal / max(signal) OVER (PARTITION BY qid), 6) AS route FROM s)
SELECT qid, document_id, route, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY route DESC, document_id) AS place FROM n) WHERE place <= 8""")
def r10_route_documents(spark, d):
    from tarnwick.operators import ranking as R

    ranked = R.rank_in(C.candidates(spark, d), ["qid"], R.canonical_order())
    signal = ranked.groupBy("qid", "document_id").agg((F.sum(0.24 / (6 + c("rank"))) + F.max(F.coalesce("vector_score", F.lit(0.0))) * 0.5).alias("signal"))
    route = signal.withColumn("route", F.round(c("signal") / F.max("signal").over(Window.partitionBy("qid")), 6)).drop("signal")
    best = R.rank_in(route, ["qid"], [c("route").desc(), c("document_id")], "place").filter("place <= 8")
    return best.withColumn("place", c("place").cast("long"))


@query("w21_history_window", "W21", "W30", sql=f"""WITH {S.AUDIT}, t AS (SELECT id, chat_session_id, created_at, least(length(question) + coalesce(length(response), 0), 1200) AS n FROM audit WHERE question IS NOT NULL AND chat_session_id IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS turn, sum(n) OVER (PARTITION BY chat_session_id ORDER BY created_at DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM t WINDOW w AS (PARTITION BY chat_session_id ORDER BY created_at DESC, id))
SELECT id, chat_session_id, turn, CAST(used AS BIGINT) AS used FROM r WHERE turn <= 6 AND used <= 3000""")
def w21_history_window(spark, d):
    rows = C.audit(spark, d).filter("question IS NOT NULL AND chat_session_id IS NOT NULL")
    rows = rows.select("id", "chat_session_id", "created_at", F.least(F.char_length("question") + F.coalesce(F.char_length("response"), F.lit(0)), F.lit(1200)).alias("n"))
    by = Window.partitionBy("chat_session_id").orderBy(c("created_at").desc(), "id")
    rows = rows.withColumn("turn", F.row_number().over(by).cast("long")).withColumn("used", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("turn <= 6 AND used <= 3000").select("id", "chat_session_id", "turn", "used")


@query("w26_worst_pages", "W26", sql=f"""WITH {S.PAGES} SELECT page_id, n FROM (SELECT page_id, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY length(coalesce(text, '')), page_id) AS place FROM pages) WHERE place <= 30""")
def w26_worst_pages(spark, d):
    return C.pages(spark, d).select("page_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).orderBy("n", "page_id").limit(30)  # a report of the worst


@query("t46_json_access", "T46", sql=f"""WITH {S.AUDIT} SELECT id, json_type(event_metadata) AS kind, len(json_keys(event_metadata)) AS fields FROM audit WHERE event_metadata IS NOT NULL""")
def t46_json_access(spark, d):
    rows = C.audit(spark, d).filter("event_metadata IS NOT NULL")
    kind = F.when(F.trim("event_metadata").startswith("{"), "OBJECT").when(F.trim("event_metadata").startswith("["), "ARRAY")
    return rows.select("id", kind.alias("kind"), F.size(F.json_object_keys("event_metadata")).cast("long").alias("fields"))


@query("x3_latest_event", "X3", sql=f"""WITH {S.AUDIT} SELECT user_id, event_type, arg_max(id, (created_at, id)) AS last_id, count(*) AS events FROM audit WHERE user_id IS NOT NULL GROUP BY ALL""")
def x3_latest_event(spark, d):
    rows = C.audit(spark, d).filter("user_id IS NOT NULL")
    return rows.groupBy("user_id", "event_type").agg(F.max_by("id", F.struct("created_at", "id")).alias("last_id"), F.count("*").alias("events"))


@query("q15_query_variants", "Q3", "Q15", sql="""WITH v AS (SELECT qid, 0 AS ord, question AS q FROM query_plans UNION ALL SELECT qid, i, search_queries[i] FROM query_plans, generate_series(1, 20) g(i) WHERE i <= len(search_queries)
 UNION ALL SELECT qid, 100 + i, question || ' ' || evidence_needs[i] FROM query_plans, generate_series(1, 20) g(i) WHERE i <= len(evidence_needs)),
n AS (SELECT qid, ord, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS q FROM v WHERE q IS NOT NULL), u AS (SELECT qid, lower(q) AS k, min(ord) AS ord, arg_min(q, ord) AS q FROM n WHERE q != '' GROUP BY qid, lower(q))
SELECT qid, q AS variant, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord) AS place FROM u) WHERE place <= 10""")
def q15_query_variants(spark, d):
    plans = C.plans(spark, d)
    every = F.concat(F.array("question"), F.coalesce("search_queries", F.array().cast("array<string>")), F.transform(F.coalesce("evidence_needs", F.array().cast("array<string>")), lambda n: F.concat(c("question"), F.lit(" "), n)))
    rows = plans.select("qid", F.posexplode(every).alias("at", "q")).filter("q IS NOT NULL").withColumn("q", F.trim(F.regexp_replace("q", r"\s+", " "))).filter("q != ''")
    first = rows.groupBy("qid", F.lower("q").alias("k")).agg(F.min("at").alias("at"), F.min_by("q", "at").alias("variant"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at")).cast("long")
    return first.select("qid", "variant", place.alias("place")).filter("place <= 10")


@query("j2_join_dimension", "J1", "J2", sql="""SELECT n_name AS nation, r_name AS region, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def j2_join_dimension(spark, d):
    orders, customer, nation, region = (load(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, c("c_nationkey") == c("n_nationkey")).join(region, c("n_regionkey") == c("r_regionkey"))
    return joined.groupBy(c("n_name").alias("nation"), c("r_name").alias("region")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a9_pricing_summary", "A9", sql="""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def a9_pricing_summary(spark, d):
    rows = load(spark, d, "lineitem").filter(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))

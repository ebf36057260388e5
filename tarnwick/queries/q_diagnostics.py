"""Discovery and diagnostics by document, evidence answers, context selection, aliases and facts of texts, headers of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import evidence_index as I
from tarnwick.operators import ranking as R
from tarnwick.queries import registry_sql as S
from tarnwick.queries.q_ops import METHOD
from tarnwick.queries.q_pipeline import r12_relevance_score
from tarnwick.queries.q_rank import ORDER_SQL
from tarnwick.queries.q_retrieval import r19_discovery_routes, t16_text_affinity
from tarnwick.queries.q_tables import _TABLES, RULES, _page_tables
from tarnwick.queries.registry import query, registered
from tarnwick.session import shared_folder
from tarnwick.sources import corpus as C

c = F.col
R12, R19 = (registered(name).sql for name in ("r12_relevance_score", "r19_discovery_routes"))


def _method():
    return F.lower(F.regexp_replace("retrieval_method", "[^A-Za-z]+", "+"))


# Discovery and diagnostics
@query("r20_unified_discovery", "R20", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, x AS (SELECT qid, k.document_id, coalesce(vector_score, 0) AS v, {METHOD} AS m, {S.terms_smart('question')} AS q, {S.terms_smart('k.text')} AS t FROM candidates JOIN query_plans USING (qid) JOIN chunks k USING (chunk_key)),
g AS (SELECT qid, document_id, max(v) AS signal, count(DISTINCT m) AS methods, any_value(q) AS q, list_distinct(flatten(list(t))) AS t FROM x GROUP BY ALL)
SELECT qid, document_id, round(0.58 * least(1.0, signal) + 0.30 * CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END + 0.12 * least(1.0, methods / 3) + 1e-10, 6) AS score, CASE WHEN signal >= 0.5 AND methods >= 2 THEN 'confirmed' WHEN signal >= 0.3 THEN 'likely' ELSE 'weak' END AS decision FROM g""")
def r20_unified_discovery(spark, d):
    """Documents by 0.58 of their best signal, 0.30 of the question's terms that their candidates have, 0.12 of agreement of methods."""
    rows = C.candidates(spark, d).select("qid", "chunk_key", F.coalesce("vector_score", F.lit(0.0)).alias("v"), _method().alias("m")).join(C.chunks(spark, d, "document_id", "text"), "chunk_key")
    plans = C.plans(spark, d).select("qid", T.terms_smart(c("question")).alias("q"))
    per = rows.select("qid", "document_id", "v", "m", T.terms_smart(c("text")).alias("t")).groupBy("qid", "document_id").agg(F.max("v").alias("signal"), F.countDistinct("m").alias("methods"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))  # few candidates of a query
    score = 0.58 * F.least(F.lit(1.0), c("signal")) + 0.30 * T.coverage(c("q"), c("t")) + 0.12 * F.least(F.lit(1.0), c("methods") / 3)
    decision = F.when((c("signal") >= 0.5) & (c("methods") >= 2), "confirmed").when(c("signal") >= 0.3, "likely").otherwise("weak")
    return per.join(plans, "qid").select("qid", "document_id", F.round(score + 1e-10, 6).alias("score"), decision.alias("decision"))


@query("r21_balanced_retrieval", "R21", sql=f"""WITH {S.CANDIDATES}, routes AS ({R19}), x AS (SELECT qid, chunk_key, document_id, coalesce(vector_score, 0) AS v, coalesce(keyword_score, 0) AS k, route FROM candidates JOIN routes USING (qid, document_id)),
y AS (SELECT *, CASE WHEN max(k) OVER w > 0 THEN k / max(k) OVER w ELSE 0 END AS kn FROM x WINDOW w AS (PARTITION BY qid)), z AS (SELECT qid, chunk_key, document_id, round(0.70 * greatest(v, kn) + 0.20 * route + CASE WHEN v > 0 AND k > 0 THEN 0.10 ELSE 0 END + 1e-10, 6) AS score FROM y)
SELECT qid, chunk_key, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY score DESC, chunk_key) AS n FROM z) WHERE n <= 4""")
def r21_balanced_retrieval(spark, d):
    """Of each routed document the four best: 0.70 of the better signal, 0.20 of the route, 0.10 if both arms agree."""
    rows = C.candidates(spark, d).select("qid", "chunk_key", "document_id", F.coalesce("vector_score", F.lit(0.0)).alias("v"), F.coalesce("keyword_score", F.lit(0.0)).alias("k"))
    rows = rows.join(r19_discovery_routes(spark, d).select("qid", "document_id", "route"), ["qid", "document_id"])
    most = F.max("k").over(Window.partitionBy("qid"))
    signal = F.greatest("v", F.when(most > 0, c("k") / most).otherwise(0.0))
    scored = rows.select("qid", "chunk_key", "document_id", F.round(0.70 * signal + 0.20 * c("route") + F.when((c("v") > 0) & (c("k") > 0), 0.10).otherwise(0.0) + 1e-10, 6).alias("score"))
    return R.top_in(scored, ["qid", "document_id"], [c("score").desc(), c("chunk_key")], 4).select("qid", "chunk_key", "score")


@query("r17_heading_navigation", "R17")
def r17_heading_navigation(spark, d):
    """Headings of routed documents that are like the question: 0.50, 0.37 of the affinity, 0.13 of the route."""
    near = t16_text_affinity(spark, d).filter("affinity >= 0.26").join(C.chunks(spark, d, "document_id"), "chunk_key")
    routes = r19_discovery_routes(spark, d).select("qid", "document_id", "route")
    return near.join(routes, ["qid", "document_id"]).select("qid", "chunk_key", F.round(0.50 + 0.37 * c("affinity") + 0.13 * c("route"), 6).alias("score"))


_ROLE = f"CASE WHEN contains({METHOD}, '+') THEN 'agreeing' WHEN contains({METHOD}, 'vector') THEN 'semantic' ELSE 'lexical' END"


@query("r32_document_diagnostics", "R31", "R32", "R33", sql=f"""WITH {S.CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS rank, {_ROLE} AS role FROM candidates),
g AS (SELECT qid, document_id, min(rank) AS best_rank, arg_min(chunk_key, rank) AS best_key, CASE min(CASE role WHEN 'agreeing' THEN 0 WHEN 'semantic' THEN 1 ELSE 2 END) WHEN 0 THEN 'agreeing' WHEN 1 THEN 'semantic' ELSE 'lexical' END AS role FROM r GROUP BY ALL)
SELECT *, CASE WHEN best_rank <= 12 THEN 'FINAL_EVIDENCE' ELSE 'ROUTED_NO_FINAL' END AS decision, best_rank <= 12 AND role <> 'lexical' AS required FROM g""")
def r32_document_diagnostics(spark, d):
    """What became of each document of a query: its best row, its strongest role, whether it is among the final evidence, and has to be."""
    ranked = R.rank_in(C.candidates(spark, d), ["qid"], R.canonical_order()).withColumn("m", _method())
    role = F.when(F.contains("m", F.lit("+")), 0).when(F.contains("m", F.lit("vector")), 1).otherwise(2)
    per = ranked.groupBy("qid", "document_id").agg(F.min("rank").cast("long").alias("best_rank"), F.min_by("chunk_key", "rank").alias("best_key"), F.min(role).alias("r"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("agreeing", "semantic", "lexical")]), c("r") + 1)
    final = c("best_rank") <= 12
    return per.select("qid", "document_id", "best_rank", "best_key", name.alias("role"), F.when(final, "FINAL_EVIDENCE").otherwise("ROUTED_NO_FINAL").alias("decision"), (final & (c("r") < 2)).alias("required"))


@query("r13_context_selection", "R13", sql=f"""WITH rel AS ({R12}), {S.CANDIDATES}, b AS (SELECT *, max(relevance) OVER (PARTITION BY qid) AS best FROM rel), k AS (SELECT b.qid, b.chunk_key, relevance, document_id FROM b JOIN candidates USING (qid, chunk_key) WHERE best >= 0.08 AND relevance >= greatest(0.10, best * 0.32)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, chunk_key) AS al, row_number() OVER (PARTITION BY qid, document_id ORDER BY relevance DESC, chunk_key) AS doc FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY al) AS place FROM r WHERE al <= 6 OR doc <= 3)
SELECT qid, chunk_key, relevance, place FROM f WHERE place <= 12""")
def r13_context_selection(spark, d):
    """The context of an answer: candidates near enough to the most relevant one, no document more than three times once half is filled."""
    rows = r12_relevance_score(spark, d).join(C.candidates(spark, d).select("qid", "chunk_key", "document_id"), ["qid", "chunk_key"])
    kept = R.relevance_cutoff(rows, "qid", "relevance")
    chosen = R.half_fill_cap(kept, "qid", "document_id", [c("relevance").desc(), c("chunk_key")], 12, 3)
    return chosen.select("qid", "chunk_key", "relevance", c("place").cast("long").alias("place"))


@query("r26_evidence_answer", "R26", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, r AS (SELECT qid, chunk_key, filename, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS rank FROM candidates)
SELECT qid, string_agg('- ' || r.filename || ': ' || coalesce(k.heading, 'no heading') || ' [S' || rank || ']', chr(10) ORDER BY rank) AS answer FROM r JOIN (SELECT chunk_key, heading FROM chunks) k USING (chunk_key) WHERE rank <= 5 GROUP BY qid""")
def r26_evidence_answer(spark, d):
    """An answer without a model: the five best sources as cited lines."""
    best = R.rank_in(R.top_in(C.candidates(spark, d), ["qid"], R.canonical_order(), 5), ["qid"], R.canonical_order())
    rows = best.select("qid", "chunk_key", "filename", "rank").join(C.chunks(spark, d, "heading"), "chunk_key")
    line = F.concat(F.lit("- "), "filename", F.lit(": "), F.coalesce("heading", F.lit("no heading")), F.lit(" [S"), "rank", F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])  # five of a query
    return rows.groupBy("qid").agg(F.array_join(lines, "\n").alias("answer"))


# Plans
DIMENSIONS = {"limit": "limit maximum minimum threshold", "steps": "steps procedure how", "authority": "who confirms authority approves", "time": "when time duration hours minutes", "difference": "compare difference between versus"}


@query("q14_dimensions", "Q14", "Q5", sql=f"""WITH x AS (SELECT qid, coalesce(intent, '') AS intent, list_distinct(list_concat(coalesce(list_transform(evidence_needs, lambda n: lower(n)), []), list_filter([{', '.join(f"CASE WHEN list_has_any(t, {S.listed(cues.split())}) THEN '{name}' END" for name, cues in DIMENSIONS.items())}], lambda v: v IS NOT NULL))) AS dims
 FROM (SELECT *, {S.tokens('question', '[a-z0-9]+')} AS t FROM query_plans)) SELECT qid, array_to_string(list_sort(dims[:8]), ',') AS dimensions, CASE WHEN intent IN ('comparison', 'summary') OR len(dims) >= 3 THEN 'multi_document' ELSE 'direct' END AS plan FROM x""")
def q14_dimensions(spark, d):
    """What an answer has to speak of: the plan's needs and those that the question's words name, eight at most; many make a plan over documents."""
    tokens = T.tokens(c("question"), "[a-z0-9]+")
    named = F.filter(F.array(*[F.when(F.arrays_overlap(tokens, T.literal_array(cues.split())), name) for name, cues in DIMENSIONS.items()]), lambda v: v.isNotNull())
    needs = F.transform(F.coalesce("evidence_needs", F.array().cast("array<string>")), lambda n: F.lower(n))
    rows = C.plans(spark, d).select("qid", F.coalesce("intent", F.lit("")).alias("intent"), F.array_distinct(F.concat(needs, named)).alias("dims"))
    plan = F.when(c("intent").isin("comparison", "summary") | (F.size("dims") >= 3), "multi_document").otherwise("direct")
    return rows.select("qid", F.array_join(F.array_sort(F.slice("dims", 1, 8)), ",").alias("dimensions"), plan.alias("plan"))


_ALIAS = r"\b[A-Za-z][A-Za-z0-9&]*\b"
_FORM = r"(?i)(?:full form of|meaning of|what does|stands? for|expand|define) ([A-Za-z][A-Za-z0-9&]{1,11})\b"


@query("t55_candidate_aliases", "T24", "T55", "Q10", sql=f"""WITH x AS (SELECT qid, regexp_extract_all(question, '{_FORM}', 1) AS asked, list_filter(regexp_extract_all(regexp_replace(question, '[A-Z]{{2}}-[0-9]+(/[A-Z])?', ' ', 'g'), '{_ALIAS}'), lambda w: upper(w) = w AND length(w) BETWEEN 2 AND 12) AS loud FROM query_plans)
SELECT qid, array_to_string(list_sort(list_distinct(list_transform(list_concat(asked, loud), lambda w: upper(w)))[:12]), ' ') AS aliases FROM x""")
def t55_candidate_aliases(spark, d):
    """Names a question may ask the meaning of: those it asks for in so many words, then those in capitals; codes of documents are none."""
    bare = F.regexp_replace("question", "[A-Z]{2}-[0-9]+(/[A-Z])?", " ")
    loud = F.filter(F.regexp_extract_all(bare, F.lit(_ALIAS), F.lit(0)), lambda w: (F.upper(w) == w) & F.length(w).between(2, 12))
    every = F.array_distinct(F.transform(F.concat(F.regexp_extract_all("question", F.lit(_FORM), F.lit(1)), loud), lambda w: F.upper(w)))
    return C.plans(spark, d).select("qid", F.array_join(F.array_sort(F.slice(every, 1, 12)), " ").alias("aliases"))


# Texts
_FACT = r"(?i)([a-z]+ [a-z]+) (?:is|are|for|in) ([0-9]+(?:\.[0-9]+)?) (per cent|units|minutes|hours|days|months|km/h|bar)\b"


@query("t27_numeric_facts", "T27", sql=f"WITH {S.CHUNKS} SELECT chunk_key, lower(unnest(regexp_extract_all(text, '{_FACT}', 1))) AS subject, CAST(unnest(regexp_extract_all(text, '{_FACT}', 2)) AS DOUBLE) AS value, lower(unnest(regexp_extract_all(text, '{_FACT}', 3))) AS unit FROM chunks")
def t27_numeric_facts(spark, d):
    part = lambda n: F.regexp_extract_all("text", F.lit(_FACT), F.lit(n))
    rows = C.chunks(spark, d, "text").select("chunk_key", F.explode(F.arrays_zip(part(1).alias("s"), part(2).alias("v"), part(3).alias("u"))).alias("z"))
    return rows.select("chunk_key", F.lower("z.s").alias("subject"), c("z.v").cast("double").alias("value"), F.lower("z.u").alias("unit"))


@query("t58_amendment_anchor", "T58", sql=f"""WITH {S.CHUNKS}, x AS (SELECT chunk_key, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM chunks)
SELECT chunk_key, regexp_matches(t, 'shall be substituted|shall be replaced|shall be omitted|amendment rules|amendment regulations') OR (regexp_matches(t, '\\bamend(ed|ment)\\b') AND regexp_matches(t, '\\b(rule|schedule|section|clause|provision)\\b')) AS anchor FROM x""")
def t58_amendment_anchor(spark, d):
    return C.chunks(spark, d, "text").select("chunk_key", T.amendment_anchor(c("text")).alias("anchor"))


@query("j20_rules_of_sections", "J20", sql=f"""WITH {S.CHUNKS}, {RULES}, cards AS (SELECT document_id, heading, count(*) AS chunks, min(page_number) AS page_start FROM chunks WHERE heading IS NOT NULL GROUP BY ALL), own AS (SELECT document_id, heading, count(*) AS rules FROM rules JOIN (SELECT chunk_key, document_id, heading FROM chunks) USING (chunk_key) GROUP BY ALL)
SELECT cards.*, coalesce(rules, 0) AS rules FROM cards LEFT JOIN own USING (document_id, heading)""")
def j20_rules_of_sections(spark, d):
    """Each section's card with the numeric rules of its chunks."""
    chunks = C.chunks(spark, d, "document_id", "heading", "page_number", "text").filter("heading IS NOT NULL")
    rules = I.numeric_rules(chunks, "chunk_key", "text").join(chunks.select("chunk_key", "document_id", "heading"), "chunk_key").groupBy("document_id", "heading").agg(F.count("*").alias("rules"))
    cards = chunks.groupBy("document_id", "heading").agg(F.count("*").alias("chunks"), F.min("page_number").alias("page_start"))
    return cards.join(rules, ["document_id", "heading"], "left").select("document_id", "heading", "chunks", "page_start", F.coalesce("rules", F.lit(0)).alias("rules"))


# Tables
@query("l10_header_row", "L10", sql=f"""WITH {S.CHUNKS}, x AS (SELECT chunk_key, list_transform(string_split(text, chr(10)), lambda l: trim(string_split(l, '|')[1])) AS f FROM chunks WHERE content_type = 'table')
SELECT chunk_key, NOT coalesce(regexp_full_match(f[1], '[0-9]{{1,9}}') AND regexp_full_match(f[2], '[0-9]{{1,9}}') AND try_cast(f[2] AS BIGINT) = try_cast(f[1] AS BIGINT) + 1, false) AS is_header FROM x""")
def l10_header_row(spark, d):
    """The first row is data only where its first cell is a number and the next row's is the number after it."""
    rows = C.chunks(spark, d, "text", "content_type").filter("content_type = 'table'")
    first = F.transform(F.split("text", "\n"), lambda x: F.trim(F.get(F.split(x, r"\|"), F.lit(0))))
    a, b = F.get(first, F.lit(0)), F.get(first, F.lit(1))
    serial = a.rlike("^[0-9]{1,9}$") & b.rlike("^[0-9]{1,9}$") & (b.try_cast("long") == a.try_cast("long") + 1)
    return rows.select("chunk_key", (~F.coalesce(serial, F.lit(False))).alias("is_header"))


@query("l34_similar_columns", "L34", sql=f"""WITH {_TABLES}, t AS (SELECT *, lag(names) OVER o AS before, lag(page_id) OVER o AS other FROM tables WINDOW o AS (PARTITION BY filename ORDER BY page)), p AS (SELECT page_id, other, string_split(lower(names), '|') AS a, string_split(lower(before), '|') AS b FROM t WHERE names IS NOT NULL AND before IS NOT NULL)
SELECT page_id, other, len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: list_has_any(string_split(a[i], ' '), coalesce(string_split(b[i], ' '), [])))) >= 0.5 * len(a) AS similar FROM p""")
def l34_similar_columns(spark, d):
    """Tables that follow each other in a file: as many columns, of which half share a word."""
    by = Window.partitionBy("filename").orderBy("page")
    rows = _page_tables(spark, d).withColumn("before", F.lag("names").over(by)).withColumn("other", F.lag("page_id").over(by)).filter("names IS NOT NULL AND before IS NOT NULL")
    a, b = F.split(F.lower("names"), r"\|"), F.split(F.lower("before"), r"\|")
    alike = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(F.arrays_overlap(F.split(x, " "), F.split(y, " ")), F.lit(False))), lambda v: v))
    return rows.select("page_id", "other", ((F.size(a) == F.size(b)) & (alike >= 0.5 * F.size(a))).alias("similar"))


@query("l33_section_family", "L33", sql=f"""WITH {S.CHUNKS}, x AS (SELECT chunk_key, lower(coalesce(section_path[1], '')) AS a, lag(lower(coalesce(section_path[1], ''))) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_key) AS b FROM chunks) SELECT chunk_key, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS family FROM x WHERE b IS NOT NULL""")
def l33_section_family(spark, d):
    """Does a chunk's outermost heading equal that of the chunk before it, or hold it, or lie within it?"""
    rows = C.chunks(spark, d, "document_id", "chunk_index", "section_path")
    a = F.lower(F.coalesce(F.get("section_path", F.lit(0)), F.lit("")))
    rows = rows.select("chunk_key", a.alias("a"), F.lag(a).over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_key")).alias("b")).filter("b IS NOT NULL")
    return rows.select("chunk_key", ((c("a") != "") & (c("b") != "") & (F.contains("a", c("b")) | F.contains("b", c("a")))).alias("family"))


# Appending
@query("s15_audit_append", "S15", sql=f"WITH {S.AUDIT} SELECT event_type, count(*) AS events, count(*) FILTER (WHERE success) AS successes FROM audit GROUP BY event_type")
def s15_audit_append(spark, d):
    """Events are appended in two writes to one table, chats apart from the rest, and read back as one."""
    rows = C.audit(spark, d).select("id", "event_type", "success")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/audit"
    for part in (c("event_type").startswith("chat"), ~c("event_type").startswith("chat")):
        rows.filter(part).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("events"), F.count_if("success").alias("successes"))

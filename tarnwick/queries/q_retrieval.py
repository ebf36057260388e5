"""Keyword quality with misspellings and phrases, its fusion, corpus scans, routing by windows, gates, fallbacks, contexts and maintenance."""

from __future__ import annotations

import difflib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import words as W
from tarnwick.operators import evidence_index as I
from tarnwick.operators import phrase_search as Z
from tarnwick.operators import ranking as R
from tarnwick.operators import search as X
from tarnwick.queries import registry_sql as S
from tarnwick.queries.q_rank import INDEX_SQL, ORDER_SQL, _best_scores
from tarnwick.queries.q_understanding import ANCHORS_SQL, anchors, required_coverage
from tarnwick.queries.registry import query
from tarnwick.session import cut_lineage, shared_folder
from tarnwick.sources import corpus as C
from tarnwick.sources import generations as G

c = F.col

# R1 and R2
QUALITY_SQL = f"""{S.CHUNKS}, split AS (SELECT chunk_key, {S.bm25_tokens("text")} AS terms FROM chunks), long AS (SELECT chunk_key, len(terms) AS dl, unnest(terms) AS term FROM split),
post AS (SELECT term, chunk_key, dl, count(*) AS tf FROM long GROUP BY ALL), total AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM split), freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
variants AS (SELECT qid, i - 1 AS place, search_queries[i] AS v FROM query_plans, range(1, 21) g(i) WHERE i <= len(search_queries)),
weights AS (SELECT qid, term, sum(w) AS w FROM (SELECT qid, unnest({S.bm25_tokens("v")}) AS term, 1 / (1 + place * 0.2) AS w FROM variants UNION ALL SELECT qid, unnest({S.bm25_tokens("k")}) AS term, 1.4 FROM (SELECT qid, unnest(concepts) AS k FROM query_plans)) GROUP BY ALL),
near AS (SELECT w.term AS asked, f.term, greatest(0, 1 - 1.0 / greatest(length(w.term), length(f.term))) AS ratio FROM (SELECT DISTINCT term FROM weights WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM freq)) w JOIN freq f ON left(w.term, 1) = left(f.term, 1) AND abs(length(w.term) - length(f.term)) <= 1 AND length(f.term) >= 4 AND levenshtein(w.term, f.term) <= 1),
expanded AS (SELECT qid, term, max(w) AS w, max(own) AS own FROM (SELECT qid, term, w, w AS own FROM weights UNION ALL SELECT qid, near.term, w * ratio * 0.8, 0 FROM weights JOIN near ON near.asked = weights.term) GROUP BY ALL),
sums AS (SELECT qid, greatest(sum(w), 1.0) AS all_w FROM weights GROUP BY qid),
raw AS (SELECT qid, chunk_key, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))))) AS bm25, sum(own) AS met FROM expanded JOIN post USING (term) JOIN freq USING (term), total GROUP BY ALL),
phrase AS (SELECT DISTINCT qid, chunk_key FROM raw JOIN variants USING (qid) JOIN chunks USING (chunk_key) WHERE length(v) >= 4 AND contains(lower(text), lower(v))),
quality AS (SELECT qid, chunk_key, round(least(1.0, (bm25 + CASE WHEN p.qid IS NULL THEN 0 ELSE 1 END) / max(bm25 + CASE WHEN p.qid IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY qid) * 0.65 + least(1.0, met / all_w) * 0.35), 9) AS keyword FROM raw LEFT JOIN phrase p USING (qid, chunk_key) JOIN sums USING (qid)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY keyword DESC, chunk_key) AS place FROM quality) WHERE place <= 80)"""


def _quality(spark, d, most=80):
    """(qid, chunk_key, keyword, place): keyword scores that know misspelt words and whole phrases, of the best `most` of each query.

    Terms weigh by the place of their query variant, 1 / (1 + 0.2 i), those of concepts 1.4; a term that the corpus does not have stands for
    words one edit away, at 0.8 of their likeness. The score is 0.65 of the keyword rank, with 1 for a phrase, over the best, and 0.35 of the weight met.
    """
    plans, chunks = C.plans(spark, d), C.chunks(spark, d, "text")
    variants = plans.select("qid", F.posexplode("search_queries").alias("at", "v")).filter("v IS NOT NULL")
    said = variants.select("qid", F.explode(T.bm25_tokens(c("v"))).alias("term"), (1 / (1 + c("at") * 0.2)).alias("w"))
    named = plans.select("qid", F.explode("concepts").alias("k")).select("qid", F.explode(T.bm25_tokens(c("k"))).alias("term"), F.lit(1.4).alias("w"))
    weights = cut_lineage(said.unionByName(named).groupBy("qid", "term").agg(F.sum("w").alias("w")))
    made, frequency, total = Z.blocks(chunks, "chunk_key", "text", T.bm25_tokens(c("text")))
    vocabulary = cut_lineage(chunks.select(F.explode(F.array_distinct(T.bm25_tokens(c("text")))).alias("term")).distinct())
    odd = weights.select("term").distinct().filter(F.length("term") >= 4).join(vocabulary, "term", "left_anti")
    near = X.fuzzy_matches(odd, vocabulary.filter(F.length("term") >= 4), "term", 1)
    near = near.select(c("token").alias("asked"), c("candidate").alias("term"), (1 - 1 / F.greatest(F.length("token"), F.length("candidate"))).alias("ratio"))
    guessed = weights.withColumnRenamed("term", "asked").join(near, "asked").select("qid", "term", (c("w") * c("ratio") * 0.8).alias("w"), F.lit(0.0).alias("own"))
    expanded = weights.select("qid", "term", "w", c("w").alias("own")).unionByName(guessed).groupBy("qid", "term").agg(F.max("w").alias("w"), F.max("own").alias("own"))
    idf = F.log(1 + (c("chunks") - c("df") + 0.5) / (c("df") + 0.5))
    weighed = expanded.withColumn("hash", F.xxhash64("term")).join(frequency, "hash").crossJoin(F.broadcast(total))  # total: one row
    held = F.array_sort(F.collect_list(F.struct("hash", (c("w") * idf).alias("w"), "own")))  # one query's terms
    queries = weighed.groupBy("qid").agg(held.alias("held"), F.first("avgdl").alias("avgdl")).select("qid", c("held.hash").alias("terms"), c("held.w").alias("weights"), c("held.own").alias("own"), "avgdl")
    phrases = variants.filter(F.length("v") >= 4).groupBy("qid").agg(F.collect_set(F.lower("v")).alias("phrases"))
    sums = weights.groupBy("qid").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("all_w"))
    queries = cut_lineage(queries.join(sums, "qid").join(phrases, "qid", "left"))
    rows = Z.quality(made, queries, "chunk_key", most).select("qid", "chunk_key", F.round("keyword", 9).alias("keyword"))
    return R.rank_in(rows, ["qid"], [c("keyword").desc(), c("chunk_key").asc_nulls_last()], "place").filter(c("place") <= most)


@query("r1_keyword_quality", "R1", sql=f"WITH {QUALITY_SQL} SELECT qid, chunk_key, round(keyword, 6) AS keyword FROM top WHERE place <= 20")
def r1_keyword_quality(spark, d):
    return _quality(spark, d, 20).select("qid", "chunk_key", F.round("keyword", 6).alias("keyword"))


@query("r2_hybrid_fuse", "R2", sql=f"""WITH {QUALITY_SQL}, {S.CANDIDATES}, vec AS (SELECT qid, chunk_key, vector_score AS vector, row_number() OVER (PARTITION BY qid ORDER BY vector_score DESC, chunk_key) AS vplace FROM candidates WHERE vector_score > 0),
f AS (SELECT qid, chunk_key, coalesce(vector, 0) AS v, coalesce(keyword, 0) AS k, coalesce(1 / (60.0 + vplace), 0) + coalesce(1 / (60.0 + place), 0) AS r, (CASE WHEN vplace IS NULL THEN 0 ELSE 1 END + CASE WHEN place IS NULL THEN 0 ELSE 1 END) / 61.0 AS most FROM vec FULL JOIN top USING (qid, chunk_key))
SELECT qid, chunk_key, round(least(1.0, greatest(0.0, CASE WHEN v > 0 AND k > 0 THEN v * 0.55 + k * 0.40 + r / most * 0.05 WHEN v > 0 THEN v * 0.95 + r / most * 0.05 ELSE k * 0.95 + r / most * 0.05 END)) + 1e-10, 6) AS score FROM f""")
def r2_hybrid_fuse(spark, d):
    """Vector and keyword scores at 0.55 and 0.40, with 0.05 for the reciprocal ranks; an arm alone counts 0.95."""
    vec = C.candidates(spark, d).filter("vector_score > 0").select("qid", "chunk_key", c("vector_score").alias("vector"))
    vec = R.rank_in(vec, ["qid"], [c("vector").desc(), c("chunk_key")], "vplace")
    both = vec.join(_quality(spark, d), ["qid", "chunk_key"], "full")
    v, k = F.coalesce("vector", F.lit(0.0)), F.coalesce("keyword", F.lit(0.0))
    arm = lambda p: F.coalesce(1 / (60.0 + c(p)), F.lit(0.0))
    arms = c("vplace").isNotNull().cast("int") + c("place").isNotNull().cast("int")
    rank = (arm("vplace") + arm("place")) / (arms / 61.0) * 0.05
    score = F.when((v > 0) & (k > 0), v * 0.55 + k * 0.40 + rank).when(v > 0, v * 0.95 + rank).otherwise(k * 0.95 + rank)
    return both.select("qid", "chunk_key", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) + 1e-10, 6).alias("score"))


@query("r7_corpus_scan", "R7", sql=f"""WITH {INDEX_SQL}, k AS (SELECT qid, chunk_key, bm25 / (bm25 + 4.0) AS kw FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, chunk_key) AS n FROM scored) WHERE n <= 120),
x AS (SELECT qid, chunk_key, kw, {S.terms_smart('question')} AS q, {S.terms_smart('text')} AS b, {S.canonical_phrase('question')} AS n, {S.canonical_phrase('text')} AS t FROM k JOIN query_plans USING (qid) JOIN chunks USING (chunk_key))
SELECT qid, chunk_key, round(least(1.0, 0.30 + len(list_intersect(q, b)) / greatest(len(q), 1) * 0.48 + kw * 0.14 + CASE WHEN length(n) >= 4 AND contains(t, n) THEN 0.08 ELSE 0 END) + 1e-10, 6) AS score FROM x WHERE len(list_intersect(q, b)) >= CASE WHEN len(q) <= 2 THEN 1 ELSE 2 END""")
def r7_corpus_scan(spark, d):
    """All chunks by keyword, the best 120 of each query checked for two of its terms, scored by coverage, keyword and phrase."""
    q, text = c("question"), c("text")
    raw = T.tokens(q, "[a-z0-9]+")
    # A phrase holds all its words but the first and last, which may be parts of words, and numbers, which may be written otherwise.
    loose = 2 + F.size(F.filter(raw, lambda t: t.isin(W.NUMBER_WORDS) | t.rlike("^[0-9]+$")))
    plans = C.plans(spark, d).select("qid", F.size(T.terms_smart(q)).alias("n"), loose.alias("loose"))
    rows = _best_scores(spark, d, 120, every=T.terms_smart(q)).join(plans, "qid").filter(c("met") >= F.when(c("n") <= 2, 1).otherwise(2))
    rows = cut_lineage(rows.select("qid", "chunk_key", "bm25", "met", "n", (c("met") >= c("n") - c("loose")).alias("maybe")))
    near = rows.filter("maybe").select("qid", "chunk_key").join(C.plans(spark, d).select("qid", "question"), "qid").join(C.chunks(spark, d, "text"), "chunk_key")
    phrases = near.filter(T.phrase_match(q, text) > 0).select("qid", "chunk_key", F.lit(1.0).alias("phrase"))
    rows = rows.join(phrases, ["qid", "chunk_key"], "left")
    score = F.least(F.lit(1.0), 0.30 + c("met") / F.greatest("n", F.lit(1)) * 0.48 + R.squash(c("bm25"), 4.0) * 0.14 + F.coalesce("phrase", F.lit(0.0)) * 0.08)
    return rows.select("qid", "chunk_key", F.round(score + 1e-10, 6).alias("score"))


# Routing by windows of neighbouring candidates
WINDOWS_SQL = f"""{S.CANDIDATES}, {S.CHUNKS}, {ANCHORS_SQL}, rows AS (SELECT qid, k.document_id, k.chunk_index, k.chunk_key, coalesce(r.score, 0) AS score, {S.terms_smart('k.text')} AS t, {S.tokens('k.text', '[a-z0-9]+')} AS raw FROM candidates r JOIN chunks k USING (chunk_key)),
m AS (SELECT a.qid, a.document_id, a.chunk_key, max(b.score) AS best, list_distinct(flatten(list(b.t))) AS terms, list_distinct(flatten(list(b.raw))) AS raw FROM rows a JOIN rows b ON a.qid = b.qid AND a.document_id = b.document_id AND b.chunk_index BETWEEN a.chunk_index AND a.chunk_index + 2 GROUP BY ALL),
w AS (SELECT m.*, groups, intent, {S.priority_terms('question')} AS focus, len(list_filter(groups, lambda g: list_has_all(raw, string_split(g, ' ')))) AS held FROM m JOIN anchors USING (qid) JOIN (SELECT qid, question FROM query_plans) USING (qid))"""


def _windows(spark, d):
    """(qid, document_id, chunk_key, best, terms, raw, ...): each candidate with those up to two places after it in its document."""
    rows = C.candidates(spark, d).select("qid", "chunk_key", F.coalesce("score", F.lit(0.0)).alias("score")).join(C.chunks(spark, d, "document_id", "chunk_index", "text"), "chunk_key")
    rows = rows.select("qid", "document_id", "chunk_index", "chunk_key", "score", T.terms_smart(c("text")).alias("t"), F.array_distinct(T.tokens(c("text"), "[a-z0-9]+")).alias("r"))
    span = Window.partitionBy("qid", "document_id").orderBy("chunk_index").rangeBetween(0, 2)
    every = lambda name: F.array_distinct(F.flatten(F.collect_list(name).over(span)))
    rows = rows.select("qid", "document_id", "chunk_key", F.max("score").over(span).alias("best"), every("t").alias("terms"), every("r").alias("raw"))
    plans = C.plans(spark, d).select("qid", "intent", anchors(c("question")).alias("groups"), T.priority_terms(c("question")).alias("focus"))
    held = F.size(F.filter("groups", lambda g: F.forall(F.split(g, " "), lambda t: F.array_contains(c("raw"), t))))
    return rows.join(plans, "qid").withColumn("held", held)


_PROCEDURAL = "procedure procedures step steps sop isolate isolation reset check confirm".split()


@query("r14_scenario_documents", "R14", sql=f"""WITH {WINDOWS_SQL}, s AS (SELECT *, CASE WHEN len(groups) = 0 THEN 0 ELSE held / len(groups) END AS anchor, CASE WHEN len(focus) = 0 THEN 0 ELSE len(list_intersect(focus, terms)) / len(focus) END AS on_focus, least(1.0, len(list_intersect({S.listed(_PROCEDURAL)}, raw)) / 3) AS procedural,
 CASE WHEN len(groups) = 0 THEN 0 WHEN intent IN ('procedure', 'requirement', 'troubleshooting') AND len(groups) >= 3 THEN greatest(0.67, (len(groups) - 1) / len(groups)) ELSE 1 END AS required FROM w WHERE intent IN ('procedure', 'requirement', 'troubleshooting', 'summary')),
g AS (SELECT qid, document_id, round(least(0.99, max(anchor * 0.44 + on_focus * 0.28 + greatest(0.0, least(1.0, best)) * 0.18 + procedural * 0.10)) + 1e-10, 6) AS score FROM s WHERE anchor >= required AND (len(focus) = 0 OR on_focus >= 0.28) GROUP BY ALL)
SELECT qid, document_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id) AS n FROM g WHERE score >= 0.54) WHERE n <= 3""")
def r14_scenario_documents(spark, d):
    """The three documents of which some window of candidates states what a procedural question describes."""
    rows = _windows(spark, d).filter(c("intent").isin("procedure", "requirement", "troubleshooting", "summary"))
    anchor = F.when(F.size("groups") > 0, c("held") / F.size("groups")).otherwise(0.0)
    focus = T.coverage(c("focus"), c("terms"))
    procedural = F.least(F.lit(1.0), T.shared(T.literal_array(_PROCEDURAL), c("raw")) / 3)
    rows = rows.filter((anchor >= required_coverage(c("intent"), F.size("groups"))) & ((F.size("focus") == 0) | (focus >= 0.28)))
    score = anchor * 0.44 + focus * 0.28 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("best"))) * 0.18 + procedural * 0.10
    best = rows.groupBy("qid", "document_id").agg(F.round(F.least(F.lit(0.99), F.max(score)) + 1e-10, 6).alias("score")).filter("score >= 0.54")
    return R.top_in(best, ["qid"], [c("score").desc(), c("document_id")], 3)


@query("f20_hard_context", "F20", "R38", sql=f"WITH {WINDOWS_SQL} SELECT DISTINCT qid, document_id FROM w WHERE held = len(groups) AND len(groups) > 0")
def f20_hard_context(spark, d):
    """Documents with a window of candidates that holds every anchor of the question; other documents may not be quoted for it."""
    return _windows(spark, d).filter((F.size("groups") > 0) & (c("held") == F.size("groups"))).select("qid", "document_id").distinct()


UNITS_OF_MEASURE = r"(^|[^A-Za-z0-9])(km/?h|kmph|bar|v|kv|hours?|days?|per cent|percent|minutes?|mm|cm|m|kg)([^A-Za-z0-9]|$)"
_ASKS_SQL = f"(len(list_intersect({S.terms_smart('question')}, {S.listed(W.VALUE_DIMENSIONS)})) > 0 OR " + " OR ".join(f"contains(' ' || array_to_string({S.tokens('question', '[a-z0-9]+')}, ' ') || ' ', ' {w} {x} ')" for w, after in T.ASKS.items() for x in after) + ")"


@query("f22_answerable", "F22", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, rows AS (SELECT qid, k.document_id, k.chunk_index, k.chunk_key, k.text, coalesce(r.vector_score, 0) AS v, {S.terms_smart('k.text')} AS t FROM candidates r JOIN chunks k USING (chunk_key)),
m AS (SELECT a.qid, a.chunk_key, any_value(a.text) AS text, bool_or(regexp_matches(lower(b.text), '{UNITS_OF_MEASURE}')) AS unit, list_distinct(flatten(list(b.t))) AS terms, max(b.v) AS v FROM rows a JOIN rows b ON a.qid = b.qid AND a.document_id = b.document_id AND abs(a.chunk_index - b.chunk_index) <= 2 WHERE regexp_matches(a.text, '[0-9]') GROUP BY ALL),
g AS (SELECT qid, bool_or((unit OR regexp_matches(text, '\\b[0-9][0-9,]{{2,}}\\b')) AND len(list_intersect(terms, {S.listed(W.VALUE_DIMENSIONS)})) > 0 AND (len(p) = 0 OR len(list_intersect(p, terms)) > 0 OR v >= 0.32)) AS good FROM m JOIN (SELECT qid, {S.priority_terms('question')} AS p FROM query_plans) USING (qid) GROUP BY qid)
SELECT qid, CASE WHEN qid NOT IN (SELECT qid FROM candidates) THEN false WHEN NOT {_ASKS_SQL} THEN true ELSE coalesce(good, false) END AS answerable FROM query_plans LEFT JOIN g USING (qid)""")
def f22_answerable(spark, d):
    """A question for a value needs a candidate with a number whose neighbours have a unit, a dimension and a word of the question."""
    rows = C.candidates(spark, d).select("qid", "chunk_key", F.coalesce("vector_score", F.lit(0.0)).alias("v")).join(C.chunks(spark, d, "document_id", "chunk_index", "text"), "chunk_key")
    span = Window.partitionBy("qid", "document_id").orderBy("chunk_index").rangeBetween(-2, 2)
    unit = F.max(F.lower("text").rlike(UNITS_OF_MEASURE).cast("int")).over(span) == 1
    terms = F.array_distinct(F.flatten(F.collect_list("t").over(span)))
    rows = rows.withColumn("t", T.terms_smart(c("text"))).select("qid", "text", unit.alias("unit"), terms.alias("terms"), F.max("v").over(span).alias("v"))
    plans = C.plans(spark, d).select("qid", T.value_lookup(c("question")).alias("asks"), T.priority_terms(c("question")).alias("p"))
    dimension = T.shared(c("terms"), T.literal_array(W.VALUE_DIMENSIONS)) > 0
    subject = (F.size("p") == 0) | (T.shared(c("p"), c("terms")) > 0) | (c("v") >= 0.32)
    good = c("text").rlike("[0-9]") & (c("unit") | c("text").rlike(r"\b[0-9][0-9,]{2,}\b")) & dimension & subject
    found = rows.join(plans.select("qid", "p"), "qid").groupBy("qid").agg(F.max(good.cast("int")).alias("good"))
    return plans.join(found, "qid", "left").select("qid", F.when(c("good").isNull(), False).when(~c("asks"), True).otherwise(c("good") == 1).alias("answerable"))


@query("f23_superseded", "F23", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, x AS (SELECT chunk_key, document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_key) AS pos, regexp_matches(text, '(?i)shall be (substituted|replaced)') AS r FROM chunks),
y AS (SELECT chunk_key, CASE WHEN r THEN 'current' WHEN max(CASE WHEN r THEN pos END) OVER (PARTITION BY document_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) IS NOT NULL THEN 'superseded' ELSE 'unknown' END AS st FROM x),
z AS (SELECT qid, chunk_key, st, bool_or(st = 'current') OVER (PARTITION BY qid) AS has FROM candidates JOIN y USING (chunk_key)) SELECT qid, chunk_key FROM z WHERE NOT (has AND st = 'superseded')""")
def f23_superseded(spark, d):
    """Where a query has a candidate that replaces older text, candidates that stand before a replacement in their document go."""
    chunks = C.chunks(spark, d, "document_id", "chunk_index", "text").withColumn("r", c("text").rlike("(?i)shall be (substituted|replaced)"))
    later = Window.partitionBy("document_id").orderBy(c("chunk_index").desc(), c("chunk_key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    status = F.when(c("r"), "current").when(F.max(c("r").cast("int")).over(later) == 1, "superseded").otherwise("unknown")
    rows = C.candidates(spark, d).select("qid", "chunk_key").join(chunks.select("chunk_key", status.alias("status")), "chunk_key")
    has = F.max((c("status") == "current").cast("int")).over(Window.partitionBy("qid")) == 1
    return rows.withColumn("has", has).filter(~(c("has") & (c("status") == "superseded"))).select("qid", "chunk_key")


@query("r19_discovery_routes", "R19", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, h AS (SELECT qid, k.document_id, coalesce(vector_score, 0) AS v, lower(k.text) AS text FROM candidates JOIN chunks k USING (chunk_key)), dims AS (SELECT qid, unnest(concepts) AS dim FROM query_plans),
s AS (SELECT qid, document_id, max(v) AS signal FROM h GROUP BY ALL), n AS (SELECT qid, document_id, count(DISTINCT dim) AS n FROM h JOIN dims USING (qid) WHERE contains(text, lower(dim)) GROUP BY ALL),
r AS (SELECT qid, document_id, round(least(1.0, signal + 0.045 * least(5, coalesce(n, 0))), 9) AS route, coalesce(n, 0) AS dimensions FROM s LEFT JOIN n USING (qid, document_id)), b AS (SELECT *, max(route) OVER (PARTITION BY qid) AS best FROM r)
SELECT qid, document_id, round(route, 6) AS route, dimensions FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY route DESC, document_id) AS place FROM b WHERE route >= greatest(0.34, 0.18 * best)) WHERE place <= 24""")
def r19_discovery_routes(spark, d):
    """Documents by their best signal, with a bonus for each concept of the question that their candidates name."""
    plans = C.plans(spark, d).select("qid", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))
    rows = C.candidates(spark, d).select("qid", "chunk_key", F.coalesce("vector_score", F.lit(0.0)).alias("v")).join(C.chunks(spark, d, "document_id", "text"), "chunk_key").join(plans, "qid")
    named = F.filter("concepts", lambda x: F.contains(F.lower(c("text")), F.lower(x)))
    per = rows.select("qid", "document_id", "v", named.alias("named")).groupBy("qid", "document_id").agg(F.max("v").alias("signal"), F.size(F.array_distinct(F.flatten(F.collect_list("named")))).alias("dimensions"))  # few candidates of few concepts
    route = F.round(F.least(F.lit(1.0), c("signal") + 0.045 * F.least(F.lit(5), c("dimensions"))), 9)
    ranked = per.withColumn("route", route).withColumn("best", F.max("route").over(Window.partitionBy("qid"))).filter(c("route") >= F.greatest(F.lit(0.34), 0.18 * c("best")))
    return R.top_in(ranked, ["qid"], [c("route").desc(), c("document_id")], 24).select("qid", "document_id", F.round("route", 6).alias("route"), c("dimensions").cast("long").alias("dimensions"))


@query("r30_weak_fallback", "R30", sql=f"""WITH {S.CANDIDATES}, s AS (SELECT qid, chunk_key, coalesce(vector_score, 0) AS smart, coalesce(keyword_score, 0) AS legacy, max(coalesce(vector_score, 0)) OVER (PARTITION BY qid) AS top, max(coalesce(keyword_score, 0)) OVER (PARTITION BY qid) AS most FROM candidates)
SELECT qid, chunk_key, round(CASE WHEN top < 0.5 THEN greatest(smart, CASE WHEN most > 0 THEN legacy / most ELSE 0 END) ELSE smart END, 6) AS score, CASE WHEN smart > 0 THEN 'smart' ELSE 'legacy' END AS arm FROM s WHERE smart > 0 OR (top < 0.5 AND legacy > 0)""")
def r30_weak_fallback(spark, d):
    """Where the best smart score is weak, the other arm's rows come in, by their share of its best; a row of both keeps its smart name."""
    by = Window.partitionBy("qid")
    rows = C.candidates(spark, d).select("qid", "chunk_key", F.coalesce("vector_score", F.lit(0.0)).alias("smart"), F.coalesce("keyword_score", F.lit(0.0)).alias("legacy"))
    rows = rows.withColumn("top", F.max("smart").over(by)).withColumn("most", F.max("legacy").over(by))
    merged = F.greatest("smart", F.when(c("most") > 0, c("legacy") / c("most")).otherwise(0.0))
    kept = rows.filter((c("smart") > 0) | ((c("top") < 0.5) & (c("legacy") > 0)))
    return kept.select("qid", "chunk_key", F.round(F.when(c("top") < 0.5, merged).otherwise(c("smart")), 6).alias("score"), F.when(c("smart") > 0, "smart").otherwise("legacy").alias("arm"))


@query("t52_local_neighbours", "T52", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, x AS (SELECT chunk_key, document_id, chunk_index, section_path[1] AS major, list_distinct(list_transform(regexp_extract_all(text, '(?i)\\bline[- ]?0*([0-9]+)', 1), lambda n: 'LINE-' || n)) AS scope FROM chunks)
SELECT DISTINCT qid, b.chunk_key FROM candidates JOIN x a USING (chunk_key) JOIN x b ON a.document_id = b.document_id AND abs(a.chunk_index - b.chunk_index) BETWEEN 1 AND 2 AND a.major IS NOT DISTINCT FROM b.major AND (len(a.scope) = 0 OR len(b.scope) = 0 OR list_has_any(a.scope, b.scope))""")
def t52_local_neighbours(spark, d):
    """Neighbours within two places that share the major section and do not speak of other lines."""
    x = C.chunks(spark, d, "document_id", "chunk_index", "section_path", "text")
    x = x.select("chunk_key", "document_id", "chunk_index", F.get("section_path", F.lit(0)).alias("major"), F.filter(I.scope_labels(c("text")), lambda s: F.startswith(s, F.lit("LINE"))).alias("scope"))
    seeds = C.candidates(spark, d).select("qid", "chunk_key").join(x, "chunk_key").select("qid", "document_id", c("major").alias("m"), c("scope").alias("s"), F.explode(F.transform(F.array(*[F.lit(n) for n in (-2, -1, 1, 2)]), lambda n: c("chunk_index") + n)).alias("chunk_index"))
    near = seeds.join(x, ["document_id", "chunk_index"])
    fits = c("m").eqNullSafe(c("major")) & ((F.size("s") == 0) | (F.size("scope") == 0) | F.arrays_overlap("s", "scope"))
    return near.filter(fits).select("qid", "chunk_key").distinct()


# Chunk contexts
@query("c3_tiny_sections", "C3", sql=f"""WITH {S.CHUNKS}, x AS (SELECT chunk_key, document_id, chunk_index, page_number, coalesce(page_end, page_number) AS page_end, content_type, length(text) AS n, array_to_string(section_path[:len(section_path) - 1], ' > ') AS parent FROM chunks),
y AS (SELECT *, CASE WHEN n < 180 AND content_type = 'text' AND lag(content_type) OVER o = 'text' AND page_number <= lag(page_end) OVER o + 1 AND parent = lag(parent) OVER o THEN 0 ELSE 1 END AS fresh FROM x WINDOW o AS (PARTITION BY document_id ORDER BY chunk_index, chunk_key)),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_key) AS section FROM y) SELECT document_id, CAST(section AS BIGINT) AS section, count(*) AS parts, min(chunk_key) AS first_key, max(page_end) AS page_end FROM z GROUP BY ALL""")
def c3_tiny_sections(spark, d):
    """A short text goes with the one before it, if that is on the same or the last page and under the same parent."""
    rows = C.chunks(spark, d, "document_id", "chunk_index", "page_number", "page_end", "content_type", "text", "section_path").withColumn("page_end", F.coalesce("page_end", "page_number"))
    rows = rows.withColumn("parent", F.array_join(F.slice("section_path", 1, F.greatest(F.size("section_path") - 1, F.lit(0))), " > "))
    by = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_key")
    joins = (F.char_length("text") < 180) & (c("content_type") == "text") & (F.lag("content_type").over(by) == "text") & (c("page_number") <= F.lag("page_end").over(by) + 1) & (c("parent") == F.lag("parent").over(by))
    rows = rows.withColumn("fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("section", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("document_id", "section").agg(F.count("*").alias("parts"), F.min("chunk_key").alias("first_key"), F.max("page_end").alias("page_end"))


_CODED = r"(?i)\b(?:RS|TS|EMU|BHEL|BEML|ROTEM|ALSTOM|BOMBARDIER)[ -]?[A-Z0-9/-]{1,20}\b"
_STOCKED, _DONE = ("|".join(x) for x in (W.STOCK_WORDS, W.PROCEDURE_WORDS))


@query("c13_inferred_context", "C13", sql=f"""WITH {S.CHUNKS}, x AS (SELECT chunk_key, list_filter(list_reverse(section_path), lambda p: regexp_matches(lower(p), '{_STOCKED}') OR regexp_matches(p, '{_CODED}')) AS s, list_filter(list_reverse(section_path), lambda p: regexp_matches(lower(p), '{_DONE}')) AS p FROM chunks)
SELECT chunk_key, CASE WHEN regexp_matches(lower(s[1]), '{_STOCKED}') THEN s[1] ELSE nullif(regexp_extract(s[1], '{_CODED}'), '') END AS stock, p[1] AS procedure FROM x""")
def c13_inferred_context(spark, d):
    """The deepest heading that speaks of rolling stock, or a code of one in it; and the deepest that speaks of a procedure."""
    up = F.reverse("section_path")
    stock = F.get(F.filter(up, lambda p: F.lower(p).rlike(_STOCKED) | p.rlike(_CODED)), F.lit(0))
    named = F.when(F.lower(stock).rlike(_STOCKED), stock).otherwise(F.nullif(F.regexp_extract(stock, _CODED, 0), F.lit("")))
    return C.chunks(spark, d, "section_path").select("chunk_key", named.alias("stock"), F.get(F.filter(up, lambda p: F.lower(p).rlike(_DONE)), F.lit(0)).alias("procedure"))


ENVELOPE = r"(?s)\[PDF CHUNK CONTEXT\](.*?)\[/PDF CHUNK CONTEXT\]"


@query("c14_envelope", "C14", "C15", sql=f"""WITH {S.CHUNKS} SELECT chunk_key, trim(regexp_replace(filename, '\\s+', ' ', 'g')) AS file, CAST(page_number AS VARCHAR) AS pages, nullif(trim(array_to_string(section_path, ' > ')), '') AS section, trim(text, chr(10) || chr(9) || chr(13) || ' ') AS excerpt FROM chunks""")
def c14_envelope(spark, d):
    """Chunks are given their context as text, and it is read back and taken off again: a round trip."""
    rows = C.chunks(spark, d, "filename", "page_number", "section_path", "text")
    head = F.concat_ws("\n", F.lit("[PDF CHUNK CONTEXT]"), F.concat(F.lit("File: "), "filename"), F.concat(F.lit("Pages: "), "page_number"), F.concat(F.lit("Section path: "), F.array_join("section_path", " > ")), F.lit("[/PDF CHUNK CONTEXT]"))
    told = rows.select("chunk_key", F.concat(head, F.lit("\n\n"), "text").alias("told"))
    inside = F.regexp_extract("told", ENVELOPE, 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(inside, rf"(?m)^{name}: *(.*)$", 1)), F.lit(""))
    excerpt = F.regexp_replace(F.regexp_replace("told", ENVELOPE, ""), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return told.select("chunk_key", field("File").alias("file"), field("Pages").alias("pages"), field("Section path").alias("section"), excerpt.alias("excerpt"))


@query("t42_json_recovery", "T42", sql=f"""WITH {S.AUDIT} SELECT id, json_extract_string(event_metadata, '$.mode') AS mode FROM audit WHERE event_metadata IS NOT NULL""")
def t42_json_recovery(spark, d):
    """An object told in prose, in a fence or bare is found again; here each id gets one of the three dresses."""
    rows = C.audit(spark, d).filter("event_metadata IS NOT NULL")
    dress = F.pmod(F.xxhash64("id"), F.lit(3))
    said = F.when(dress == 0, c("event_metadata")).when(dress == 1, F.concat(F.lit("Here it is:\n```json\n"), "event_metadata", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("The result "), "event_metadata", F.lit(" was found.")))
    return rows.select("id", said.alias("said")).select("id", F.get_json_object(json_object(c("said")), "$.mode").alias("mode"))


def json_object(raw: Column) -> Column:
    """The object in a text: the whole of it, what a fence holds, or from the first brace to the last; null where that is none."""
    is_object = lambda x: F.when(F.json_object_keys(x).isNotNull(), x)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    spanned = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(is_object(F.trim(raw)), is_object(fenced), is_object(spanned))


@query("l24_novel_content", "L24", sql=f"""WITH {S.PAGES}, {S.CHUNKS}, p AS (SELECT filename, page_number, list_distinct(flatten(list(list_distinct({S.terms_smart("coalesce(text, '')")})))) AS t FROM pages GROUP BY ALL), k AS (SELECT chunk_key, {S.terms_smart('text')} AS o, t FROM chunks JOIN p USING (filename, page_number))
SELECT chunk_key, CAST(len(list_filter(o, lambda x: NOT list_contains(t, x))) AS BIGINT) AS novel, len(o) >= 12 AND len(list_filter(o, lambda x: NOT list_contains(t, x))) >= 12 AND len(list_filter(o, lambda x: NOT list_contains(t, x))) / len(o) >= 0.2 AS recovers FROM k""")
def l24_novel_content(spark, d):
    """What a chunk's text has that the text of its page has not: many new terms mean that the page's layer was incomplete."""
    pages = C.pages(spark, d).select("filename", "page_number", T.terms_smart(F.coalesce("text", F.lit(""))).alias("t")).groupBy("filename", "page_number").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))  # a page's rows
    rows = C.chunks(spark, d, "filename", "page_number", "text").join(pages, ["filename", "page_number"]).select("chunk_key", T.terms_smart(c("text")).alias("o"), "t")
    novel = F.size(F.array_except("o", "t"))
    return rows.select("chunk_key", novel.cast("long").alias("novel"), ((F.size("o") >= 12) & (novel >= 12) & (novel / F.size("o") >= 0.2)).alias("recovers"))


# Affinity of names
@query("t16_text_affinity", "T16")
def t16_text_affinity(spark, d):
    """Headings of candidates against their question: 0.48 coverage, 0.18 Jaccard, 0.24 likeness of the sequences, 0.10 for containment."""
    rows = C.candidates(spark, d).select("qid", "chunk_key").join(C.plans(spark, d).select("qid", "question"), "qid").join(C.chunks(spark, d, "heading").filter("heading IS NOT NULL"), "chunk_key")
    rows = rows.select("qid", "chunk_key", T.canonical_phrase(c("question")).alias("q"), T.canonical_phrase(c("heading")).alias("h"), T.terms_smart(c("question")).alias("qt"), T.terms_smart(c("heading")).alias("ht"))
    rows = rows.select("qid", "chunk_key", "q", "h", T.coverage(c("ht"), c("qt")).alias("cov"), T.jaccard(c("ht"), c("qt")).alias("jac"), F.when((c("h") != "") & F.contains(c("q"), c("h")), 1.0).otherwise(0.0).alias("within"))

    def likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher, out = difflib.SequenceMatcher(autojunk=False), []
            for q, h in zip(batch.column("q").to_pylist(), batch.column("h").to_pylist()):
                matcher.set_seqs(h, q)
                out.append(matcher.ratio())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("qid", "chunk_key", "cov", "jac", "within")), pa.array(out, pa.float64())], ["qid", "chunk_key", "cov", "jac", "within", "seq"])

    scored = rows.mapInArrow(likeness, "qid string, chunk_key long, cov double, jac double, within double, seq double")
    return scored.select("qid", "chunk_key", F.round(c("cov") * 0.48 + c("jac") * 0.18 + c("seq") * 0.24 + c("within") * 0.10, 6).alias("affinity"))


# Maintenance
@query("s14_cascade_delete", "S14", sql=f"""WITH {S.FILES}, {S.CHUNKS}, gone AS (SELECT document_id FROM files WHERE status = 'failed') SELECT content_type, count(*) AS kept FROM chunks WHERE document_id NOT IN (SELECT document_id FROM gone) GROUP BY content_type""")
def s14_cascade_delete(spark, d):
    """Chunks of failed documents go with them; what is left, by type."""
    gone = C.files(spark, d).filter("status = 'failed'").select("document_id")
    return C.chunks(spark, d, "document_id", "content_type").join(gone, "document_id", "left_anti").groupBy("content_type").agg(F.count("*").alias("kept"))


@query("s18_backfill", "S18", "S19", "S20", "S24", sql=f"""WITH {S.CHUNKS} SELECT document_id, CASE WHEN document_id < '8' THEN 'r1' ELSE 'r2' END AS run_id, count(*) AS chunks FROM chunks GROUP BY document_id""")
def s18_backfill(spark, d):
    """A first run does some of the documents; a second asks what is still pending and does only that, in parallel."""
    counts = C.chunks(spark, d, "document_id").groupBy("document_id").agg(F.count("*").alias("chunks"))
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    G.publish(counts.filter("document_id < '8'"), root, "chunk_counts", "r1")
    todo = G.pending(counts, root, "chunk_counts", "r1")
    G.publish(todo, root, "chunk_counts", "r2")
    return G.active(spark, root, "chunk_counts").select("document_id", "run_id", "chunks")


@query("s12_legacy_mirror", "S12", sql=f"""WITH {S.CHUNKS} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_index, chunk_key) - 1 AS BIGINT) AS chunk_index, chunk_key, CASE content_type WHEN 'table_row' THEN 'table' WHEN 'list' THEN 'text' ELSE content_type END AS content_type, length(text) AS n_chars FROM chunks""")
def s12_legacy_mirror(spark, d):
    """The older shape of the chunk table: numbered anew in reading order, with the older types; written and read back."""
    by = Window.partitionBy("document_id").orderBy("page_number", "chunk_index", "chunk_key")
    rows = C.chunks(spark, d, "document_id", "page_number", "chunk_index", "content_type", "text")
    kind = F.when(c("content_type") == "table_row", "table").when(c("content_type") == "list", "text").otherwise(c("content_type"))
    mirror = rows.select("document_id", (F.row_number().over(by) - 1).cast("long").alias("chunk_index"), "chunk_key", kind.alias("content_type"), F.char_length("text").cast("long").alias("n_chars"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/mirror"
    mirror.write.parquet(path)
    return spark.read.parquet(path)


# Lines
@query("l29_line_groups", "L29", sql=f"""WITH {S.PAGES}, lines AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pages WHERE text IS NOT NULL), w AS (SELECT page_id, n, list_filter(string_split(line, ' '), lambda x: x != '') AS w, line FROM lines)
SELECT page_id, n, array_to_string(w, ' ') AS line, CAST(20 * (length(line) - length(ltrim(line, ' '))) AS DOUBLE) AS x0, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{{2,}}'))) > 0 AS bold FROM w WHERE len(w) > 0""")
def l29_line_groups(spark, d):
    """Words of a block's line together: their text in order, the box around them, and whether any is set strongly."""
    from tarnwick.queries.q_tables import _words

    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "word"))), lambda w: w["word"])  # the words of a line
    return _words(spark, d).groupBy("page_id", "n").agg(F.array_join(words, " ").alias("line"), F.min("x0").alias("x0"), (F.max(c("word").rlike("^[A-Z]{2,}$").cast("int")) == 1).alias("bold"))


@query("l30_line_types", "L30", sql=f"""WITH {S.PAGES}, lines AS (SELECT page_id, content_type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pages WHERE text IS NOT NULL)
SELECT page_id, n, CASE WHEN regexp_matches(line, '^ *([0-9]+[.])*[0-9]+[.]? +[A-Z][^.!?]*$') THEN 'heading' WHEN regexp_matches(line, '^ *([-*•]|[(]?[a-z0-9]{{1,3}}[.)]) +') THEN 'list_item' ELSE 'paragraph' END AS kind FROM lines WHERE trim(line) <> '' AND NOT (content_type = 'table' AND contains(line, '|'))""")
def l30_line_types(spark, d):
    """Lines outside tables: heading, list item or paragraph."""
    from tarnwick.queries.q_tables import _lines

    rows = _lines(spark, d).filter((F.trim("line") != "") & ~((c("content_type") == "table") & F.contains("line", F.lit("|"))))
    kind = F.when(c("line").rlike("^ *([0-9]+[.])*[0-9]+[.]? +[A-Z][^.!?]*$"), "heading").when(c("line").rlike("^ *([-*•]|[(]?[a-z0-9]{1,3}[.)]) +"), "list_item").otherwise("paragraph")
    return rows.select("page_id", "n", kind.alias("kind"))


@query("r22_enumeration_expansion", "R22", "R23", "J11", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, ranked AS (SELECT qid, chunk_key, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS n FROM candidates), seeds AS (SELECT r.qid, r.score, k.document_id, k.heading, k.page_number FROM ranked r JOIN chunks k USING (chunk_key) WHERE n <= 8),
near AS (SELECT qid, k.chunk_key, max(s.score * CASE WHEN k.content_type = 'table_row' AND abs(k.page_number - s.page_number) <= 1 THEN 0.92 WHEN k.heading = s.heading THEN 0.86 ELSE 0.74 END) AS score FROM seeds s JOIN chunks k ON k.document_id = s.document_id AND (k.heading = s.heading OR (abs(k.page_number - s.page_number) <= 1 AND k.content_type IN ('table_row', 'list'))) GROUP BY ALL)
SELECT qid, chunk_key, round(max(score) + 1e-10, 6) AS score FROM (SELECT qid, chunk_key, score FROM ranked UNION ALL SELECT * FROM near) GROUP BY ALL""")
def r22_enumeration_expansion(spark, d):
    """The eight best of each query bring what belongs to their list or procedure: rows of tables near them, their section, lists on pages beside them."""
    chunks = C.chunks(spark, d, "document_id", "heading", "page_number", "content_type")
    own = C.candidates(spark, d)
    best = R.top_in(own, ["qid"], R.canonical_order(), 8).select("qid", "chunk_key", F.coalesce("score", F.lit(0.0)).alias("score"))
    seeds = best.join(chunks, "chunk_key").select("qid", "score", "document_id", c("heading").alias("h"), c("page_number").alias("p"))
    # The OR as two joins; what both find keeps the better weight.
    rowed = (c("content_type") == "table_row") & (F.abs(c("page_number") - c("p")) <= 1)
    weight = c("score") * F.when(rowed, 0.92).when(c("heading") == c("h"), 0.86).otherwise(0.74)
    section = seeds.filter("h IS NOT NULL").join(chunks.withColumn("h2", c("heading")), [seeds["document_id"] == chunks["document_id"], c("h") == c("h2")]).select("qid", "chunk_key", weight.alias("score"))
    beside = seeds.withColumn("page_number", F.explode(F.sequence(c("p") - 1, c("p") + 1))).join(chunks.filter(c("content_type").isin("table_row", "list")), ["document_id", "page_number"]).select("qid", "chunk_key", weight.alias("score"))
    every = own.select("qid", "chunk_key", F.coalesce("score", F.lit(0.0)).alias("score")).unionByName(section).unionByName(beside)
    return every.groupBy("qid", "chunk_key").agg(F.round(F.max("score") + 1e-10, 6).alias("score"))

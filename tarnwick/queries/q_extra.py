"""Lines and columns of words, table tests, splitters, excerpts and ordered tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tarnwick.functions import patterns as P
from tarnwick.functions import text as T
from tarnwick.functions import words as W
from tarnwick.operators import layout as L
from tarnwick.operators import packing as K
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col


@query("t19_abbreviations", "T19", sql=f"""WITH w AS (SELECT qid, unnest(regexp_extract_all(question, '\\b[A-Za-z][A-Za-z0-9&/-]*\\b')) AS w FROM query_plans)
SELECT qid, array_to_string(list_sort(list_distinct(list(lower(w)))), ' ') AS abbreviations FROM w WHERE ((upper(w) = w AND regexp_matches(w, '[A-Z]')) OR regexp_full_match(w, '[A-Za-z]{{2,4}}'))
 AND lower(w) NOT IN ({", ".join(f"'{x}'" for x in "the and for with from this that what when where which how are is in on of to an or by as be do does can who why has had was were may not near must at it".split())}) GROUP BY qid""")
def t19_abbreviations(spark, d):
    found = C.plans(spark, d).select("qid", F.array_join(P.abbreviations(c("question")), " ").alias("abbreviations"))
    return found.filter("abbreviations != ''")


@query("t44_document_units", "T44", sql=f"""WITH {S.CHUNKS}, u AS (SELECT chunk_key, unnest(string_split(text, chr(10))) AS u FROM chunks WHERE content_type = 'list') SELECT chunk_key, count(*) AS units FROM u WHERE trim(u) != '' GROUP BY chunk_key""")
def t44_document_units(spark, d):
    rows = C.chunks(spark, d, "content_type", "text").filter("content_type = 'list'")
    return rows.select("chunk_key", F.size(F.filter(F.split("text", "\n"), lambda u: F.trim(u) != "")).cast("long").alias("units")).filter("units > 0")


@query("t61_answer_format", "T61", sql=f"""WITH {S.AUDIT} SELECT id, len(regexp_extract_all(response, '(?m)^\\s*(?:[-*]|[0-9]+[.)])\\s')) AS bullets, len(regexp_extract_all(response, '(?m)^\\s*(?:[-*]|[0-9]+[.)])\\s')) = 0 OR length(response) > 5000 AS needs_repair FROM audit WHERE response IS NOT NULL""")
def t61_answer_format(spark, d):
    bullets = F.regexp_count("response", F.lit(r"(?m)^\s*(?:[-*]|[0-9]+[.)])\s")).cast("long")
    rows = C.audit(spark, d).filter("response IS NOT NULL")
    return rows.select("id", bullets.alias("bullets"), ((bullets == 0) | (F.char_length("response") > 5000)).alias("needs_repair"))


@query("t30b_token_similarity", "T30b", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, t AS (SELECT qid, chunk_key, {S.terms_smart('question')} AS q, {S.terms_smart('chunks.text')} AS b FROM candidates JOIN query_plans USING (qid) JOIN chunks USING (chunk_key))
SELECT qid, chunk_key, round(CASE WHEN least(len(q), len(b)) = 0 THEN 0 ELSE len(list_intersect(q, b)) / least(len(q), len(b)) END, 6) AS overlap FROM t""")
def t30b_token_similarity(spark, d):
    rows = C.candidates(spark, d).select("qid", "chunk_key").join(C.plans(spark, d).select("qid", "question"), "qid").join(C.chunks(spark, d, "text"), "chunk_key")
    q, b = T.terms_smart(c("question")), T.terms_smart(c("text"))
    smaller = F.least(F.size(q), F.size(b))
    return rows.select("qid", "chunk_key", F.round(F.when(smaller > 0, T.shared(q, b) / smaller).otherwise(0.0), 6).alias("overlap"))


@query("j19_filename_coverage", "J19", "T15", sql=f"""WITH {S.FILES}, f AS (SELECT document_id, {S.terms_smart("regexp_replace(filename, '\\.[Pp][Dd][Ff]$', '')")} AS n FROM files), q AS (SELECT qid, {S.terms_smart('question')} AS t FROM query_plans)
SELECT qid, document_id, len(list_intersect(t, n)) AS shared, round(len(list_intersect(t, n)) / len(n), 6) AS coverage FROM q JOIN f ON len(list_intersect(t, n)) >= 2""")
def j19_filename_coverage(spark, d):
    names = C.files(spark, d).select("document_id", T.terms_smart(F.regexp_replace("filename", r"(?i)\.pdf$", "")).alias("n"))
    words = names.select("document_id", F.size("n").alias("of"), F.explode("n").alias("term"))
    asked = C.plans(spark, d).select("qid", F.explode(T.terms_smart(c("question"))).alias("term"))
    met = asked.join(words, "term").groupBy("qid", "document_id", "of").agg(F.count("*").alias("shared")).filter("shared >= 2")
    return met.select("qid", "document_id", "shared", F.round(c("shared") / c("of"), 6).alias("coverage"))


_DIGIT = "CASE p " + " ".join(f"WHEN '{w}' THEN '{i}'" for i, w in enumerate(W.NUMBER_WORDS)) + " END"
_NAME = "CASE p " + " ".join(f"WHEN '{i}' THEN '{w}'" for i, w in enumerate(W.NUMBER_WORDS)) + " END"


@query("t2_search_terms", "T2", sql=f"""WITH t AS (SELECT qid, unnest({S.tokens('question', '[a-z0-9][a-z0-9_./:#-]*')}) AS t FROM query_plans), p AS (SELECT qid, t AS p FROM t UNION SELECT qid, unnest(regexp_split_to_array(t, '[._/:#-]+')) FROM t),
v AS (SELECT qid, p AS v FROM p UNION SELECT qid, CASE WHEN regexp_full_match(p, '[0-9]+') OR {_DIGIT} IS NOT NULL THEN coalesce({_DIGIT}, p) ELSE {S.stem('p', W.SINGULAR)} END FROM p WHERE p <> '' UNION SELECT qid, coalesce({_NAME}, p) FROM p)
SELECT qid, array_to_string(list_sort(list(v)), ' ') AS terms FROM (SELECT DISTINCT qid, v FROM v WHERE length(v) > 1) GROUP BY qid""")
def t2_search_terms(spark, d):
    return C.plans(spark, d).select("qid", F.array_join(F.array_sort(T.search_terms(c("question"))), " ").alias("terms"))


@query("c6_table_pieces", "C6")
def c6_table_pieces(spark, d):
    rows = C.chunks(spark, d, "content_type", "text").filter("content_type = 'table'").select("chunk_key", "text")
    schema = Ty.StructType([rows.schema["chunk_key"], Ty.StructField("piece", Ty.IntegerType()), Ty.StructField("body", Ty.StringType())])
    return K.per_row(rows, schema, lambda x: [{"chunk_key": x["chunk_key"], "piece": i, "body": p} for i, p in enumerate(K.table_pieces(x["text"] or "", 900))])


@query("c9_long_units", "C9", "T54")
def c9_long_units(spark, d):
    rows = C.chunks(spark, d, "content_type", "text").filter("content_type = 'text'").select("chunk_key", "text")
    schema = Ty.StructType([rows.schema["chunk_key"], Ty.StructField("piece", Ty.IntegerType()), Ty.StructField("body", Ty.StringType())])
    return K.per_row(rows, schema, lambda x: [{"chunk_key": x["chunk_key"], "piece": i, "body": p} for i, p in enumerate(K.long_unit(x["text"] or "", 1000, 120))])


@query("c6_kept", "C6", sql=f"""WITH {S.CHUNKS} SELECT chunk_key, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, TRUE AS kept, TRUE AS headed FROM chunks WHERE content_type = 'table'""")
def c6_kept(spark, d):
    """What must hold of the pieces of a table: every line is in some, and each begins with the header lines."""
    rows = C.chunks(spark, d, "content_type", "text").filter("content_type = 'table'")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    pieces = c6_table_pieces(spark, d).groupBy("chunk_key").agg(F.collect_list("body").alias("pieces"))  # the pieces of a row
    head = F.array_join(F.slice(c("parts"), 1, 2), "\n")
    kept = F.forall("parts", lambda x: F.contains(F.array_join("pieces", "\n"), x))
    return rows.select("chunk_key", lines.alias("parts")).join(pieces, "chunk_key").select("chunk_key", F.size("parts").cast("long").alias("lines"), kept.alias("kept"), F.forall("pieces", lambda p: F.startswith(p, head)).alias("headed"))


@query("c9_kept", "C9", "T54", sql=f"""WITH {S.CHUNKS} SELECT chunk_key, len(list_filter(string_split(regexp_replace(trim(text, chr(10) || chr(9) || ' '), '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS sentences, TRUE AS kept, TRUE AS fits FROM chunks WHERE content_type = 'text' AND trim(text) <> ''""")
def c9_kept(spark, d):
    """What must hold of long units: every sentence that fits is whole in some piece, and no piece is too long."""
    rows = C.chunks(spark, d, "content_type", "text").filter("content_type = 'text' AND trim(text) <> ''")
    sentences = F.filter(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"(?<=[.!?;])\s+"), lambda x: x != "")
    pieces = c9_long_units(spark, d).groupBy("chunk_key").agg(F.collect_list("body").alias("pieces"))  # the pieces of a row
    kept = F.forall("sentences", lambda x: (F.char_length(x) > 1000) | F.exists("pieces", lambda p: F.contains(p, x)))
    return rows.select("chunk_key", sentences.alias("sentences")).join(pieces, "chunk_key").select("chunk_key", F.size("sentences").cast("long").alias("sentences"), kept.alias("kept"), F.forall("pieces", lambda p: F.char_length(p) <= 1000).alias("fits"))

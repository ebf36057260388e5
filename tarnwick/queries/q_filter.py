"""Predicates: typed filters, substring, boolean and phrase search, regular expressions, value shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import search as X
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col


@query("f2_typed_filters", "F2", "F3", "W24", sql=f"""WITH {S.CHUNKS} SELECT chunk_key, page_number FROM chunks
WHERE content_type = 'text' AND (text ILIKE '%register%' OR heading ILIKE '%register%' OR array_to_string(section_path, ' ') ILIKE '%register%') AND page_number <= 5 AND coalesce(page_end, page_number) >= 2""")
def f2_typed_filters(spark, d):
    rows = C.chunks(spark, d, "content_type", "text", "heading", "section_path", "page_number", "page_end").filter("content_type = 'text'")
    like = lambda x: F.coalesce(x.ilike("%register%"), F.lit(False))
    hit = like(c("text")) | like(c("heading")) | like(F.array_join("section_path", " "))
    return rows.filter(hit & (c("page_number") <= 5) & (F.coalesce("page_end", "page_number") >= 2)).select("chunk_key", "page_number")


@query("f4_exact_and", "F4", "F8", sql=f"""WITH {S.CHUNKS}, q AS (SELECT qid, list_slice(list_filter({S.terms_v5('question')}, lambda t: length(t) >= 3), 1, 6) AS t FROM query_plans)
SELECT qid, chunk_key FROM q JOIN chunks ON len(t) > 0 AND len(list_filter(t, lambda x: contains(lower(text), x))) = len(t)""")
def f4_exact_and(spark, d):
    """Chunks with the first six terms of a question, table rows first, then by place."""
    asked = C.plans(spark, d).select("qid", F.slice(F.filter(T.terms_v5(c("question")), lambda t: F.length(t) >= 3), 1, 6).alias("terms"))
    found = X.all_substrings(asked, C.chunks(spark, d, "text"), "chunk_key", "text")
    places = C.chunks(spark, d, "content_type", "filename", "page_number", "chunk_index")
    order = [F.when(c("content_type") == "table_row", 0).otherwise(1), F.lower("filename"), c("page_number"), c("chunk_index"), c("chunk_key")]
    return found.join(places, "chunk_key").orderBy("qid", *order).select("qid", "chunk_key")


@query("f5_prefix_or", "F5", sql=f"""WITH {S.CHUNKS}, q AS (SELECT qid, unnest({S.terms_v5('question')}) AS t FROM query_plans), w AS (SELECT chunk_key, unnest(list_distinct({S.tokens('text', '[a-z0-9]+')})) AS w FROM chunks)
SELECT qid, chunk_key, count(DISTINCT t) AS matched FROM q JOIN w ON (length(t) > 3 AND starts_with(w, t)) OR w = t GROUP BY ALL HAVING count(DISTINCT t) >= 3""")
def f5_prefix_or(spark, d):
    asked = C.plans(spark, d).select("qid", F.explode(T.terms_v5(c("question"))).alias("term"))
    return X.prefix_matches(asked, C.chunks(spark, d, "text"), "chunk_key", "text", 3)


@query("f6_boolean_and", "F6", sql=f"""WITH {S.CHUNKS}, q AS (SELECT qid, list_slice(list_sort({S.priority_terms('question')}), 1, 5) AS t FROM query_plans), w AS (SELECT chunk_key, {S.terms_smart('text')} AS w FROM chunks)
SELECT qid, chunk_key FROM q JOIN w ON len(t) > 0 AND list_has_all(w, t)""")
def f6_boolean_and(spark, d):
    asked = C.plans(spark, d).select("qid", F.slice(F.array_sort(T.priority_terms(c("question"))), 1, 5).alias("terms"))
    return X.all_terms(asked, C.chunks(spark, d, "text"), "chunk_key", T.terms_smart(c("text")))


@query("f7_web_search", "F7", sql=f"""WITH {S.CHUNKS} SELECT chunk_key FROM chunks WHERE (' ' || array_to_string({S.tokens('text', '[a-z0-9]+')}, ' ') || ' ') LIKE '% shall inform %'
AND list_contains({S.tokens('text', '[a-z0-9]+')}, 'register') AND NOT list_contains({S.tokens('text', '[a-z0-9]+')}, 'manager')""")
def f7_web_search(spark, d):
    return C.chunks(spark, d, "text").filter(X.web_search('"shall inform" register -manager', c("text"))).select("chunk_key")


@query("f9_token_boundary", "F9", "T59", sql=f"WITH {S.CHUNKS} SELECT chunk_key, substr(text, greatest(1, strpos(lower(text), 'door') - 20), 60) AS excerpt FROM chunks WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])door([^A-Za-z0-9]|$)')")
def f9_token_boundary(spark, d):
    rows = C.chunks(spark, d, "text").filter(c("text").rlike("(?i)(^|[^A-Za-z0-9])door([^A-Za-z0-9]|$)"))
    at = F.locate("door", F.lower("text"))
    return rows.select("chunk_key", F.substring(c("text"), F.greatest(F.lit(1), at - 20), F.lit(60)).alias("excerpt"))


@query("f11_numeric_rows", "F11", "F12", "F13", sql=f"""WITH {S.CHUNKS} SELECT chunk_key, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(km/?h|kmph|bar|v|kv|hours?|days?|percent|min(?:ute)?s?|mm|cm|m|kg)([^A-Za-z0-9]|$)') AS has_unit, regexp_matches(text, '(^|[^A-Za-z0-9])[0-9][0-9,]{{2,}}([^A-Za-z0-9]|$)') AS has_large
FROM chunks WHERE content_type = 'table' OR regexp_matches(text, '[0-9][0-9,]*([.][0-9]+)?')""")
def f11_numeric_rows(spark, d):
    rows = C.chunks(spark, d, "text", "content_type").filter((c("content_type") == "table") | c("text").rlike("[0-9][0-9,]*([.][0-9]+)?"))
    return rows.select("chunk_key", c("text").rlike(r"(?i)(^|[^A-Za-z0-9])(km/?h|kmph|bar|v|kv|hours?|days?|percent|min(?:ute)?s?|mm|cm|m|kg)([^A-Za-z0-9]|$)").alias("has_unit"), c("text").rlike(r"(^|[^A-Za-z0-9])[0-9][0-9,]{2,}([^A-Za-z0-9]|$)").alias("has_large"))


@query("f14_array_overlap", "F14", sql=f"""WITH {S.CHUNKS}, pool AS (SELECT DISTINCT unnest(context_tags) AS tag FROM chunks), picked AS (SELECT tag FROM pool WHERE tag LIKE '%7%')
SELECT DISTINCT chunk_key FROM (SELECT chunk_key, unnest(context_tags) AS tag FROM chunks) JOIN picked USING (tag)""")
def f14_array_overlap(spark, d):
    tags = C.chunks(spark, d, "context_tags").select("chunk_key", F.explode("context_tags").alias("tag"))
    return tags.filter(c("tag").like("%7%")).select("chunk_key").distinct()


@query("f17_reverse_containment", "F17", "A18", sql=f"""WITH {S.CHUNKS}, terms AS (SELECT DISTINCT lower(regexp_replace(unnest(section_path), '^[0-9.]+ ', '')) AS canonical FROM chunks), t AS (SELECT canonical FROM terms WHERE length(canonical) >= 5)
SELECT qid, canonical FROM query_plans JOIN t ON contains(' ' || array_to_string({S.tokens('question', '[a-z0-9]+')}, ' ') || ' ', ' ' || array_to_string({S.tokens('canonical', '[a-z0-9]+')}, ' ') || ' ')""")
def f17_reverse_containment(spark, d):
    heads = C.chunks(spark, d, "section_path").select(F.explode("section_path").alias("h"))
    terms = heads.select(F.lower(F.regexp_replace("h", "^[0-9.]+ ", "")).alias("canonical")).filter("length(canonical) >= 5").distinct()
    return X.contained_phrases(C.plans(spark, d).select("qid", "question"), "qid", "question", terms, "canonical")


@query("f18_audit_filters", "F18", sql=f"""WITH {S.AUDIT} SELECT id, event_type, left(question, 40) AS question FROM (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM audit WHERE success AND actor_email ILIKE '%example%') WHERE n > 10 AND n <= 60""")
def f18_audit_filters(spark, d):
    rows = C.audit(spark, d).filter(c("success") & c("actor_email").ilike("%example%"))
    page = rows.orderBy(c("created_at").desc_nulls_last(), "id").offset(10).limit(50)  # a page of a listing
    return page.select("id", "event_type", F.substring("question", 1, 40).alias("question"))


@query("f19_low_information", "F19", sql=f"WITH {S.CHUNKS} SELECT chunk_key, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS alnum, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 120 AS low FROM chunks")
def f19_low_information(spark, d):
    alnum = F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")).cast("long")
    return C.chunks(spark, d, "text").select("chunk_key", alnum.alias("alnum"), (alnum < 120).alias("low"))


@query("t17_fuzzy_vocabulary", "T17", sql=f"""WITH {S.CHUNKS}, {S.PAGES}, good AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM pages WHERE NOT ocr_used AND text IS NOT NULL) WHERE length(w) >= 4 GROUP BY w HAVING count(*) >= 5),
odd AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM pages WHERE ocr_used AND text IS NOT NULL) WHERE length(w) >= 4 AND w NOT IN (SELECT w FROM good))
SELECT odd.w AS token, good.w AS candidate, levenshtein(odd.w, good.w) AS distance FROM odd JOIN good ON left(odd.w, 1) = left(good.w, 1) AND abs(length(odd.w) - length(good.w)) <= 2 AND levenshtein(odd.w, good.w) <= 1""")
def t17_fuzzy_vocabulary(spark, d):
    rows = C.pages(spark, d).filter("text IS NOT NULL")
    words = lambda df: df.select(F.explode(T.tokens(c("text"), "[a-z]+")).alias("w")).filter(F.length("w") >= 4)
    good = words(rows.filter("NOT ocr_used")).groupBy("w").agg(F.count("*").alias("n")).filter("n >= 5").select("w")
    odd = words(rows.filter("ocr_used")).distinct().join(good, "w", "left_anti")
    return X.fuzzy_matches(odd, good, "w", 1)

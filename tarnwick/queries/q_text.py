"""Analysers, scores and text predicates over the whole chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import words as W
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col


def joined(values):
    return F.array_join(values, " ")


@query("t1_terms_v5", "T1", "Q17", sql=f"WITH {S.CHUNKS} SELECT chunk_key, array_to_string({S.terms_v5('text')}, ' ') AS terms FROM chunks")
def t1_terms_v5(spark, d):
    return C.chunks(spark, d, "text").select("chunk_key", joined(T.terms_v5(c("text"))).alias("terms"))


@query("t7_priority_terms", "T7", sql=f"SELECT qid, array_to_string(list_sort({S.terms_smart('question')}), ' ') AS terms, array_to_string(list_sort({S.priority_terms('question')}), ' ') AS priority FROM query_plans")
def t7_priority_terms(spark, d):
    q = c("question")
    return C.plans(spark, d).select("qid", joined(F.array_sort(T.terms_smart(q))).alias("terms"), joined(F.array_sort(T.priority_terms(q))).alias("priority"))


@query("t8_bm25_tokens", "T8", sql=f"WITH {S.CHUNKS} SELECT chunk_key, len({S.bm25_tokens('text')}) AS n_tokens, array_to_string(list_sort(list_distinct({S.bm25_tokens('text')})), ' ') AS distinct_tokens FROM chunks")
def t8_bm25_tokens(spark, d):
    tokens = T.bm25_tokens(c("text"))
    return C.chunks(spark, d, "text").select("chunk_key", F.size(tokens).cast("long").alias("n_tokens"), joined(F.array_sort(F.array_distinct(tokens))).alias("distinct_tokens"))


@query("t4_canonical_phrase", "T4", "T5", sql=f"SELECT qid, {S.canonical_phrase('question')} AS phrase FROM query_plans")
def t4_canonical_phrase(spark, d):
    return C.plans(spark, d).select("qid", T.canonical_phrase(c("question")).alias("phrase"))


_ROUTE = f"CASE WHEN length(w) > 7 AND w LIKE '%ation' THEN left(w, length(w) - 5) WHEN length(w) > 6 AND w LIKE '%tion' THEN left(w, length(w) - 3) WHEN length(w) > 6 AND w LIKE '%ment' THEN left(w, length(w) - 4) WHEN length({S.stem('w', W.STEM_ROUTE_SHORT)}) > 4 AND ({S.stem('w', W.STEM_ROUTE_SHORT)}) LIKE '%e' THEN regexp_replace({S.stem('w', W.STEM_ROUTE_SHORT)}, 'e+$', '') ELSE {S.stem('w', W.STEM_ROUTE_SHORT)} END"


@query("t6_stemmers", "T3", "T6", sql=f"""WITH {S.CHUNKS}, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM chunks)
SELECT w AS word, {S.stem('w', W.STEM_V5)} AS stem, {_ROUTE} AS route_stem, CASE WHEN length(w) <= 3 OR regexp_full_match(w, '[0-9]+') THEN w ELSE {S.stem('w', W.SINGULAR)} END AS singular FROM words""")
def t6_stemmers(spark, d):
    words = C.chunks(spark, d, "text").select(F.explode(F.array_distinct(T.tokens(c("text"), "[a-z0-9]+"))).alias("word")).distinct()
    w = c("word")
    singular = F.when((F.length(w) <= 3) | w.rlike("^[0-9]+$"), w).otherwise(T.stem(w, W.SINGULAR))
    return words.select("word", T.stem(w, W.STEM_V5).alias("stem"), T.route_stem(w).alias("route_stem"), singular.alias("singular"))


PAIRS = f"{S.CANDIDATES}, {S.CHUNKS}, pairs AS (SELECT qid, chunk_key, question, chunks.text AS body, chunks.section_path AS path FROM candidates JOIN query_plans USING (qid) JOIN chunks USING (chunk_key))"


def _pairs(spark, d):
    asked = C.candidates(spark, d).select("qid", "chunk_key").join(C.plans(spark, d).select("qid", "question"), "qid")
    return asked.join(C.chunks(spark, d, "text", "section_path"), "chunk_key")


@query("t10_weighted_lexical", "T9", "T10", "T48", sql=f"""WITH {PAIRS}, t AS (
  SELECT qid, chunk_key, {S.terms_smart('question')} AS q, {S.priority_terms('question')} AS p, {S.terms_smart('body')} AS b FROM pairs)
SELECT qid, chunk_key, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(q) END, 6) AS lexical,
  round(CASE WHEN len(p) = 0 THEN CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(q) END
    ELSE least(1.0, len(list_intersect(p, b)) / len(p) * 0.74 + len(list_intersect(q, b)) / len(q) * 0.26) END, 6) AS weighted FROM t""")
def t10_weighted_lexical(spark, d):
    q = c("question")
    rows = _pairs(spark, d).select("qid", "chunk_key", T.terms_smart(q).alias("terms"), T.priority_terms(q).alias("first"), T.terms_smart(c("text")).alias("source"))
    weighted = T.weighted_lexical(c("terms"), c("first"), c("source"))
    return rows.select("qid", "chunk_key", F.round(T.coverage(c("terms"), c("source")), 6).alias("lexical"), F.round(weighted, 6).alias("weighted"))


@query("t14_jaccard", "T14", "L23", sql=f"""WITH {PAIRS}, t AS (SELECT qid, chunk_key, {S.terms_smart('question')} AS q, {S.terms_smart('body')} AS b FROM pairs)
SELECT qid, chunk_key, round(CASE WHEN len(list_distinct(list_concat(q, b))) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(list_distinct(list_concat(q, b))) END, 6) AS jaccard FROM t""")
def t14_jaccard(spark, d):
    return _pairs(spark, d).select("qid", "chunk_key", F.round(T.jaccard(T.terms_smart(c("question")), T.terms_smart(c("text"))), 6).alias("jaccard"))


_SEC = S.canonical_phrase("x")


@query("t12_section_match", "T12", "T13", "F16", sql=f"""WITH {S.CHUNKS}, heads AS (SELECT DISTINCT section_path[len(section_path)] AS h FROM chunks WHERE len(section_path) > 0),
asked AS (SELECT regexp_replace(h, '^[0-9.]+ ', '') AS question FROM heads), q AS (SELECT DISTINCT question, {S.canonical_phrase('question')} AS n FROM asked),
parts AS (SELECT chunk_key, unnest(section_path) AS x FROM chunks), norm AS (SELECT chunk_key, {_SEC} AS p FROM parts),
scored AS (SELECT chunk_key, question, max(CASE WHEN p = '' THEN 0 WHEN p = n THEN 1 WHEN len(string_split(n, ' ')) >= 2 AND contains(' ' || p || ' ', ' ' || n || ' ') THEN 0.88
  WHEN len(string_split(n, ' ')) >= 2 AND contains(' ' || n || ' ', ' ' || p || ' ') THEN 0.72 ELSE 0 END) AS score FROM norm, q WHERE length(n) >= 3 GROUP BY ALL)
SELECT chunk_key, question, CAST(score AS DOUBLE) AS score FROM scored WHERE score > 0""")
def t12_section_match(spark, d):
    chunks = C.chunks(spark, d, "section_path")
    heads = chunks.filter(F.size("section_path") > 0).select(F.regexp_replace(F.element_at("section_path", -1), "^[0-9.]+ ", "").alias("question")).distinct()
    # Headings meet paths through the words they share: an equi-join on a word, not a product.
    word = lambda phrase: F.explode(F.array_distinct(F.split(phrase, " "))).alias("word")
    asked = heads.select("question", T.canonical_phrase(c("question")).alias("n")).filter("length(n) >= 3").select("question", F.element_at(F.split("n", " "), 1).alias("first"), "n", F.split("n", " ").alias("all"))
    paths = chunks.select("chunk_key", "section_path", word(T.canonical_phrase(F.array_join("section_path", " "))))
    near = asked.select("question", F.explode(F.array_distinct("all")).alias("word")).join(paths, "word").select("question", "chunk_key", "section_path").dropDuplicates(["question", "chunk_key"])
    return near.select("chunk_key", "question", T.section_match(c("question"), c("section_path")).alias("score")).filter("score > 0")


@query("t40_citations", "T40", "T41", "R41", sql=f"""WITH {S.AUDIT}, x AS (SELECT id, trim(response) AS r, list_transform(regexp_extract_all(response, '\\[S([0-9]+)\\]', 1), lambda n: CAST(n AS INT)) AS nums FROM audit WHERE response IS NOT NULL)
SELECT id, array_to_string(list_filter(nums, lambda n, i: n BETWEEN 1 AND 5 AND list_position(nums, n) = i), ',') AS cited,
  CASE WHEN r = '' THEN 'empty_answer' WHEN len(nums) = 0 THEN 'missing_citations' WHEN len(list_filter(nums, lambda n: n < 1 OR n > 5)) > 0 THEN 'citation_out_of_range' ELSE 'grounded' END AS reason FROM x""")
def t40_citations(spark, d):
    rows = C.audit(spark, d).filter("response IS NOT NULL")
    numbers = F.transform(F.regexp_extract_all("response", F.lit(r"\[S([0-9]+)\]"), F.lit(1)), lambda n: n.cast("int"))
    reason = F.when(F.trim("response") == "", "empty_answer").when(F.size(numbers) == 0, "missing_citations").when(F.exists(numbers, lambda n: ~n.between(1, 5)), "citation_out_of_range").otherwise("grounded")
    return rows.select("id", F.array_join(T.citations(c("response"), 5).cast("array<string>"), ",").alias("cited"), reason.alias("reason"))


@query("t18_document_codes", "T18", "C12", sql=f"""WITH {S.CHUNKS}, x AS (SELECT chunk_key, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Z]{{2}}-[0-9]+(?:/[A-Z])?)', 1))) AS code FROM chunks)
SELECT code, count(*) AS chunks, min(chunk_key) AS first_chunk FROM x GROUP BY code""")
def t18_document_codes(spark, d):
    codes = C.chunks(spark, d, "text").select("chunk_key", F.explode(T.document_code(c("text"))).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("chunks"), F.min("chunk_key").alias("first_chunk"))


_LINE = f"' ' || array_to_string({S.tokens('question', '[a-z0-9]+')}, ' ') || ' '"
_ASKS = "(" + " OR ".join(f"contains({_LINE}, ' {word} {what} ')" for word, after in T.ASKS.items() for what in after) + ")"


@query("q6_value_lookup", "Q6", "Q1", sql=f"""SELECT qid, len(list_intersect({S.terms_smart('question')}, {S.listed(W.VALUE_DIMENSIONS)})) > 0 OR {_ASKS} AS value_lookup,
  (len(list_intersect({S.terms_smart('question')}, {S.listed(W.VALUE_DIMENSIONS)})) > 0 OR {_ASKS})
  AND len(list_intersect({S.tokens('question', '[a-z0-9]+')}, {S.listed(W.STRUCTURED_CUES)})) > 0 AS structured FROM query_plans""")
def q6_value_lookup(spark, d):
    q = c("question")
    return C.plans(spark, d).select("qid", T.value_lookup(q).alias("value_lookup"), T.structured_lookup(q).alias("structured"))


@query("l21_text_quality", "L21", "L25", sql=f"""WITH {S.PAGES}, x AS (SELECT page_id, coalesce(text, '') AS t FROM pages),
y AS (SELECT page_id, t, regexp_replace(t, '\\s', '', 'g') AS solid, regexp_extract_all(t, '[A-Za-z0-9]+') AS words, list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l)), lambda l: l != '') AS lines FROM x)
SELECT page_id, round(CASE WHEN length(solid) = 0 OR len(words) = 0 THEN 0 ELSE greatest(0.0, least(1.0,
  least(1.0, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / 220) * 0.22
  + length(regexp_replace(solid, '[^\\p{{L}}\\p{{N}}.,;:!?()\\[\\]{{}}''"/%&+\\-–—]', '', 'g')) / length(solid) * 0.28
  + len(list_filter(words, lambda w: length(w) >= 2)) / len(words) * 0.28
  + (1 - len(list_filter(lines, lambda l: len(regexp_extract_all(l, '[A-Za-z0-9]+')) <= 1 AND length(l) <= 3)) / len(lines)) * 0.22)) END, 6) AS quality FROM y""")
def l21_text_quality(spark, d):
    return C.pages(spark, d).select("page_id", F.round(T.text_quality(F.coalesce("text", F.lit(""))), 6).alias("quality"))


@query("l26_clean_text", "L26", sql=f"""WITH {S.PAGES} SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS clean FROM pages WHERE text IS NOT NULL""")
def l26_clean_text(spark, d):
    return C.pages(spark, d).filter("text IS NOT NULL").select("page_id", T.clean_text(c("text")).alias("clean"))


@query("c16_id_hashing", "C16", sql=f"WITH {S.CHUNKS} SELECT chunk_key, sha256('run-1|' || document_id || '|' || chunk_index || '|' || left(text, 64)) AS logical_id FROM chunks")
def c16_id_hashing(spark, d):
    parts = F.concat_ws("|", F.lit("run-1"), "document_id", c("chunk_index").cast("string"), F.substring("text", 1, 64))
    return C.chunks(spark, d, "document_id", "chunk_index", "text").select("chunk_key", F.sha2(parts, 256).alias("logical_id"))


@query("t45_token_estimate", "T45", sql=f"WITH {S.CHUNKS} SELECT chunk_key, CAST(ceil(length(text) / 3.5) AS BIGINT) + 512 AS reserved FROM chunks")
def t45_token_estimate(spark, d):
    return C.chunks(spark, d, "text").select("chunk_key", (F.ceil(F.char_length("text") / 3.5) + 512).alias("reserved"))


@query("t39_filename_identity", "T38", "T39", "T37", "W27", "A10", sql=f"""WITH {S.FILES}, x AS (
  SELECT document_id, status, lower(regexp_replace(regexp_replace(filename, '\\.[Pp][Dd][Ff]$', ''), '\\s+', ' ', 'g')) AS identity, regexp_extract(filename, '^([A-Z]+) ', 1) AS family, regexp_extract(filename, '([0-9]+)', 1) AS num FROM files)
SELECT document_id, identity, CASE WHEN count(*) OVER (PARTITION BY family) >= 2 AND family != '' THEN family ELSE 'other' END AS family, CAST(TRY_CAST(num AS BIGINT) AS VARCHAR) AS sequence_no,
  regexp_replace(identity, '([0-9]+)', lpad(coalesce(nullif(num, ''), '0'), 12, '0')) AS natural_key FROM x""")
def t39_filename_identity(spark, d):
    name = F.regexp_replace(F.regexp_replace("filename", r"(?i)\.pdf$", ""), r"\s+", " ")
    rows = C.files(spark, d).select("document_id", F.lower(name).alias("identity"), F.regexp_extract("filename", "^([A-Z]+) ", 1).alias("code"), F.regexp_extract("filename", "([0-9]+)", 1).alias("number"))
    sizes = rows.groupBy("code").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, "code")
    family = F.when((c("n") >= 2) & (c("code") != ""), c("code")).otherwise("other")
    first = F.regexp_extract("identity", "^([^0-9]*)", 1)
    rest = F.substring(c("identity"), F.length(first) + F.length("number") + 1, F.length("identity"))
    key = F.when(c("number") == "", c("identity")).otherwise(F.concat(first, F.lpad("number", 12, "0"), rest))
    return rows.select("document_id", "identity", family.alias("family"), F.when(c("number") != "", c("number").cast("long").cast("string")).alias("sequence_no"), key.alias("natural_key"))


@query("w28_sequence_gaps", "W28", sql=f"""WITH {S.FILES}, n AS (SELECT DISTINCT regexp_extract(filename, '^([A-Z]+) ', 1) AS family, TRY_CAST(regexp_extract(filename, '([0-9]+)', 1) AS BIGINT) AS num FROM files),
s AS (SELECT family, min(num) AS lo, max(num) AS hi, count(*) AS seen FROM n WHERE num IS NOT NULL GROUP BY family HAVING count(*) >= 4),
want AS (SELECT family, unnest(generate_series(lo, hi)) AS num FROM s)
SELECT family, num AS missing FROM want ANTI JOIN n USING (family, num)""")
def w28_sequence_gaps(spark, d):
    numbers = C.files(spark, d).select(F.regexp_extract("filename", "^([A-Z]+) ", 1).alias("family"), F.expr("try_cast(regexp_extract(filename, '([0-9]+)', 1) AS bigint)").alias("num")).filter("num IS NOT NULL").distinct()
    spans = numbers.groupBy("family").agg(F.min("num").alias("lo"), F.max("num").alias("hi"), F.count("*").alias("seen")).filter("seen >= 4")
    want = spans.select("family", F.explode(F.sequence("lo", "hi")).alias("num"))
    return want.join(numbers, ["family", "num"], "left_anti").select("family", c("num").alias("missing"))

"""Joins: equi, semi, anti, as-of, range, interval, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import neighbours as N
from tarnwick.operators import ranking as R
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col


@query("j1_active_chunks", "J1", "S6", "F1", "F15", sql=f"""WITH {S.CHUNKS}, {S.FILES}
SELECT chunk_key, f.filename, f.status FROM chunks JOIN files f USING (document_id) WHERE f.status = 'ready' AND f.processed_at IS NOT NULL""")
def j1_active_chunks(spark, d):
    ready = C.files(spark, d).filter("status = 'ready' AND processed_at IS NOT NULL").select("document_id", "filename", "status")
    return C.chunks(spark, d, "document_id").join(ready, "document_id").select("chunk_key", "filename", "status")


@query("j6_neighbour_join", "J6", "J8", "R36", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, seeds AS (SELECT qid, document_id, chunk_index, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, lower(filename), page_number, coalesce(chunk_index, -1), chunk_id) AS n FROM candidates) WHERE n <= 3)
SELECT qid, k.chunk_key, min(abs(k.chunk_index - s.chunk_index)) AS distance FROM seeds s JOIN chunks k ON k.document_id = s.document_id AND abs(k.chunk_index - s.chunk_index) <= 2 GROUP BY ALL""")
def j6_neighbour_join(spark, d):
    seeds = R.top_in(C.candidates(spark, d), ["qid"], R.canonical_order(), 3).select("qid", "document_id", "chunk_index")
    near = N.neighbours(seeds, C.chunks(spark, d, "document_id", "chunk_index"), ["document_id"], "chunk_index", 2)
    return near.groupBy("qid", "chunk_key").agg(F.min("distance").alias("distance"))


@query("j7_parent_neighbours", "J7", "J9", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, head AS (SELECT chunk_key, document_id, chunk_index, content_type FROM chunks),
seeds AS (SELECT qid, h.* FROM candidates JOIN head h USING (chunk_key))
SELECT qid, k.chunk_key, round(max(greatest(0.35, 0.9 - 0.07 * abs(k.chunk_index - s.chunk_index))), 6) AS score FROM seeds s
JOIN head k ON k.document_id = s.document_id AND k.content_type = s.content_type AND abs(k.chunk_index - s.chunk_index) BETWEEN 1 AND 3 GROUP BY ALL""")
def j7_parent_neighbours(spark, d):
    head = C.chunks(spark, d, "document_id", "chunk_index", "content_type")
    seeds = C.candidates(spark, d).select("qid", "chunk_key").join(head, "chunk_key").drop("chunk_key")
    near = N.neighbours(seeds, head, ["document_id", "content_type"], "chunk_index", 3).filter("distance >= 1")
    return near.groupBy("qid", "chunk_key").agg(F.round(F.max(F.greatest(F.lit(0.35), 0.9 - 0.07 * c("distance"))), 6).alias("score"))


@query("j5_as_of_anchor", "J5", sql=f"""WITH {S.CHUNKS}, a AS (SELECT chunk_key, document_id, chunk_index, CASE WHEN regexp_matches(text, '^(Entry|Unless)') THEN chunk_key END AS anchor FROM chunks)
SELECT chunk_key, CAST((SELECT arg_max(b.anchor, b.chunk_index) FROM a b WHERE b.document_id = a.document_id AND b.anchor IS NOT NULL AND b.chunk_index BETWEEN a.chunk_index - 6 AND a.chunk_index) AS VARCHAR) AS anchor FROM a""")
def j5_as_of_anchor(spark, d):
    rows = C.chunks(spark, d, "document_id", "chunk_index", "text").withColumn("is_anchor", c("text").rlike("^(Entry|Unless)"))
    return N.latest_anchor(rows, ["document_id"], "chunk_index", c("is_anchor"), c("chunk_key").cast("string"), 6, "anchor").select("chunk_key", "anchor")


@query("j14_span_join", "J13", "J14", sql=f"""WITH {S.CHUNKS}, spans AS (SELECT document_id, chunk_index AS span_start, chunk_index + 5 AS span_end, chunk_key AS directive FROM chunks WHERE regexp_matches(text, '^Instead of'))
SELECT s.directive, k.chunk_key FROM spans s JOIN chunks k ON k.document_id = s.document_id AND k.chunk_index BETWEEN s.span_start AND s.span_end""")
def j14_span_join(spark, d):
    rows = C.chunks(spark, d, "document_id", "chunk_index", "text")
    spans = rows.filter(c("text").rlike("^Instead of")).select("document_id", c("chunk_index").alias("span_start"), (c("chunk_index") + 5).alias("span_end"), c("chunk_key").alias("directive"))
    return N.in_spans(rows, spans, ["document_id"], "chunk_index", "span_start", "span_end").select("directive", "chunk_key")


@query("j15_semi_join", "J15", sql=f"WITH {S.FILES}, {S.CHUNKS} SELECT document_id, filename FROM files WHERE EXISTS (SELECT 1 FROM chunks k WHERE k.document_id = files.document_id AND k.content_type = 'table')")
def j15_semi_join(spark, d):
    tables = C.chunks(spark, d, "document_id", "content_type").filter("content_type = 'table'")
    return C.files(spark, d).join(tables, "document_id", "left_semi").select("document_id", "filename")


@query("j16_anti_join", "J16", sql=f"WITH {S.FILES}, {S.CHUNKS} SELECT document_id, filename FROM files WHERE NOT EXISTS (SELECT 1 FROM chunks k WHERE k.document_id = files.document_id AND k.content_type = 'table')")
def j16_anti_join(spark, d):
    tables = C.chunks(spark, d, "document_id", "content_type").filter("content_type = 'table'")
    return C.files(spark, d).join(tables, "document_id", "left_anti").select("document_id", "filename")


@query("j10_enumeration_siblings", "J10", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, seeds AS (SELECT qid, chunks.document_id, chunks.heading, chunks.page_number FROM candidates JOIN chunks USING (chunk_key))
SELECT DISTINCT qid, k.chunk_key FROM seeds s JOIN chunks k ON k.document_id = s.document_id AND (k.heading = s.heading OR (k.content_type = 'table_row' AND abs(k.page_number - s.page_number) <= 1))""")
def j10_enumeration_siblings(spark, d):
    chunks = C.chunks(spark, d, "document_id", "heading", "page_number", "content_type")
    seeds = C.candidates(spark, d).select("qid", "chunk_key").join(chunks.select("chunk_key", "document_id", "heading", "page_number"), "chunk_key").drop("chunk_key").distinct()
    # The OR as two joins, then one row each.
    same = seeds.filter("heading IS NOT NULL").select("qid", "document_id", "heading").distinct().join(chunks.select("chunk_key", "document_id", "heading"), ["document_id", "heading"])
    pages = seeds.select("qid", "document_id", F.explode(F.sequence(c("page_number") - 1, c("page_number") + 1)).alias("page_number")).distinct()
    rows = pages.join(chunks.filter("content_type = 'table_row'").select("chunk_key", "document_id", "page_number"), ["document_id", "page_number"])
    return same.select("qid", "chunk_key").unionByName(rows.select("qid", "chunk_key")).distinct()


@query("j17_reference_hop", "J17", "J18", sql=f"""WITH {S.CHUNKS}, {S.FILES}, codes AS (SELECT DISTINCT document_id AS from_document, regexp_extract(lower(heading), '[a-z]+ [a-z]+$') AS code FROM chunks WHERE heading IS NOT NULL),
names AS (SELECT document_id AS to_document, regexp_replace(lower(filename), '[^a-z0-9]+', ' ', 'g') AS name FROM files)
SELECT from_document, to_document, code FROM codes JOIN names ON contains(name, code) WHERE code != '' AND from_document != to_document""")
def j17_reference_hop(spark, d):
    heads = C.chunks(spark, d, "document_id", "heading").filter("heading IS NOT NULL")
    codes = heads.select(c("document_id").alias("from_document"), F.regexp_extract(F.lower("heading"), "[a-z]+ [a-z]+$", 0).alias("code")).filter("code != ''").distinct()
    names = C.files(spark, d).select(c("document_id").alias("to_document"), F.regexp_replace(F.lower("filename"), "[^a-z0-9]+", " ").alias("name"))
    # Names that contain a code share its last word: or a word that begins with it. Every suffix of the words before is a key.
    last = F.element_at(F.split("code", " "), -1)
    grams = names.select("to_document", "name", F.explode(F.array_distinct(F.flatten(F.transform(F.split("name", " "), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda n: F.substring(w, F.lit(1), n)))))).alias("key"))
    return codes.withColumn("key", last).join(grams, "key").filter(F.contains(c("name"), c("code")) & (c("from_document") != c("to_document"))).select("from_document", "to_document", "code").distinct()


@query("j12_lateral_definition", "J12", "A7", sql=f"""WITH {S.CHUNKS} SELECT document_id, heading, chunk_key, page_number FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, heading ORDER BY page_number, chunk_index, chunk_key) AS n FROM chunks WHERE heading IS NOT NULL) WHERE n = 1""")
def j12_heading_catalog(spark, d):
    rows = C.chunks(spark, d, "document_id", "heading", "page_number", "chunk_index").filter("heading IS NOT NULL")
    first = rows.groupBy("document_id", "heading").agg(F.min(F.struct("page_number", "chunk_index", "chunk_key")).alias("f"))
    return first.select("document_id", "heading", c("f.chunk_key").alias("chunk_key"), c("f.page_number").alias("page_number"))


@query("f20_window_coverage", "W18", "W20", sql=f"""WITH {S.CHUNKS}, t AS (SELECT chunk_key, document_id, chunk_index, {S.terms_smart('text')} AS terms FROM chunks)
SELECT a.chunk_key, count(DISTINCT x.term) AS local_terms FROM t a JOIN (SELECT document_id, chunk_index, unnest(terms) AS term FROM t) x
  ON x.document_id = a.document_id AND x.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 2 GROUP BY a.chunk_key""")
def f20_window_coverage(spark, d):
    rows = C.chunks(spark, d, "document_id", "chunk_index", "text").withColumn("terms", T.terms_smart(c("text")))
    span = Window.partitionBy("document_id").orderBy("chunk_index").rangeBetween(-2, 2)
    local = F.size(F.array_distinct(F.flatten(F.collect_list("terms").over(span))))  # five chunks at most
    return rows.select("chunk_key", local.cast("long").alias("local_terms"))

"""Structure of pages and documents: margins, headings, sections, sections merged, tables, greedy selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.functions import text as X
from tarnwick.operators import neighbours as N
from tarnwick.operators import packing as P
from tarnwick.operators import ranking as R
from tarnwick.queries import registry_sql as S
from tarnwick.queries.q_rank import ORDER_SQL
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col
MASK = "regexp_replace(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')"


@query("l18_repeated_margins", "L17", "L18", sql=f"""WITH {S.PAGES}, l AS (SELECT filename, page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total FROM pages WHERE text IS NOT NULL),
total AS (SELECT filename, count(DISTINCT page_id) AS of FROM l GROUP BY filename), e AS (SELECT filename, page_id, {MASK} AS signature FROM l WHERE (n <= 3 OR n > total - 3) AND length(trim(line)) BETWEEN 1 AND 120)
SELECT filename, signature, count(DISTINCT page_id) AS on_pages FROM e JOIN total USING (filename) GROUP BY filename, signature, of HAVING count(DISTINCT page_id) >= greatest(3, floor(of * 0.6 + 0.5))""")
def l18_repeated_margins(spark, d):
    pages = C.pages(spark, d).filter("text IS NOT NULL")
    lines = F.split("text", "\n")
    rows = pages.select("filename", "page_id", F.size(lines).alias("lines"), F.posexplode(lines).alias("place", "line")).withColumn("place", c("place") + 1)
    return N.repeated_margins(rows, "filename", "page_id", "line", "place", "lines")


@query("l14_heading_lines", "L13", "L14", "T53", sql=f"""WITH {S.PAGES}, l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pages WHERE text IS NOT NULL),
t AS (SELECT page_id, n, trim(line) AS line FROM l), h AS (SELECT *, regexp_extract(line, '^([0-9]+(?:\\.[0-9]+)*)\\.? +[A-Z]', 1) AS num FROM t WHERE length(line) BETWEEN 4 AND 120)
SELECT page_id, CAST(n AS INT) AS line_no, CASE WHEN num != '' THEN least(length(num) - length(replace(num, '.', '')) + 2, 8) ELSE 1 END AS level FROM h
WHERE (num != '' AND NOT regexp_matches(line, '[.!?;,]$')) OR (num = '' AND regexp_full_match(line, '[A-Z][A-Z0-9 ,&/()-]{{3,}}') AND len(regexp_extract_all(line, '[A-Za-z0-9]+')) BETWEEN 2 AND 18)""")
def l14_heading_lines(spark, d):
    pages = C.pages(spark, d).filter("text IS NOT NULL")
    rows = pages.select("page_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("page_id", (c("at") + 1).alias("line_no"), F.trim("line").alias("line"))
    number = F.regexp_extract("line", r"^([0-9]+(?:\.[0-9]+)*)\.? +[A-Z]", 1)
    rows = rows.filter(F.char_length("line").between(4, 120)).withColumn("num", number)
    numbered = (c("num") != "") & ~c("line").rlike(r"[.!?;,]$")
    words = F.size(F.regexp_extract_all("line", F.lit("[A-Za-z0-9]+"), F.lit(0)))
    capitals = (c("num") == "") & c("line").rlike(r"^[A-Z][A-Z0-9 ,&/()-]{3,}$") & words.between(2, 18)
    level = F.when(c("num") != "", F.least(F.length("num") - F.length(F.replace("num", F.lit("."), F.lit(""))) + 2, F.lit(8))).otherwise(1)
    return rows.filter(numbered | capitals).select("page_id", "line_no", level.alias("level"))


@query("c8_element_groups", "C8", sql=f"""WITH {S.CHUNKS}, b AS (SELECT *, CASE WHEN content_type IS DISTINCT FROM lag(content_type) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_key) THEN 1 ELSE 0 END AS brk FROM chunks),
i AS (SELECT *, sum(brk) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_key ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT document_id, CAST(island AS BIGINT) AS island, content_type, count(*) AS elements, CAST(sum(length(text)) AS BIGINT) AS chars, min(page_number) AS page_start, max(page_number) AS page_end FROM i GROUP BY ALL""")
def c8_element_groups(spark, d):
    rows = C.chunks(spark, d, "document_id", "chunk_index", "content_type", "text", "page_number").withColumn("n", F.char_length("text")).drop("text")
    by = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_key")
    rows = N.islands(rows, ["document_id"], ["chunk_index", "chunk_key"], ~c("content_type").eqNullSafe(F.lag("content_type").over(by)))
    return rows.groupBy("document_id", "island", "content_type").agg(F.count("*").alias("elements"), F.sum("n").alias("chars"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))


@query("c10_row_to_text", "C10", "T43", "L27", sql=f"""WITH {S.CHUNKS}, x AS (SELECT chunk_key, list_filter(list_transform(string_split(text, '|'), lambda p: trim(p)), lambda p: p != '') AS cells FROM chunks WHERE content_type = 'table_row')
SELECT chunk_key, len(cells) AS cells, array_to_string(list_transform(cells, lambda p: trim(regexp_extract(p, '^([^:]*):', 1))), ' | ') AS columns FROM x""")
def c10_row_to_text(spark, d):
    rows = C.chunks(spark, d, "content_type", "text").filter("content_type = 'table_row'")
    cells = F.filter(F.transform(F.split("text", r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return rows.select("chunk_key", F.size(cells).cast("long").alias("cells"), F.array_join(F.transform(cells, lambda p: F.trim(F.regexp_extract(p, "^([^:]*):", 1))), " | ").alias("columns"))


@query("c11_context_header", "C11", sql=f"""WITH {S.CHUNKS} SELECT chunk_key, '[PDF CHUNK CONTEXT]' || chr(10) || 'File: ' || filename || chr(10) || 'Pages: ' || CASE WHEN coalesce(page_end, page_number) = page_number THEN CAST(page_number AS VARCHAR) ELSE page_number || '-' || page_end END
 || chr(10) || 'Section path: ' || CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE 'Unsectioned content' END || chr(10) || 'Content type: ' || content_type
 || coalesce(chr(10) || 'Rolling stock / train context: ' || rolling_stock, '') || coalesce(chr(10) || 'Procedure context: ' || procedure_ref, '') || chr(10) || '[/PDF CHUNK CONTEXT]' AS header FROM chunks""")
def c11_context_header(spark, d):
    rows = C.chunks(spark, d, "filename", "page_number", "page_end", "section_path", "content_type", "rolling_stock", "procedure_ref")
    same = F.coalesce("page_end", "page_number") == c("page_number")
    pages = F.when(same, c("page_number").cast("string")).otherwise(F.concat_ws("-", "page_number", "page_end"))
    path = F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).otherwise("Unsectioned content")
    line = lambda label, value: F.concat(F.lit(label), value)
    parts = [F.lit("[PDF CHUNK CONTEXT]"), line("File: ", c("filename")), line("Pages: ", pages), line("Section path: ", path), line("Content type: ", c("content_type")), line("Rolling stock / train context: ", c("rolling_stock")), line("Procedure context: ", c("procedure_ref")), F.lit("[/PDF CHUNK CONTEXT]")]
    return rows.select("chunk_key", F.concat_ws("\n", *parts).alias("header"))


_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {ORDER_SQL}) AS rank FROM candidates)"


@query("w8_mixed_cap", "W8", sql=f"""WITH RECURSIVE {S.CANDIDATES}, {S.CHUNKS}, {_RANKED}, r AS (SELECT qid, rank, chunk_key, ranked.document_id, k.content_type FROM ranked JOIN (SELECT chunk_key, content_type FROM chunks) k USING (chunk_key)),
walk AS (SELECT qid, CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS chunk_key, CAST([] AS VARCHAR[]) AS docs, false AS kept FROM (SELECT DISTINCT qid FROM r)
 UNION ALL SELECT r.qid, r.rank, r.chunk_key, CASE WHEN y.ok THEN list_append(walk.docs, r.document_id) ELSE walk.docs END, y.ok FROM walk JOIN r ON r.qid = walk.qid AND r.rank = walk.rank + 1,
 LATERAL (SELECT len(walk.docs) < 16 AND (len(walk.docs) < 8 OR len(list_filter(walk.docs, lambda x: x = r.document_id)) < CASE r.content_type WHEN 'table_row' THEN 3 ELSE 2 END) AS ok) y)
SELECT qid, rank, chunk_key FROM walk WHERE kept""")
def w8_mixed_cap(spark, d):
    rows = C.candidates(spark, d).join(C.chunks(spark, d, "content_type"), "chunk_key")
    ranked = R.rank_in(rows, ["qid"], R.canonical_order()).select("qid", "rank", "chunk_key", "document_id", "content_type")
    schema = ranked.schema
    return P.by_group(ranked, ["qid"], ["rank"], schema, lambda r: P.half_fill_mixed_cap(r, "document_id", "content_type", 16, 2, 3)).select("qid", "rank", "chunk_key")


@query("a14_diversify", "A14", "A15", sql=f"""WITH RECURSIVE {S.CANDIDATES}, {S.CHUNKS}, {_RANKED}, r AS (SELECT qid, rank, chunk_key, ranked.filename || '/' || k.page_number AS page, t FROM ranked JOIN (SELECT chunk_key, page_number, list_distinct({S.bm25_tokens('text')}) AS t FROM chunks) k USING (chunk_key)),
walk AS (SELECT qid, CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS chunk_key, CAST([] AS VARCHAR[]) AS pages, CAST([] AS VARCHAR[][]) AS sets, false AS kept FROM (SELECT DISTINCT qid FROM r)
 UNION ALL SELECT r.qid, r.rank, r.chunk_key, CASE WHEN y.ok THEN list_append(walk.pages, r.page) ELSE walk.pages END, CASE WHEN y.ok THEN list_append(walk.sets, r.t) ELSE walk.sets END, y.ok FROM walk JOIN r ON r.qid = walk.qid AND r.rank = walk.rank + 1,
 LATERAL (SELECT len(walk.sets) < 12 AND len(list_filter(walk.pages, lambda x: x = r.page)) < 2 AND (len(r.t) = 0 OR len(list_filter(walk.sets, lambda s: len(list_intersect(s, r.t)) >= 0.88 * (len(s) + len(r.t) - len(list_intersect(s, r.t))))) = 0) AS ok) y)
SELECT qid, rank, chunk_key FROM walk WHERE kept""")
def a14_diversify(spark, d):
    rows = C.candidates(spark, d).drop("page_number").join(C.chunks(spark, d, "text", "page_number"), "chunk_key")
    ranked = R.rank_in(rows, ["qid"], R.canonical_order()).select("qid", "rank", "chunk_key", "filename", "page_number", F.array_distinct(X.bm25_tokens(c("text"))).alias("terms"))
    out = P.by_group(ranked, ["qid"], ["rank"], ranked.schema, lambda r: P.diversify(r, "terms", ["filename", "page_number"], 12))
    return out.select("qid", "rank", "chunk_key")


@query("w22_batches", "W22", sql=f"""WITH RECURSIVE {S.CANDIDATES}, {S.CHUNKS}, {_RANKED}, r AS (SELECT qid, rank, chunk_key, length(text) AS size FROM ranked JOIN (SELECT chunk_key, text FROM chunks) USING (chunk_key)),
walk AS (SELECT qid, rank, chunk_key, size, 0 AS batch, size AS used FROM r WHERE rank = 1
 UNION ALL SELECT r.qid, r.rank, r.chunk_key, r.size, CASE WHEN walk.used > 0 AND walk.used + r.size > 6000 THEN walk.batch + 1 ELSE walk.batch END, CASE WHEN walk.used > 0 AND walk.used + r.size > 6000 THEN r.size ELSE walk.used + r.size END FROM walk JOIN r ON r.qid = walk.qid AND r.rank = walk.rank + 1)
SELECT qid, rank, chunk_key, size, batch FROM walk""")
def w22_batches(spark, d):
    rows = C.candidates(spark, d).join(C.chunks(spark, d, "text").withColumn("size", F.char_length("text")).drop("text"), "chunk_key")
    ranked = R.rank_in(rows, ["qid"], R.canonical_order()).select("qid", "rank", "chunk_key", "size")
    schema = T.StructType([*ranked.schema.fields, T.StructField("batch", T.IntegerType())])
    return P.by_group(ranked, ["qid"], ["rank"], schema, lambda r: P.batches(r, "size", 6000, "batch"))


@query("c4_paragraph_packer", "C4", "C5", "C1")
def c4_paragraph_packer(spark, d):
    rows = C.pages(spark, d).filter("text IS NOT NULL").select("page_id", "text")
    schema = T.StructType([rows.schema["page_id"], T.StructField("piece", T.IntegerType()), T.StructField("body", T.StringType())])
    return P.per_row(rows, schema, lambda x: [{"page_id": x["page_id"], "piece": i, "body": p} for i, p in enumerate(P.paragraphs(x["text"], 900, 220))])


@query("c4_kept", "C4", "C5", sql=f"""WITH {S.PAGES}, x AS (SELECT page_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '\\s', '', 'g') <> '') AS parts FROM pages WHERE text IS NOT NULL) SELECT page_id, len(parts) AS paragraphs, TRUE AS kept, TRUE AS fits FROM x WHERE len(parts) > 0""")
def c4_kept(spark, d):
    """What must hold of packed paragraphs: each that fits is whole in some piece, and no piece is too long."""
    rows = C.pages(spark, d).filter("text IS NOT NULL")
    parts = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\s", "") != "")
    pieces = c4_paragraph_packer(spark, d).groupBy("page_id").agg(F.collect_list("body").alias("pieces"))  # the pieces of a page
    kept = F.forall("parts", lambda x: (F.char_length(x) > 900) | F.exists("pieces", lambda p: F.contains(p, x)))
    return rows.select("page_id", parts.alias("parts")).join(pieces, "page_id").select("page_id", F.size("parts").cast("long").alias("paragraphs"), kept.alias("kept"), F.forall("pieces", lambda p: F.char_length(p) <= 900).alias("fits"))

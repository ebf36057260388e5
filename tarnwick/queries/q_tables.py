"""Layout, tables, terminology, rules and states over the whole tables: lines of pages, cells of tables, texts of chunks, questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tarnwick.functions import patterns as P
from tarnwick.functions import text as T
from tarnwick.operators import evidence_index as I
from tarnwick.operators import layout as L
from tarnwick.operators import neighbours as N
from tarnwick.operators import packing as K
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col
LINES = f"{S.PAGES}, lines AS (SELECT page_id, filename, page_number, content_type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pages WHERE text IS NOT NULL)"
CELLS = f"{S.CHUNKS}, cells AS (SELECT chunk_key, trim(unnest(string_split(replace(text, chr(10), '|'), '|'))) AS cell FROM chunks WHERE content_type IN ('table', 'table_row'))"


def _lines(spark, d):
    rows = C.pages(spark, d).filter("text IS NOT NULL").select("page_id", "filename", "page_number", "content_type", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.withColumn("n", (c("at") + 1).cast("long")).drop("at")


def _words(spark, d):
    """Words with boxes: what a page's blanks say about where its words stand, 20 units a blank, lines 12 apart."""
    rows = _lines(spark, d).select("page_id", "n", F.posexplode(F.split("line", " ")).alias("at", "word")).filter("word != ''")
    x0, y0 = (c("at") * 20).cast("double"), (c("n") * 12).cast("double")
    return rows.select("page_id", "n", "word", x0.alias("x0"), (x0 + 15).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"))


# Layout
@query("l1_word_lines", "L1", sql=f"""WITH {LINES}, w AS (SELECT page_id, n, len(list_filter(string_split(line, ' '), lambda x: x != '')) AS words FROM lines)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS line, words FROM w WHERE words > 0""")
def l1_word_lines(spark, d):
    rows = _words(spark, d).select("page_id", "word", "x0", "y0", "y1")
    schema = Ty.StructType([*rows.schema.fields, Ty.StructField("line", Ty.IntegerType())])
    found = K.by_group(rows, ["page_id"], [], schema, L.lines_of)
    return found.groupBy("page_id", c("line").cast("long").alias("line")).agg(F.count("*").alias("words"))


@query("l2_line_segments", "L2", "L28", sql=f"""WITH {LINES}, s AS (SELECT page_id, n, list_filter(regexp_split_to_array(regexp_replace(line, '^ +| +$', '', 'g'), ' {{2,}}'), lambda x: x != '') AS parts FROM lines)
SELECT page_id, n, generate_subscripts(parts, 1) - 1 AS segment, unnest(parts) AS word FROM s""")
def l2_line_segments(spark, d):
    return L.segments(_words(spark, d), ["page_id", "n"], "x0", "x1", "word", 595.0).select("page_id", "n", "segment", "word")


@query("l3_column_positions", "L3", sql=f"WITH {LINES} SELECT DISTINCT page_id, CAST(20 * (length(line) - length(ltrim(line, ' '))) AS DOUBLE) AS x FROM lines WHERE length(ltrim(line, ' ')) > 0")
def l3_column_positions(spark, d):
    rows = _words(spark, d).groupBy("page_id", "n").agg(F.min("x0").alias("x0")).select("page_id", "x0")
    schema = Ty.StructType([rows.schema["page_id"], Ty.StructField("x", Ty.DoubleType())])
    return K.by_group(rows, ["page_id"], ["x0"], schema, lambda r: [{"page_id": r[0]["page_id"], "x": v} for v in L.column_positions([w["x0"] for w in r], 4.0)])


@query("l31_box_overlap", "L31", sql=f"""WITH {S.CHUNKS}, b AS (SELECT chunk_key, document_id, page_number AS x0, greatest(coalesce(page_end, page_number), page_number) + 1 AS x1, chunk_index AS y0, chunk_index + 2 AS y1 FROM chunks),
m AS (SELECT p.chunk_key AS a, q.chunk_key AS b, greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS common, least((p.x1 - p.x0) * (p.y1 - p.y0), (q.x1 - q.x0) * (q.y1 - q.y0)) AS smaller FROM b p JOIN b q ON p.document_id = q.document_id AND p.chunk_key < q.chunk_key)
SELECT a, b, round(common / smaller, 6) AS share FROM m WHERE common > 0""")
def l31_box_overlap(spark, d):
    """Chunks as boxes of pages and places of their document; boxes meet by the cells of a grid that they touch."""
    rows = C.chunks(spark, d, "document_id", "page_number", "page_end", "chunk_index")
    box = F.struct(c("page_number").cast("double").alias("x0"), (F.greatest(F.coalesce("page_end", "page_number"), c("page_number")) + 1).cast("double").alias("x1"), c("chunk_index").cast("double").alias("y0"), (c("chunk_index") + 2).cast("double").alias("y1"))
    boxes = rows.select(c("chunk_key").alias("id"), "document_id", box.alias("box"))
    cells = lambda lo, hi, wide: F.explode(F.sequence(F.floor(lo / wide), F.floor(hi / wide)))
    placed = boxes.withColumn("cx", cells(c("box.x0"), c("box.x1"), 4)).withColumn("cy", cells(c("box.y0"), c("box.y1"), 4))
    a, b = placed.select("document_id", c("id").alias("a"), c("box").alias("ba"), "cx", "cy"), placed.select("document_id", c("id").alias("b"), c("box").alias("bb"), "cx", "cy")
    met = a.join(b, ["document_id", "cx", "cy"]).filter("a < b").select("a", "b", F.round(L.overlap_of_smaller(c("ba"), c("bb")), 6).alias("share"))
    return met.filter("share > 0").distinct()


@query("l16_heading_paths", "L16", "C2", sql=f"""WITH {LINES}, h AS (SELECT page_id, filename, page_number, n, line, row_number() OVER (PARTITION BY filename ORDER BY page_number, page_id, n) AS pos, regexp_extract(line, '^([0-9]+(?:[.][0-9]+)*)[.]? +[A-Z]', 1) AS number FROM lines),
k AS (SELECT *, len(string_split(number, '.')) AS level FROM h WHERE number <> ''),
p AS (SELECT page_id, n, filename, pos, {', '.join(f"max(CASE WHEN level = {i} THEN pos END) OVER o AS a{i}" for i in range(1, 5))} FROM k WHERE level <= 4 WINDOW o AS (PARTITION BY filename ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t AS (SELECT filename, pos, line FROM k)
SELECT p.page_id, p.n, array_to_string(list_filter([{', '.join(f"t{i}.line" for i in range(1, 5))}], lambda x: x IS NOT NULL), ' > ') AS path FROM p
{' '.join(f"LEFT JOIN t t{i} ON t{i}.filename = p.filename AND t{i}.pos = p.a{i}" + ''.join(f" AND coalesce(p.a{j}, 0) < p.a{i}" for j in range(1, i)) for i in range(1, 5))}""")
def l16_heading_paths(spark, d):
    number = F.regexp_extract("line", r"^([0-9]+(?:[.][0-9]+)*)[.]? +[A-Z]", 1)
    rows = _lines(spark, d).withColumn("level", F.when(number == "", 0).otherwise(F.size(F.split(number, "[.]"))))
    rows = rows.filter(c("level").between(1, 4))
    found = N.heading_paths(rows, ["filename"], ["page_number", "page_id", "n"], "level", "line")
    return found.select("page_id", "n", F.array_join("section_path", " > ").alias("path"))


@query("l20_needs_ocr", "L20", "L32", sql=f"WITH {S.PAGES} SELECT page_id, length(coalesce(text, '')) < 80 OR coalesce(ocr_used, false) AS ocr FROM pages")
def l20_needs_ocr(spark, d):
    """Pages with little text, or with much of their area in images: here those that were scanned."""
    chars, share = F.char_length(F.coalesce("text", F.lit(""))), F.when(c("ocr_used"), 0.7).otherwise(0.1)
    return C.pages(spark, d).select("page_id", ((chars < 80) | (share > 0.55)).alias("ocr"))


# Tables
def _page_tables(spark, d):
    """(filename, page_id, page, columns, names): the table of each page of tables, its names where a row has no digits."""
    rows = _lines(spark, d).filter((c("content_type") == "table") & F.contains("line", F.lit("|")))
    parts = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    names = F.when(~c("line").rlike("[0-9]"), F.array_join(parts, "|"))
    head = rows.select("filename", "page_id", c("page_number").alias("page"), "n", F.size(parts).alias("columns"), names.alias("names"))
    return head.groupBy("filename", "page_id", "page").agg(F.max("columns").alias("columns"), F.min_by("names", F.when(c("names").isNotNull(), c("n"))).alias("names"))


_TABLES = f"""{LINES}, tables AS (SELECT filename, page_id, page_number AS page, max(len(string_split(line, '|'))) AS columns, min_by(array_to_string(list_transform(string_split(line, '|'), lambda x: trim(x)), '|'), n) FILTER (WHERE NOT regexp_matches(line, '[0-9]')) AS names
FROM lines WHERE content_type = 'table' AND contains(line, '|') GROUP BY ALL)"""


@query("l7_multipage_tables", "L7", sql=f"""WITH {_TABLES}, g AS (SELECT *, CASE WHEN page = lag(page) OVER o + 1 AND columns = lag(columns) OVER o THEN 0 ELSE 1 END AS fresh FROM tables WINDOW o AS (PARTITION BY filename ORDER BY page))
SELECT page_id, CAST(sum(fresh) OVER (PARTITION BY filename ORDER BY page) AS BIGINT) AS whole FROM g""")
def l7_multipage_tables(spark, d):
    rows = _page_tables(spark, d).select("filename", "page_id", "page", c("page").alias("page_end"), F.lit(0.0).alias("y0"), "columns")
    return L.multipage_tables(rows, "filename").select("page_id", "whole")


@query("l8_schema_propagation", "L8", sql=f"""WITH {_TABLES}, t AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY page) AS no FROM tables),
m AS (SELECT a.page_id, b.names, row_number() OVER (PARTITION BY a.page_id ORDER BY b.page DESC, b.names DESC) AS n FROM t a JOIN t b ON a.filename = b.filename AND b.no BETWEEN a.no - 8 AND a.no - 1 AND a.page - b.page <= 3 AND b.names IS NOT NULL)
SELECT t.page_id, coalesce(t.names, m.names) AS names FROM t LEFT JOIN m ON m.page_id = t.page_id AND m.n = 1""")
def l8_schema_propagation(spark, d):
    """A table without names takes those of the best of the last eight tables of its file, within three pages."""
    order = Window.partitionBy("filename").orderBy("page")
    last = F.collect_list(F.struct("page", "names")).over(order.rowsBetween(-8, -1))  # eight at most
    fits = lambda me: F.filter("last", lambda t: t["names"].isNotNull() & (me - t["page"] <= 3))
    rows = _page_tables(spark, d).withColumn("last", last)
    return rows.select("page_id", F.coalesce("names", F.array_max(fits(c("page")))["names"]).alias("names"))


def _cells(spark, d):
    rows = C.chunks(spark, d, "text", "content_type").filter(c("content_type").isin("table", "table_row"))
    return rows.select("chunk_key", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit("|")), r"\|")).alias("cell")).withColumn("cell", F.trim("cell"))


@query("l9_column_names", "L9", sql=f"""WITH {CELLS}, v AS (SELECT DISTINCT cell FROM cells), x AS (SELECT cell, trim(regexp_replace(cell, '\\s+', ' ', 'g')) AS v FROM v), y AS (SELECT cell, v, length(regexp_replace(v, '[^\\p{{L}}]', '', 'g')) AS l, len(regexp_extract_all(v, '[A-Za-z]+')) AS n FROM x)
SELECT cell, CAST(round(CASE WHEN v = '' OR lower(v) LIKE 'column %' OR regexp_full_match(v, '\\(?[0-9]+\\)?') THEN 0 WHEN l < 3 OR n = 0 THEN 0.05 WHEN length(v) <= 3 AND n <= 1 THEN 0.10 ELSE least(1.0, 0.35 + least(0.45, l / 40.0) + least(0.20, n * 0.05)) END, 6) AS DOUBLE) AS score FROM y""")
def l9_column_names(spark, d):
    return _cells(spark, d).select("cell").distinct().select("cell", F.round(P.column_name_score(c("cell")), 6).alias("score"))


@query("l12_table_plausibility", "L12", sql=f"""WITH {CELLS} SELECT chunk_key, count(*) FILTER (WHERE len(regexp_extract_all(cell, '[A-Za-z]+')) >= 5) / count(*) < 0.5 AS plausible FROM cells GROUP BY chunk_key""")
def l12_table_plausibility(spark, d):
    words = F.size(F.regexp_extract_all("cell", F.lit("[A-Za-z]+"), F.lit(0)))
    return _cells(spark, d).groupBy("chunk_key").agg((F.count_if(words >= 5) / F.count("*") < 0.5).alias("plausible"))


@query("t22_cell_pairs", "T22", sql=f"""WITH {S.CHUNKS}, s AS (SELECT chunk_key, list_transform(string_split(replace(text, chr(10), '|'), '|'), lambda x: trim(x)) AS p FROM chunks WHERE content_type IN ('table', 'table_row')), n AS (SELECT chunk_key, p[i] AS alias, p[i + 1] AS name FROM s, range(1, 4000) r(i) WHERE i < len(p))
SELECT DISTINCT chunk_key, alias, name FROM n WHERE regexp_full_match(alias, '[A-Z][A-Z0-9/-]{{1,11}}') AND regexp_matches(name, '[a-z]{{2,}} [A-Za-z]{{2,}}')""")
def t22_cell_pairs(spark, d):
    """Neighbouring cells of which the first is an alias in capitals and the second a name of several words."""
    rows = C.chunks(spark, d, "text", "content_type").filter(c("content_type").isin("table", "table_row"))
    p = F.transform(F.split(F.replace("text", F.lit("\n"), F.lit("|")), r"\|"), lambda x: F.trim(x))
    pairs = rows.select("chunk_key", p.alias("p")).select("chunk_key", F.explode(F.arrays_zip(c("p").alias("alias"), F.slice("p", 2, F.size("p")).alias("name"))).alias("z"))
    return pairs.select("chunk_key", "z.alias", "z.name").filter(c("alias").rlike("^[A-Z][A-Z0-9/-]{1,11}$") & c("name").rlike("[a-z]{2,} [A-Za-z]{2,}")).distinct()


# Terminology
_NAME = "[A-Z][A-Za-z]+(?:[ /-](?:[A-Z][A-Za-z]+|of|and|the|for|to|in|on)){1,7}"
_SHAPES = ((f"({_NAME}) \\\\(([A-Z][A-Z0-9]{{1,9}})\\\\)", 2, 1, 0.98), (f"\\\\b([A-Z][A-Z0-9]{{1,9}}) \\\\(({_NAME})\\\\)", 1, 2, 0.98), ("\\\\b([A-Z][A-Z0-9]{1,9}) means ([A-Za-z]+(?: [A-Za-z]+){1,7})", 1, 2, 0.96), (f"\\\\b([A-Z][A-Z0-9]{{1,9}}) [-–:] ({_NAME})", 1, 2, 0.97))
_SHAPES = tuple((p.replace("\\\\", "\\"), a, b, sure) for p, a, b, sure in _SHAPES)
TERMS = f"""a AS ({' UNION ALL '.join(f"SELECT id, unnest(regexp_extract_all(text, '{p}', {a})) AS alias, unnest(regexp_extract_all(text, '{p}', {b})) AS name, {sure} AS conf FROM t" for p, a, b, sure in _SHAPES)}),
w AS (SELECT *, string_split(name, ' ') AS ws FROM a),
p AS (SELECT id, alias, conf, array_to_string(ws[b:e], ' ') AS part, b, e, len(ws) AS n FROM w, generate_series(1, 9) x(b), generate_series(1, 9) y(e) WHERE b <= e AND e <= len(ws) AND (b = 1 OR e = len(ws))),
f AS (SELECT *, row_number() OVER (PARTITION BY id, alias, conf, n ORDER BY CASE WHEN e = n THEN 0 ELSE 1 END, b DESC, e) AS r FROM p
 WHERE upper(array_to_string(list_transform(list_filter(regexp_split_to_array(part, '[\\s/-]+'), lambda x: x != ''), lambda x: left(x, 1)), '')) = alias
  OR upper(array_to_string(list_transform(list_filter(regexp_split_to_array(part, '[\\s/-]+'), lambda x: NOT regexp_full_match(lower(x), 'of|and|the|for|to|in|on')), lambda x: left(x, 1)), '')) = alias),
terms AS (SELECT id, alias, part AS canonical, CAST(max(conf) AS DOUBLE) AS confidence FROM f WHERE r = 1 GROUP BY ALL)"""


@query("t20_terminology", "T20", "T21", "F10", sql=f"WITH {S.CHUNKS}, t AS (SELECT chunk_key AS id, text FROM chunks), {TERMS} SELECT id AS chunk_key, alias, canonical, confidence FROM terms")
def t20_terminology(spark, d):
    return I.terminology(C.chunks(spark, d, "text"), "chunk_key", "text")


@query("a1_dominant_terms", "A1", "A17", sql=f"""WITH {S.CHUNKS}, t AS (SELECT chunk_key AS id, text FROM chunks), {TERMS}, m AS (SELECT alias, lower(canonical) AS canonical, count(*) AS mentions, round(avg(confidence), 6) AS confidence FROM terms GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS n, lead(mentions) OVER o AS second FROM m WINDOW o AS (PARTITION BY alias ORDER BY mentions DESC, confidence DESC, canonical))
SELECT alias, canonical, mentions, confidence, coalesce(second, 0) >= mentions * 0.65 AS ambiguous FROM r WHERE n = 1""")
def a1_dominant_terms(spark, d):
    return I.dominant_terms(I.terminology(C.chunks(spark, d, "text"), "chunk_key", "text"))


# Numbers, states, scopes
_RULE = rf"(?i)([a-z]+(?: [a-z]+)?) (?:is |are |of |)({'|'.join(p for p, _ in I.COMPARISONS)}) ([0-9]+(?:\.[0-9]+)?) ?({I.UNIT})?"
RULES = f"""r AS (SELECT chunk_key, lower(unnest(regexp_extract_all(text, '{_RULE}', 1))) AS subject, lower(unnest(regexp_extract_all(text, '{_RULE}', 2))) AS words, CAST(unnest(regexp_extract_all(text, '{_RULE}', 3)) AS DOUBLE) AS threshold, lower(unnest(regexp_extract_all(text, '{_RULE}', 4))) AS u FROM chunks),
rules AS (SELECT chunk_key, subject, CASE words {' '.join(f"WHEN '{p}' THEN '{o}'" for p, o in I.COMPARISONS)} END AS operator, threshold, CASE u {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in I.UNITS.items())} END AS unit FROM r)"""


@query("t28_numeric_rules", "T28", "T32", sql=f"WITH {S.CHUNKS}, {RULES} SELECT * FROM rules")
def t28_numeric_rules(spark, d):
    return I.numeric_rules(C.chunks(spark, d, "text"), "chunk_key", "text")


@query("t30_rule_evaluation", "T30", "T31", sql=f"""WITH {S.CHUNKS}, {RULES}, facts AS (SELECT subject, unit, subject || '/' || coalesce(unit, '') AS fact, median(threshold) AS value FROM rules GROUP BY ALL)
SELECT fact, chunk_key, CAST(round(greatest(-0.35, least(0.45, sum(CASE WHEN (operator = '>=' AND value >= threshold) OR (operator = '>' AND value > threshold) OR (operator = '<=' AND value <= threshold) OR (operator = '<' AND value < threshold) THEN 0.32 ELSE -0.18 END))), 6) AS DOUBLE) AS score
FROM facts JOIN rules ON facts.subject = rules.subject AND facts.unit IS NOT DISTINCT FROM rules.unit GROUP BY ALL""")
def t30_rule_evaluation(spark, d):
    """Each rule of the corpus against the usual value of what it is about: the middle of all thresholds for it."""
    rules = I.numeric_rules(C.chunks(spark, d, "text"), "chunk_key", "text")
    usual = rules.groupBy("subject", "unit").agg(F.median("threshold").alias("value")).withColumn("fact", F.concat("subject", F.lit("/"), F.coalesce("unit", F.lit(""))))
    return I.rule_scores(usual, rules, "fact", "chunk_key")


@query("t33_directives", "T33", sql=f"""WITH {S.CHUNKS}, w AS (SELECT chunk_key, 'replace_words' AS kind, '(?i)in (rule|section|clause) ([0-9A-Za-z.]+), for the words "([^"]+)", the words "([^"]+)" shall be substituted' AS p, text FROM chunks)
SELECT chunk_key, kind, unnest(regexp_extract_all(text, '(?i)in (rule|section|clause) ([0-9A-Za-z.]+), for the words "([^"]+)", the words "([^"]+)" shall be substituted', 2)) AS target, unnest(regexp_extract_all(text, '(?i)in (rule|section|clause) ([0-9A-Za-z.]+), for the words "([^"]+)", the words "([^"]+)" shall be substituted', 3)) AS old, unnest(regexp_extract_all(text, '(?i)in (rule|section|clause) ([0-9A-Za-z.]+), for the words "([^"]+)", the words "([^"]+)" shall be substituted', 4)) AS new FROM w
UNION ALL SELECT chunk_key, 'replace_section', unnest(regexp_extract_all(text, '(?i)for (rule|section|clause) ([0-9A-Za-z.]+), the following shall be (?:substituted|replaced)', 2)), NULL, NULL FROM chunks
UNION ALL SELECT chunk_key, 'omit', unnest(regexp_extract_all(text, '(?i)(rule|section|clause) ([0-9A-Za-z.]+) shall be omitted', 2)), NULL, NULL FROM chunks""")
def t33_directives(spark, d):
    return I.directives(C.chunks(spark, d, "text"), "chunk_key", "text")


@query("t36_authority_status", "T34", "T35", "T36", sql=f"""WITH {S.CHUNKS}, x AS (SELECT chunk_key, document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_key) AS pos, regexp_matches(text, '(?i)shall be (substituted|replaced)') AS r, regexp_matches(text, '^[A-Z][A-Za-z ]+(Rules|Regulations|Act), (19|20)[0-9]{{2}}\\b') AS b FROM chunks),
y AS (SELECT *, max(CASE WHEN r THEN pos END) OVER o AS last, max(CASE WHEN b AND NOT r THEN pos END) OVER o AS edge FROM x WINDOW o AS (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT chunk_key, CASE WHEN r THEN 'current_explicit' WHEN last IS NULL THEN 'unknown' WHEN edge > last THEN 'historical_appended' WHEN pos - last <= 48 THEN 'current_replacement' ELSE 'unknown' END AS authority_status FROM y""")
def t36_authority_status(spark, d):
    rows = C.chunks(spark, d, "document_id", "chunk_index", "text")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_key")))
    return I.authority_status(rows, "document_id", "at", "text").select("chunk_key", "authority_status")


@query("t26_scope_labels", "T26", "T51", sql=f"""WITH {S.CHUNKS} SELECT chunk_key, array_to_string(list_sort(list_distinct(list_concat(
 list_transform(regexp_extract_all(text, '(?i)\\bline[- ]?0*([0-9]+)', 1), lambda n: 'LINE-' || n), list_transform(regexp_extract_all(text, '(?i)\\brs[- ]?0*([0-9]+)', 1), lambda n: 'RS-' || n)))), ',') AS scopes FROM chunks WHERE text IS NOT NULL""")
def t26_scope_labels(spark, d):
    return C.chunks(spark, d, "text").filter("text IS NOT NULL").select("chunk_key", F.array_join(I.scope_labels(c("text")), ",").alias("scopes"))


_STATE_LINE = f"' ' || array_to_string({S.tokens('text', '[a-z0-9]+|=')}, ' ') || ' '"
_STATE = {name: f"CASE regexp_extract(line, ' (?:{'|'.join(called)}) (?:(?:{'|'.join(P.LINKS)}) )?({'|'.join(v for v, _ in values)}) ', 1) {' '.join(f"WHEN '{v}' THEN '{name}={m}'" for v, m in values)} END" for name, (called, values) in P.EQUIPMENT.items()}


@query("t29_states", "T29", sql=f"WITH {S.CHUNKS}, l AS (SELECT chunk_key, {_STATE_LINE} AS line FROM chunks) SELECT chunk_key, array_to_string(list_filter([{', '.join(_STATE.values())}], lambda x: x IS NOT NULL), ',') AS states FROM l")
def t29_states(spark, d):
    return C.chunks(spark, d, "text").select("chunk_key", F.array_join(P.states(c("text")), ",").alias("states"))


@query("t63_durations", "T63", sql=f"WITH {S.CHUNKS}, x AS (SELECT chunk_key, regexp_extract(text, '([0-9]+) (minute|hour)s', 1) AS n, regexp_extract(text, '([0-9]+) (minute|hour)s', 2) AS u FROM chunks) SELECT chunk_key, CAST(n AS DOUBLE) * CASE u WHEN 'minute' THEN 60 ELSE 3600 END AS seconds FROM x WHERE n <> ''")
def t63_durations(spark, d):
    """The first duration that a chunk names, as a header would write it (`52m`, `18h`), in seconds."""
    p = r"([0-9]+) (minute|hour)s"
    short = F.concat(F.regexp_extract("text", p, 1), F.substring(F.regexp_extract("text", p, 2), 1, 1))
    return C.chunks(spark, d, "text").filter(c("text").rlike(p)).select("chunk_key", P.duration_seconds(short).alias("seconds"))


@query("t50_enumeration_bonus", "T50", sql=f"WITH {S.CHUNKS} SELECT chunk_key, CAST(CASE WHEN contains(lower(text), 'namely') AND contains(lower(text), 'following') THEN 0.16 WHEN contains(lower(text), 'namely') THEN 0.10 WHEN regexp_matches(lower(text), '(?s)\\bfollowing\\b.{{0,160}}\\b(are|include|includes|comprise|consist)') THEN 0.08 ELSE 0 END AS DOUBLE) AS bonus FROM chunks")
def t50_enumeration_bonus(spark, d):
    return C.chunks(spark, d, "text").select("chunk_key", P.enumeration_bonus(c("text")).alias("bonus"))


@query("l22_corruption", "L22", sql=f"""WITH {LINES}, x AS (SELECT page_id, trim(line) AS line, list_transform(regexp_extract_all(line, '[A-Za-z0-9]+'), lambda t: lower(t)) AS t FROM lines WHERE trim(line) <> ''),
y AS (SELECT page_id, line, len(t) AS n, CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(t, lambda w: length(w) <= 2)) / len(t) END AS short, CASE WHEN len(t) = 0 THEN 0 ELSE 1 - len(list_distinct(t)) / len(t) END AS again, length(line) - length(replace(line, '|', '')) AS bars FROM x),
z AS (SELECT *, n >= 6 AND (short >= 0.68 OR (short >= 0.52 AND again >= 0.34) OR (bars >= 4 AND short >= 0.55)) AS bad FROM y), g AS (SELECT page_id, count(*) FILTER (WHERE bad) AS bad, count(*) AS every, sum(n) FILTER (WHERE bad) AS bad_words, sum(n) AS words FROM z GROUP BY page_id)
SELECT page_id, round(CASE WHEN coalesce(bad, 0) >= 3 AND words > 0 THEN least(1.0, bad_words / words * 0.7 + bad / every * 0.3) ELSE 0 END, 6) AS score FROM pages LEFT JOIN g USING (page_id)""")
def l22_corruption(spark, d):
    return C.pages(spark, d).select("page_id", F.round(P.corruption(F.coalesce("text", F.lit(""))), 6).alias("score"))


@query("t60_ordered_tokens", "T60", sql=f"""WITH {S.CHUNKS}, w AS (SELECT chunk_key, {S.tokens('text', '[a-z0-9]+')} AS t, list_slice({S.tokens('heading', '[a-z]+')}, 1, 3) AS h FROM chunks WHERE heading IS NOT NULL),
a AS (SELECT *, list_position(t, h[1]) AS p1 FROM w WHERE len(h) = 3), b AS (SELECT *, list_position(t[p1 + 1:], h[2]) AS p2 FROM a), e AS (SELECT *, list_position(t[p1 + p2 + 1:], h[3]) AS p3 FROM b)
SELECT chunk_key, coalesce(p1 > 0 AND p2 > 0 AND p3 > 0, false) AS present FROM e""")
def t60_ordered_tokens(spark, d):
    """Do the first three words of a chunk's heading stand in its text, in their order?"""
    rows = C.chunks(spark, d, "text", "heading").filter("heading IS NOT NULL")
    rows = rows.select("chunk_key", T.tokens(c("text"), "[a-z0-9]+").alias("tokens"), F.slice(T.tokens(c("heading"), "[a-z]+"), 1, 3).alias("wanted")).filter(F.size("wanted") == 3)
    # A fold that carries how many of the wanted words were met.
    met = F.aggregate("tokens", F.lit(0), lambda n, t: F.when(t == F.get("wanted", n), n + 1).otherwise(n))
    return rows.select("chunk_key", (met == 3).alias("present"))


@query("f25_explicit_year", "F25", sql=f"""WITH {S.AUDIT}, x AS (SELECT id, list_transform(regexp_extract_all(question, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda y: CAST(y AS INT)) AS ys, regexp_replace(lower(question), '\\s+', ' ', 'g') AS q FROM audit WHERE question IS NOT NULL)
SELECT id, CAST(CASE WHEN len(ys) = 0 THEN NULL WHEN regexp_matches(q, '\\b(old|older|previous|prior|original|historical|superseded|before (the )?amendment)\\b') THEN CASE WHEN contains(q, 'before') THEN list_min(ys) ELSE list_max(ys) END
 WHEN regexp_matches(q, '\\b(current|latest|amended|amendment|revised|replacement)\\b') THEN NULL WHEN regexp_matches(q, '\\b(in|as of|during) (19|20)[0-9]{{2}}\\b') THEN list_max(ys) END AS VARCHAR) AS year FROM x""")
def f25_explicit_year(spark, d):
    return C.audit(spark, d).filter("question IS NOT NULL").select("id", T.explicit_year(c("question")).cast("string").alias("year"))

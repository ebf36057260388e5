"""The problems' queries, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.llm.bitslice_dedup import near_duplicates, record_pairs
from tarnwick.llm.label_propagation import subject_areas
from tarnwick.llm.learned_partitions import nearest
from tarnwick.llm.ocr_repair import Repair, repair_scans, scan_rows
from tarnwick.llm.pair_defects import pair_defects
from tarnwick.llm.rank_fusion import median_rank
from tarnwick.llm.repeated_lines import repeated_lines, without_repeated_chunks, without_repeated_lines
from tarnwick.llm.residual_packing import pack
from tarnwick.llm.source_mixing import mix
from tarnwick.llm.tokens import token_sizes
from tarnwick.llm.tree_split import split_oversized
from tarnwick.sources import load


# 1. One ranking from several scores
def _ranking(spark: SparkSession, folder: str) -> DataFrame:
    scores = ["score", "vector_score", "keyword_score"]
    return median_rank(load(spark, folder, "retrieved_chunk"), "qid", "chunk_key", scores, delivered="ingested_at")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking(spark, folder).filter("rank <= 3").select("qid", "chunk_key")


def p1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking(spark, folder)


# 2. Splitting oversized items
def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    settings = load(spark, folder, "chunk_settings")  # four rows
    rows = load(spark, folder, "text_chunk").join(F.broadcast(settings), "settings_profile")
    return split_oversized(rows, "chunk_key", "text", "chunk_size_chars", "chunk_overlap_chars", "section_path")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).filter("piece = 1").select("chunk_key")  # what is split has a second piece


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p2_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces: without overlaps they are the text, they fit, and overlap by as much as they should."""
    settings = F.broadcast(load(spark, folder, "chunk_settings"))
    profiles = load(spark, folder, "text_chunk").select("chunk_key", "settings_profile").distinct().join(settings, "settings_profile")
    pieces = _pieces(spark, folder).join(profiles, "chunk_key")
    lap = F.least("chunk_overlap_chars", F.floor(F.col("chunk_size_chars") / 2)).cast("int")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("piece", "piece_text", lap.alias("lap")))), lambda p: F.when(p["piece"] == 0, p["piece_text"]).otherwise(F.substr(p["piece_text"], p["lap"] + 1)))
    fits = F.max(F.col("end") - F.col("start")) <= F.first("chunk_size_chars")
    return pieces.groupBy("chunk_key").agg(F.md5(F.array_join(whole, "")).alias("rejoined"), fits.alias("fits"))


# 3. Broken pairs
def _defects(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects(load(spark, folder, "audit_logs"), "id", "question", "response", "ingested_at")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).filter("place = 1").select("id", "defect")


def p3_defects(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder)


# 4. Most similar vectors
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(load(spark, folder, "document_chunks"), "vec_key", "embedding", k=10, min_similarity=0.85)
    return near.select(F.least("vec_key", "neighbour").alias("key_a"), F.greatest("vec_key", "neighbour").alias("key_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(load(spark, folder, "document_chunks"), "vec_key", "embedding", k=10, queries="vec_key % 100 = 0")


# 5. Repeated lines
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(load(spark, folder, "page_text"), "filename", "page_id", "text").select("page_id", "line_no")


def p5_pages(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_lines(load(spark, folder, "page_text"), "filename", "page_id", "text")


def p5_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_chunks(load(spark, folder, "page_text"), "filename", "page_id", "text")


# 6. Near duplicates
def _links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(load(spark, folder, "text_chunk"), "chunk_key", "text", similarity=0.5, width=3)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return record_pairs(*_links(spark, folder), "chunk_key")


def p6_members(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder)[1]


# 7. Scanned pages
def _repair(spark: SparkSession, folder: str) -> Repair:
    pages = scan_rows(load(spark, folder, "page_text"), "page_text", "page_id", "filename", "text", "ocr_used", pages=True)
    chunks = scan_rows(load(spark, folder, "text_chunk"), "text_chunk", "chunk_key", "filename", "text", "ocr_used", pages=False)
    return repair_scans([pages, chunks])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _repair(spark, folder).found
    return found.select(F.col("table").alias("source_table"), F.col("key").alias("row_key"), "line_no", "kind", "word").distinct()


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _repair(spark, folder).repaired().withColumnsRenamed({"table": "source_table", "key": "row_key"})


# 8. Filling containers
def _containers(spark: SparkSession, folder: str) -> DataFrame:
    capacity = load(spark, folder, "pack_settings").select("capacity_tokens").first()[0]  # one row
    sizes = token_sizes(load(spark, folder, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", capacity)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _containers(spark, folder).filter("oversize AND piece = 0").select("doc_id")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _containers(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers: every text with tokens is in some, none is too full, and there are hardly more than needed."""
    rows = _containers(spark, folder).filter("container_id IS NOT NULL")
    bins = rows.groupBy("container_id").agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity"))
    per = bins.agg((F.max("size") <= F.max("capacity")).alias("none_too_full"), (F.count("*") <= F.ceil(F.sum("size") / F.max("capacity") * 1.02) + 1).alias("hardly_more_than_needed"))
    return rows.agg(F.countDistinct("doc_id").alias("documents")).crossJoin(per)  # a row each


# 9. Mixing sources
def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = token_sizes(load(spark, folder, "documents"), "doc_id", "text", "source")
    return mix(sizes, "doc_id", "source", "n_tokens", load(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix: shares of the sources that exist are as asked, but for a hundredth and one item; no item is used too often."""
    mixed, report = _mix(spark, folder)
    copies = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.max("size").alias("size")).groupBy("source").agg(F.max("n").alias("n"), F.max("last").alias("last"), F.max("size").alias("largest"))
    there = F.sum(F.when(F.col("size_available") > 0, F.col("target_share"))).over(Window.partitionBy())
    wanted = F.when(F.col("size_available") > 0, F.col("target_share") / there).otherwise(0.0)
    kept = report.withColumn("wanted", wanted).join(copies, "source", "left")
    every = Window.partitionBy()
    item = F.coalesce(F.max("largest").over(every) / F.nullif(F.sum("size_used").over(every), F.lit(0)), F.lit(0.0))
    close = F.abs(F.col("actual_share") - F.col("wanted")) <= item + 0.01
    often = (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("n", F.lit(0)) == F.coalesce("last", F.lit(0))) & (F.col("most_uses") == F.coalesce("n", F.lit(0)))
    return kept.select("source", "target_share", "max_repeats", close.alias("share_reached"), often.alias("repeats_kept"))


# 10. Subject areas
def _areas(spark: SparkSession, folder: str) -> DataFrame:
    return subject_areas(load(spark, folder, "documents"), "doc_id", "text", load(spark, folder, "subject_seed"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder).filter("main").select("doc_id", "subject")


def p10_areas(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder)


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Make-up of the corpus: documents and sentences of each area."""
    areas = _areas(spark, folder).filter("main")
    return areas.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"), F.round(F.sum("share"), 6).alias("document_weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    places = """
    WITH latest AS (
      SELECT qid, chunk_key, score, vector_score, keyword_score FROM (
        SELECT *, row_number() OVER (PARTITION BY qid, chunk_key ORDER BY ingested_at DESC) AS n FROM retrieved_chunk) WHERE n = 1
    ), placed AS (
      SELECT qid, chunk_key,
        CASE WHEN score IS NULL THEN count(*) OVER g ELSE rank() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST) END AS a,
        CASE WHEN vector_score IS NULL THEN count(*) OVER g ELSE rank() OVER (PARTITION BY qid ORDER BY vector_score DESC NULLS LAST) END AS b,
        CASE WHEN keyword_score IS NULL THEN count(*) OVER g ELSE rank() OVER (PARTITION BY qid ORDER BY keyword_score DESC NULLS LAST) END AS c
      FROM latest WINDOW g AS (PARTITION BY qid)
    ), ranked AS (
      SELECT *, CAST(a + b + c - greatest(a, b, c) - least(a, b, c) AS DOUBLE) AS m, round((a + b + c) / 3.0, 9) AS mean FROM placed
    ), final AS (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, mean, chunk_key) AS rank FROM ranked
    )
    """
    return {
        "p2_rejoined": "SELECT DISTINCT chunk_key, md5(text) AS rejoined, TRUE AS fits FROM text_chunk JOIN chunk_settings USING (settings_profile) WHERE length(text) > chunk_size_chars",
        "p4_found": """
    WITH vectors AS (
      SELECT vec_key, max(CAST(embedding AS DOUBLE[])) AS v FROM document_chunks WHERE embedding IS NOT NULL GROUP BY vec_key
    ), usable AS (SELECT vec_key, v FROM vectors WHERE list_dot_product(v, v) > 0),
    placed AS (
      SELECT a.vec_key AS a, b.vec_key AS b, list_cosine_similarity(a.v, b.v) AS s,
        row_number() OVER (PARTITION BY a.vec_key ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_key) AS n
      FROM usable a JOIN usable b ON a.vec_key <> b.vec_key
    )
    SELECT DISTINCT least(a, b) AS key_a, greatest(a, b) AS key_b FROM placed WHERE n <= 10 AND s >= 0.85
    """,
        "p6_found": """
    WITH texts AS (
      SELECT chunk_key, regexp_extract_all(lower(max(text)), '[\\p{L}\\p{N}]+') AS w FROM text_chunk GROUP BY chunk_key
    ), words AS (
      SELECT chunk_key, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM texts
    ), runs AS (
      SELECT chunk_key, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS s FROM words WINDOW o AS (PARTITION BY chunk_key ORDER BY i)
    ), shingles AS (SELECT DISTINCT chunk_key, s FROM runs WHERE s IS NOT NULL),
    sizes AS (SELECT chunk_key, count(*) AS n FROM shingles GROUP BY chunk_key),
    shared AS (
      SELECT a.chunk_key AS a, b.chunk_key AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.chunk_key < b.chunk_key GROUP BY ALL
    )
    SELECT a AS key_a, b AS key_b FROM shared JOIN sizes x ON x.chunk_key = a JOIN sizes y ON y.chunk_key = b WHERE shared.n >= 0.5 * (x.n + y.n - shared.n)
    """,
        "p8_fill": "SELECT count(DISTINCT doc_id) AS documents, TRUE AS none_too_full, TRUE AS hardly_more_than_needed FROM documents WHERE length(text) > 0",
        "p9_kept": "SELECT source, target_share, max_repeats, TRUE AS share_reached, TRUE AS repeats_kept FROM mix_targets",
        "p5_found": """
    WITH pages AS (
      SELECT page_id, max(filename) AS filename, max(text) AS text FROM page_text WHERE filename IS NOT NULL GROUP BY page_id
    ), split AS (
      SELECT page_id, filename, string_split(text, chr(10)) AS parts FROM pages
    ), lines AS (
      SELECT page_id, filename, unnest(range(1, len(parts) + 1)) AS n, lower(regexp_replace(unnest(parts), '[^\\p{L}]+', '', 'g')) AS line FROM split WHERE len(parts) > 0
    ), totals AS (SELECT filename, count(*) AS pages FROM pages GROUP BY filename),
    often AS (
      SELECT filename, line FROM lines JOIN totals USING (filename) WHERE line <> '' GROUP BY filename, line, pages
      HAVING count(DISTINCT page_id) >= 4 AND count(DISTINCT page_id) >= 0.3 * pages
    )
    SELECT page_id, CAST(n AS INTEGER) AS line_no FROM lines JOIN often USING (filename, line)
    """,
        "p1_found": places + "SELECT qid, chunk_key FROM final WHERE rank <= 3",
        "p1_ranking": places + "SELECT qid, chunk_key, a AS place_score, b AS place_vector_score, c AS place_keyword_score, m AS median_place, mean AS mean_place, rank FROM final",
        "p2_found": "SELECT DISTINCT chunk_key FROM text_chunk JOIN chunk_settings USING (settings_profile) WHERE length(text) > chunk_size_chars",
    }

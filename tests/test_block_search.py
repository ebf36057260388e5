"""Keyword search over blocks, held against the joins of postings and SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import block_search as K
from tarnwick.operators import ranking as R
from tarnwick.queries.registry import load_core
from tests.compare import rows

SMALL = "/root/testdata/sf0.001"
QUERIES = load_core()


def plan(df):
    return df._jdf.queryExecution().toString()


def pairs_of_terms(df):
    """Joins of queries with postings, which write a row for each term that a query and a chunk share."""
    return [line for line in plan(df).splitlines() if "Join [term" in line or "Join [word" in line]


def test_best_rows_equal_those_of_the_joins(spark):
    """Ties go by key; more chunks than are kept, in several blocks; a query of unknown words has no rows."""
    words = ["brake", "door", "lamp", "motor", "relay", "valve", "gate"]
    texts = [(k, " ".join(words[(k * n) % 7] for n in range(1, 2 + k % 5))) for k in range(400)]
    chunks = spark.createDataFrame(texts, "key long, text string").repartition(5)
    asked = spark.createDataFrame([("a", "brake", 1.0), ("a", "gate", 0.5), ("b", "valve", 2.0), ("b", "nowhere", 1.0), ("c", "nothing", 1.0)], "qid string, term string, weight double")
    made, frequency, total = K.blocks(chunks, "key", T.bm25_tokens(F.col("text")))
    assert made.count() > 1
    found = K.search(made, K.weigh(asked, frequency, total), "key", 30)
    expected = R.bm25(R.postings(chunks, "key", T.bm25_tokens(F.col("text"))), asked, "key", total, 30)
    told = lambda df: sorted((r.qid, r.key, round(r.bm25, 9)) for r in df.collect())
    assert len(told(found)) == 60 and told(found) == told(expected)


@pytest.mark.parametrize("name", ["r24_hybrid_chunk_search", "r1_bm25_top", "r7_corpus_scan", "r9_corpus_scan", "r5_five_arm_blend", "f5_prefix_or"])
def test_no_row_for_each_shared_term(spark, name):
    assert not pairs_of_terms(QUERIES[name].run(spark, SMALL))


@pytest.mark.parametrize(("name", "joins"), [("r1_keyword_quality", 0), ("r2_hybrid_fuse", 1)])
def test_no_row_for_each_raw_pair(spark, name, joins):
    """Phrases are not joined to all pairs of a query and a chunk; the vectors are joined to the best alone."""
    assert sum("Join [qid" in line and "chunk_key" in line for line in plan(QUERIES[name].run(spark, SMALL)).splitlines()) == joins


def test_phrases_cut_words_at_their_ends(spark, tmp_path):
    texts = ["An uncoupled wheelset coupledness", "Coupled wheelset, coupled", "coupled wheelset", "of the wheelset", None]
    spark.createDataFrame(list(enumerate(texts)), "chunk_key long, text string").write.parquet(f"{tmp_path}/text_chunk.parquet")
    asked = [("a", ["coupled wheelset coupled", "wheelset"], ["brake"]), ("b", ["the wheel"], []), ("c", ["wheelsat"], None)]
    spark.createDataFrame(asked, "qid string, search_queries array<string>, concepts array<string>").write.parquet(f"{tmp_path}/query_plans.parquet")
    con = duckdb.connect()
    for name in ("text_chunk", "query_plans"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    q = QUERIES["r1_keyword_quality"]
    found = rows(q.run(spark, str(tmp_path)).toPandas())
    assert len(found) > 4 and found == rows(con.execute(q.sql).df())

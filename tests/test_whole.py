"""Results of whole tables, held against SQL of the whole job; the twins of some of these queries have cuts."""

import pytest

from tarnwick.functions import words as W
from tarnwick.queries import registry_sql as S
from tarnwick.queries.q_rank import INDEX_SQL
from tarnwick.queries.registry import load_core
from tests.compare import connect, rows

SMALL = "/root/testdata/sf0.001"
QUERIES = load_core()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_keyword_scores_of_all_candidates(spark, duck):
    """Every candidate with a keyword has its keyword part, whatever its place in the collection."""
    expected = duck.execute(f"""WITH {INDEX_SQL}, {S.CANDIDATES}
        SELECT qid, chunk_key, round(bm25 / (bm25 + 4.0), 6) AS kw FROM scored JOIN candidates USING (qid, chunk_key)""").df()
    from tarnwick.queries.q_more import _blend

    found = _blend(spark, SMALL).filter("kw > 0").selectExpr("qid", "chunk_key", "round(kw, 6) AS kw").toPandas()
    assert len(expected) > 50 and rows(found) == rows(expected)


def test_five_arms(spark, duck):
    """R5 with its phrase, section and floor; R6 under the stemmer."""
    n, words = S.canonical_phrase("question"), "len(string_split(n, ' ')) >= 2"
    stems = lambda text: f"list_transform({S.bm25_tokens(text)}, lambda t: {S.stem('t', W.STEM_V5)})"
    stemmed = INDEX_SQL.replace(S.bm25_tokens("text"), stems("text")).replace(S.bm25_tokens("question"), stems("question"))
    plain = f"""WITH {INDEX_SQL}, {S.CANDIDATES}, parts AS (SELECT chunk_key, {S.canonical_phrase('x')} AS p FROM (SELECT chunk_key, unnest(section_path) AS x FROM chunks)),
        a AS (SELECT qid, chunk_key, coalesce(vector_score, 0) AS v, coalesce(bm25 / (bm25 + 4.0), 0) AS kw, {S.terms_smart('question')} AS q, {S.terms_smart('text')} AS b, {n} AS n, {S.canonical_phrase('text')} AS t
          FROM candidates LEFT JOIN scored USING (qid, chunk_key) JOIN query_plans USING (qid) JOIN chunks USING (chunk_key)),
        s AS (SELECT qid, chunk_key, max(CASE WHEN p = '' OR length(n) < 3 THEN 0 WHEN p = n THEN 1 WHEN {words} AND contains(' ' || p || ' ', ' ' || n || ' ') THEN 0.88
          WHEN {words} AND contains(' ' || n || ' ', ' ' || p || ' ') THEN 0.72 ELSE 0 END) AS section FROM a JOIN parts USING (chunk_key) GROUP BY ALL)
        SELECT qid, chunk_key, v, kw, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(q) END AS lex, CASE WHEN length(n) >= 4 AND contains(t, n) THEN 1 ELSE 0 END AS phrase, CAST(coalesce(section, 0) AS DOUBLE) AS section FROM a LEFT JOIN s USING (qid, chunk_key)"""
    other = f"WITH {stemmed}, {S.CANDIDATES} SELECT qid, chunk_key, bm25 / (bm25 + 4.0) AS kw FROM scored JOIN candidates USING (qid, chunk_key)"
    expected = duck.execute(f"""WITH x AS (SELECT *, least(1.0, greatest(0.0, v * 0.36 + kw * 0.24 + lex * 0.18 + phrase * 0.10 + section * 0.12)) AS blend FROM ({plain}))
        SELECT qid, chunk_key, round(CASE WHEN section > 0 THEN greatest(blend, 0.78 + section * 0.18) ELSE blend END + 1e-10, 6) AS score, round(least(0.93, 0.36 + 0.38 * coalesce(o.kw, 0) + 0.20 * lex), 6) AS stemmed
        FROM x LEFT JOIN ({other}) o USING (qid, chunk_key)""").df()
    found = QUERIES["r5_five_arm_blend"].run(spark, SMALL).toPandas()
    assert rows(found) == rows(expected)


def test_section_sets_a_floor(spark):
    from tarnwick.queries.q_more import _five_arms

    given = [(1, 0.1, 0.0, 0.0, 0.0, 0.88), (2, 0.1, 0.0, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 1.0, 1.0, 1.0)]
    found = spark.createDataFrame(given, "id int, v double, kw double, lex double, phrase double, section double").select("id", _five_arms().alias("s")).collect()
    assert {r.id: round(r.s, 6) for r in found} == {1: 0.9384, 2: 0.136, 3: 1.0}


def test_long_texts_are_read_to_their_end(spark, tmp_path):
    """Terms and phrases after character 12,000 count in lexical coverage and phrase match."""
    import datetime as dt

    at, path = dt.datetime(2026, 1, 1), str(tmp_path)
    text = "filler word " * 1100 + "pantograph interlock"
    write = lambda name, row, kind: spark.createDataFrame([row], kind).write.parquet(f"{path}/{name}.parquet")
    write("text_chunk", (1, text, ["1. Pantograph interlock"], at), "chunk_key long, text string, section_path array<string>, created_at timestamp")
    write("query_plans", ("q1", "pantograph interlock"), "qid string, question string")
    write("retrieved_chunk", ("q1", 1, 0.5, at), "qid string, chunk_key long, vector_score double, ingested_at timestamp")
    lexical = QUERIES["t10_weighted_lexical"].run(spark, path).collect()
    assert [(r.lexical, r.weighted) for r in lexical] == [(1.0, 1.0)]
    assert QUERIES["t11_phrase_match"].run(spark, path).first().match
    from tarnwick.queries.q_more import _blend

    assert _blend(spark, path).first().lex == 1.0


def test_and_asks_for_every_term(spark, tmp_path):
    """F4 asks for six terms and gives table rows first; F6 asks for five."""
    import datetime as dt

    at, path, words = dt.datetime(2026, 1, 1), str(tmp_path), ["brake", "door", "lamp", "motor", "relay", "valve"]
    texts = [" ".join(words), " ".join(words[:5]), " ".join(words[:3]), " ".join(words)]
    kinds = ["text", "text", "text", "table_row"]
    chunks = [(k + 1, t, kinds[k], "a.pdf", 1, k, at) for k, t in enumerate(texts)]
    spark.createDataFrame(chunks, "chunk_key long, text string, content_type string, filename string, page_number int, chunk_index int, created_at timestamp").write.parquet(f"{path}/text_chunk.parquet")
    spark.createDataFrame([("q1", " ".join(words))], "qid string, question string").write.parquet(f"{path}/query_plans.parquet")
    assert [r.chunk_key for r in QUERIES["f4_exact_and"].run(spark, path).collect()] == [4, 1]
    assert sorted(r.chunk_key for r in QUERIES["f6_boolean_and"].run(spark, path).collect()) == [1, 2, 4]


@pytest.mark.parametrize(("name", "most"), [("f4_exact_and", 6), ("f6_boolean_and", 5)])
def test_and_over_whole_tables(spark, duck, name, most):
    sql = QUERIES[name].sql.replace("1, 3)", f"1, {most})")
    if name == "f4_exact_and":
        sql = sql.replace("contains(lower(text), t[3]))", "contains(lower(text), t[3]))" + "".join(f" AND (len(t) < {n} OR contains(lower(text), t[{n}]))" for n in range(4, most + 1)))
    assert rows(QUERIES[name].run(spark, SMALL).toPandas()) == rows(duck.execute(sql).df())

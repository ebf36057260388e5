"""Ranking, fusion, selection: candidates in, candidates out, for a whole batch of queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import cut_lineage

K1, B = 1.5, 0.75  # fixed values of the keyword score
RRF = 60.0


def canonical_order(score: str = "score") -> list[Column]:
    """Score, then file name in lower case, page, position (none: -1) and id."""
    return [F.col(score).desc_nulls_last(), F.lower("filename").asc_nulls_last(), F.col("page_number").asc_nulls_last(), F.coalesce("chunk_index", F.lit(-1)), F.col("chunk_id")]


def postings(chunks: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, key, tf, dl): the inverted index; dl is the length of the chunk in tokens."""
    rows = chunks.select(key, terms.alias("terms")).withColumn("dl", F.size("terms"))
    return rows.select(key, "dl", F.explode("terms").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, asked: DataFrame, key: str, total: DataFrame, most: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, key, bm25, matched): keyword scores of chunks for queries given as (qid, term, weight).

    `total` is one row (chunks, avgdl). Only terms that are asked leave the index: the document frequencies and
    the scores are computed behind a semi-join. `most` keeps the best of each query. `pairs` of (qid, key) are
    scored alone, each of them that has a term; frequencies stay those of all chunks.
    """
    wanted = asked.select("term").distinct()
    used = cut_lineage(index.join(wanted, "term", "left_semi"))  # the texts are read once for both uses
    frequency = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(frequency, "term").join(F.broadcast(total)).select("qid", "term", (F.col("weight") * idf).alias("w"), "weight", "avgdl")  # total: one row
    part = F.col("w") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))))
    met = used.join(weighed, "term") if pairs is None else used.join(pairs.select("qid", key).join(weighed, "qid"), ["term", key])
    scores = met.groupBy("qid", key).agg(F.sum(part).alias("bm25"), F.sum("weight").alias("matched"))
    if most is None:
        return scores
    order = Window.partitionBy("qid").orderBy(F.round("bm25", 9).desc(), key)
    return scores.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def cosine(a: Column, b: Column) -> Column:
    """Similarity of arrays of doubles, not below 0; null where one of them has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(F.lit(0.0), dot(a, b) / F.when(norm > 0, norm))


def rank_in(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def top_in(df: DataFrame, groups: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` of each group; Spark limits each group before the shuffle."""
    return rank_in(df, groups, order, "_n").filter(F.col("_n") <= most).drop("_n")


def reciprocal_ranks(arms: DataFrame, keys: Sequence[str], score: str = "arm_score") -> DataFrame:
    """(keys..., rrf, methods): arms is (keys..., arm, score); ranks are 1-based within each query and arm."""
    qid, *rest = keys
    ranked = rank_in(arms, [qid, "arm"], [F.col(score).desc_nulls_last(), *rest], "rank")
    summed = ranked.groupBy(*keys).agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("arm")).alias("methods"))
    return summed.withColumn("rrf", F.col("rrf") / F.max("rrf").over(Window.partitionBy(qid)))


def fuse_two(vector: Column, keyword: Column) -> Column:
    """0.82 of the better score, 0.18 of the lesser, 0.04 if both arms agree."""
    v, k = F.coalesce(vector, F.lit(0.0)), F.coalesce(keyword, F.lit(0.0))
    agree = F.when((v > 0) & (k > 0), 0.04).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(v, k) * 0.82 + F.least(v, k) * 0.18 + agree)


def squash(rank: Column, half: float = 0.18) -> Column:
    """An unbounded keyword rank brought to [0, 1)."""
    return rank / (rank + half)


def merge_best(df: DataFrame, keys: Sequence[str], score: str, method: str) -> DataFrame:
    """One row for each key: the best score, with up to 0.06 for agreement of methods, whatever the order of rows."""
    merged = df.groupBy(*keys).agg(F.max(score).alias("_best"), F.array_sort(F.collect_set(method)).alias("methods"))
    bonus = F.least(F.lit(0.06), (F.size("methods") - 1) * 0.015)
    return merged.select(*keys, F.least(F.lit(1.0), F.col("_best") + bonus).alias(score), F.slice("methods", 1, 6).alias("methods"))


def soft_cap(df: DataFrame, query: str, document: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The best `limit`, but no document more than max(8, limit / 5) before the others are used up."""
    cap = max(8, limit // 5)
    ranked = rank_in(rank_in(df, [query, document], order, "in_document"), [query], order, "overall")
    over = (F.col("in_document") > cap).cast("int")
    chosen = rank_in(ranked, [query], [over, F.col("overall")], "place").filter(F.col("place") <= limit)
    return chosen.drop("in_document", "overall")


def strength_then_diverse(df: DataFrame, query: str, document: str, order: Sequence[Column], limit: int, share: float = 0.5) -> DataFrame:
    """The strongest `share` of the slots, then the best of documents not seen yet, then the rest."""
    strong = max(1, int(limit * share))
    ranked = rank_in(df, [query], order, "overall")
    seen = F.max(F.when(F.col("overall") <= strong, 1).otherwise(0)).over(Window.partitionBy(query, document))
    first = F.row_number().over(Window.partitionBy(query, document).orderBy("overall"))
    tier = F.when(F.col("overall") <= strong, 0).when((F.col("_seen") == 0) & (F.col("_first") == 1), 1).otherwise(2)
    tiered = ranked.withColumn("_seen", seen).withColumn("_first", first).withColumn("_tier", tier)
    chosen = rank_in(tiered, [query], [F.col("_tier"), F.col("overall")], "_place").filter(F.col("_place") <= limit)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("overall"))).drop("_seen", "_first", "_tier", "_place", "overall")


def round_robin(df: DataFrame, query: str, document: str, order: Sequence[Column], score: str, per_document: int, limit: int) -> DataFrame:
    """Depth first over documents, those with the best row first."""
    ranked = rank_in(df, [query, document], order, "in_document").filter(F.col("in_document") <= per_document)
    best = F.max(score).over(Window.partitionBy(query, document))
    ranked = ranked.withColumn("_best", best)
    chosen = rank_in(ranked, [query], [F.col("in_document"), F.col("_best").desc(), F.col(document), *order], "place")
    return chosen.filter(F.col("place") <= limit).drop("_best")


def half_fill_cap(df: DataFrame, query: str, document: str, order: Sequence[Column], limit: int, cap: int) -> DataFrame:
    """A cap on each document that holds only after half of the limit is filled."""
    ranked = rank_in(rank_in(df, [query, document], order, "in_document"), [query], order, "overall")
    kept = ranked.filter((F.col("overall") <= limit // 2) | (F.col("in_document") <= cap))
    return rank_in(kept, [query], [F.col("overall")], "place").filter(F.col("place") <= limit).drop("overall", "in_document")


def relevance_cutoff(df: DataFrame, query: str, score: str, least: float = 0.10, relative: float = 0.32, weak: float = 0.08) -> DataFrame:
    """Rows near enough to the best of their query; none where the best is weak."""
    best = F.max(score).over(Window.partitionBy(query))
    return df.withColumn("_best", best).filter((F.col("_best") >= weak) & (F.col(score) >= F.greatest(F.lit(least), F.col("_best") * relative))).drop("_best")

"""Boolean, phrase, prefix and fuzzy search as equi-joins over postings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import block_search as K
from tarnwick.session import cut_lineage


def _rarest(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, term): of each query's terms the one that the fewest rows of `found` (term, n) have; none where a term is nowhere."""
    wanted = asked.filter(F.size("terms") > 0).select("qid", F.explode("terms").alias("term"))
    counted = wanted.join(found, "term", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r"))
    return counted.filter("r.n > 0").select("qid", "r.term")


def all_terms(asked: DataFrame, chunks: DataFrame, key: str, terms: Column) -> DataFrame:
    """(qid, key) of chunks with every term of a query; `asked` is (qid, terms).

    Only chunks with a query's rarest term are candidates; the others of its terms are then looked for in these alone.
    """
    split = cut_lineage(chunks.select(key, F.array_distinct(terms).alias("has")))  # texts are analysed once
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    index = cut_lineage(split.select(key, F.explode("has").alias("term")).join(wanted, "term", "left_semi"))
    rarest = _rarest(asked, index.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    met = rarest.join(index, "term").select("qid", key).join(asked, "qid").join(split, key)
    return met.filter(F.size(F.array_except("terms", "has")) == 0).select("qid", key)


def prefix_matches(asked: DataFrame, chunks: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """(qid, key, matched): how many terms of (qid, term) a chunk has, at least `least`; terms of more than three letters as prefixes.

    Words of the corpus meet the terms once, as a vocabulary, by their first four letters, and only then their chunks, in blocks.
    """
    words = F.array_distinct(T.tokens(F.col(text), "[a-z0-9]+"))
    vocabulary = chunks.select(F.explode(words).alias("word")).distinct().withColumn("start", F.substring("word", 1, 4))
    terms = asked.select("term").distinct().withColumn("start", F.substring("term", 1, 4))
    stands = F.when(F.length("term") > 3, F.startswith("word", F.col("term"))).otherwise(F.col("word") == F.col("term"))
    met = terms.join(vocabulary, "start").filter(stands).groupBy("term").agg(F.array_sort(F.collect_list(F.xxhash64("word"))).alias("words"))  # of one term
    queries = asked.distinct().join(met, "term").groupBy("qid").agg(F.collect_list("words").alias("words"))  # one query's terms
    return K.matches(K.blocks(chunks, key, words)[0], queries, key, least)


def all_substrings(asked: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(qid, key) of chunks whose text contains each of the terms anywhere, also within words.

    A term without blanks lies within a word: distinct words meet distinct terms through the term's first
    three letters, at every place of a word where they stand. Only chunks with a query's rarest term are
    candidates; whether they contain the others is read in their texts.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    index = cut_lineage(chunks.select(key, F.explode(F.array_distinct(words)).alias("word")).filter(F.length("word") >= 3))  # texts are read once for it
    vocabulary = index.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    grams = vocabulary.select("word", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda n: F.substring(F.col("word"), n, F.lit(3))))).alias("gram"))
    terms = asked.select(F.explode("terms").alias("term")).distinct().withColumn("gram", F.substring("term", 1, 3))
    within = cut_lineage(terms.join(grams, "gram").filter(F.contains(F.col("word"), F.col("term"))).select("term", "word", "n"))
    rarest = _rarest(asked, within.groupBy("term").agg(F.sum("n").alias("n")))
    met = rarest.join(within.select("term", "word"), "term").join(index, "word").select("qid", key).distinct()
    lowered = chunks.select(key, F.lower(F.col(text)).alias("_text"))
    both = met.join(asked, "qid").join(lowered, key)
    return both.filter(F.forall("terms", lambda t: F.contains(F.col("_text"), t))).select("qid", key)


def web_search(query: str, text: Column) -> Column:
    """A query as people type it: words are required, `or` gives a choice, "phrases" stand together, -words must not occur."""
    words = T.tokens(text, "[a-z0-9]+")
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    groups: list[list[Column]] = []
    alternative = False
    for phrase, negated, word in re.findall(r'"([^"]+)"|(-?)([^\s"]+)', query):
        if word.lower() == "or" and not negated:
            alternative = bool(groups)
            continue
        parts = re.findall(r"[a-z0-9]+", (phrase or word).lower())
        if not parts:
            continue
        test = F.contains(line, F.lit(f" {' '.join(parts)} "))
        test = ~test if negated else test
        if alternative:
            groups[-1].append(test)
        else:
            groups.append([test])
        alternative = False
    tests = [reduce(lambda a, b: a | b, g) for g in groups]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def contained_phrases(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(key, phrase): phrases that stand in a text as whole words, met through their first word."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(T.tokens(c, "[a-z0-9]+"), " "), F.lit(" "))
    texts = df.select(key, line(F.col(text)).alias("_line"), F.explode(F.array_distinct(T.tokens(F.col(text), "[a-z0-9]+"))).alias("_word"))
    wanted = phrases.select(phrase, line(F.col(phrase)).alias("_phrase"), F.get(T.tokens(F.col(phrase), "[a-z0-9]+"), F.lit(0)).alias("_word"))
    return wanted.filter(F.col("_word").isNotNull()).join(texts, "_word").filter(F.contains(F.col("_line"), F.col("_phrase"))).select(key, phrase)


def fuzzy_matches(unknown: DataFrame, known: DataFrame, word: str, edits: int) -> DataFrame:
    """(token, candidate, distance): words with the same first letter, nearly the same length, few edits apart.

    They meet through what is left of them after deleting up to `edits` letters, which words so near share.
    """
    if edits != 1:
        raise ValueError("deletions of one letter are what the join is built on")

    def keys(df: DataFrame, name: str) -> DataFrame:
        w = F.col(word)
        cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.concat(F.substring(w, F.lit(1), n - 1), F.substring(w, n + 1, F.length(w))))
        return df.select(w.alias(name), F.explode(F.array_distinct(F.concat(F.array(w), cut))).alias("_key"))

    met = keys(unknown, "token").join(keys(known, "candidate"), "_key").select("token", "candidate").distinct()
    met = met.withColumn("distance", F.levenshtein("token", "candidate"))
    return met.filter((F.col("distance") <= edits) & (F.substring("token", 1, 1) == F.substring("candidate", 1, 1)))

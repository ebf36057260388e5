"""Keyword scores with whole phrases and the weight met, over blocks of chunks that also hold their texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import bounded
from tarnwick.operators import block_search as K
from tarnwick.session import cut_lineage, shuffle_partitions

#: Chunks of a block, and letters of their texts.
BLOCK, BLOCK_LETTERS = 1 << 14, 1 << 24
_BLOCK = "keys binary, absent binary, lengths binary, terms binary, starts binary, places binary, counts binary, marks binary, mark_starts binary, mark_places binary, words array<string>, texts array<string>"
_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def blocks(chunks: DataFrame, key: str, text: str, terms: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks, written once, with (hash, df) and one row (chunks, avgdl) of the terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in bounded([whole], "text", BLOCK_LETTERS):
                for start in range(0, piece.num_rows, BLOCK):
                    yield block(piece.slice(start, BLOCK))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = batch.column("key")
        values, lengths = K._items(batch.column("terms"))
        found, starts, places, counts = K._postings(values, lengths)
        small = np.uint8 if counts.max(initial=0) < 256 else np.int32
        listed = batch.column("words")
        coded = listed.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        order = sorted(range(len(words)), key=words.__getitem__)
        ranks = np.empty(len(words), np.int64)
        ranks[order] = np.arange(len(words))
        marked = K._postings(ranks[coded.indices.to_numpy()], pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64))
        parts = [pc.fill_null(key, 0).to_numpy().astype(np.int64), pc.is_null(key).to_numpy(zero_copy_only=False), lengths.astype(np.int32), found, starts.astype(np.int32), places.astype(np.uint16), counts.astype(small)]
        parts += [marked[0], marked[1].astype(np.int32), marked[2].astype(np.uint16)]
        lists = [pa.array([[words[n] for n in order]], pa.list_(pa.string())), pa.array([batch.column("text").to_pylist()], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(pa.array([p.tobytes()], pa.binary()) for p in parts), *lists], _NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int32)
                yield K._counted(np.frombuffer(row["terms"], np.int64), np.diff(np.frombuffer(row["starts"], np.int32)), len(lengths), int(lengths.sum()))

    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = chunks.select(F.col(key).cast("long").alias("key"), K.hashed(terms).alias("terms"), F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))).alias("words"), lowered.alias("text"))
    made = cut_lineage(rows.mapInArrow(build, _BLOCK))
    return made, *K._summed(made.select("lengths", "terms", "starts").mapInArrow(count, K._COUNTED))


class _Texts(K._Block):
    """A block in which phrases are looked for."""

    def __init__(self, row: dict, batch: pa.RecordBatch, at: int):
        super().__init__(row)
        self.batch, self.at = batch, at
        self.words: list[str] | None = None
        self.of_word: dict[tuple[str, bool, bool], np.ndarray] = {}
        self.of_phrase: dict[str, np.ndarray] = {}

    def _having_word(self, word: str, cut_before: bool, cut_after: bool) -> np.ndarray:
        """Places of a word that may be the end or the start, or both, of a longer one."""
        name = (word, cut_before, cut_after)
        if name not in self.of_word:
            if cut_before and cut_after:
                found = [n for n, w in enumerate(self.words) if word in w]
            elif cut_before:
                at = bisect_left(self.turned, (word[::-1],))
                found = []
                while at < len(self.turned) and self.turned[at][0].startswith(word[::-1]):
                    found.append(self.turned[at][1])
                    at += 1
            else:
                at = bisect_left(self.words, word)
                found = []
                while at < len(self.words) and (self.words[at].startswith(word) if cut_after else self.words[at] == word):
                    found.append(at)
                    at += 1
            self.of_word[name] = np.unique(np.concatenate([np.empty(0, np.intp), *(self.mark(n) for n in found)]))
        return self.of_word[name]

    def having_phrase(self, phrase: str) -> np.ndarray:
        """Places whose text contains the phrase anywhere: its words are looked up, those at its ends as parts of words, then it is read."""
        if phrase not in self.of_phrase:
            if self.words is None:
                self.words, self.texts = (self.batch.column(x)[self.at].as_py() for x in ("words", "texts"))
                self.turned = sorted((w[::-1], n) for n, w in enumerate(self.words))
            met = [(m.group(), m.start() == 0, m.end() == len(phrase)) for m in re.finditer("[a-z0-9]+", phrase)]
            every = sorted((self._having_word(*x) for x in dict.fromkeys(met) if len(x[0]) > 2 or not (x[1] or x[2])), key=len)
            places = every[0] if every else np.arange(len(self.keys))
            for own in every[1:]:
                if len(places):
                    places = places[own[np.minimum(np.searchsorted(own, places), len(own) - 1)] == places]
            self.of_phrase[phrase] = np.array([p for p in places.tolist() if phrase in self.texts[p]], np.intp)
        return self.of_phrase[phrase]


def _met(made: DataFrame, queries: DataFrame, work, schema: str) -> DataFrame:
    """Every group of queries with every block, one after another in one task; `work` makes rows of the pairs at the end."""
    kind = queries.schema["qid"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.concat_batches(held)
            names = [x for x in rows.schema.names if x != "qid"]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(x)) for x in ("qid", *names)], ["ids", *(f"_{x}" for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, state = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if ids is None:  # one group of queries in a task
                    ids = batch.column("ids").slice(i, 1).flatten()
                    asked = {x[1:]: batch.column(x)[i].as_py() for x in batch.schema.names if x[0] == "_"}
                    asked["at"] = np.concatenate([[0], np.cumsum([len(x) for x in asked["terms"]])]).tolist()
                    asked["flat"] = np.array([t for x in asked["terms"] for t in x], np.int64)
                row = {x: batch.column(x)[i].as_py() for x in _NAMES[:-2]}
                work(_Texts(row, batch, i), asked, state)
        if ids is not None:
            yield from state["rows"](ids)

    types = ", ".join(f"_{x.name} array<{x.dataType.simpleString()}>" for x in queries.schema if x.name != "qid")
    groups = queries.repartition(shuffle_partitions(made.sparkSession), F.xxhash64("qid")).mapInArrow(pack, f"ids array<{kind}>, {types}")
    return made.coalesce(1).hint("shuffle_replicate_nl").crossJoin(cut_lineage(groups)).mapInArrow(run, f"qid {kind}, {schema}")


def _scores(block: _Texts, asked: dict, with_met: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query with a row in the block: its number, the keyword score with 1 for a phrase, and the weight met if it is asked for."""
    at = block.find(block.terms, asked["flat"]).tolist()
    norm = K.K1 * (1 - K.B + K.B * block.lengths / max(max(asked["avgdl"]), 1.0))
    scores, met = np.zeros(len(block.keys)), np.zeros(len(block.keys))
    for q, begin in enumerate(asked["at"][:-1]):
        scores.fill(0.0)
        met.fill(0.0)
        for n, (weight, own) in enumerate(zip(asked["weights"][q], asked["own"][q]), begin):
            if at[n] >= 0:
                places, part = block.part(at[n], norm)
                scores[places] += part * weight
                if own and with_met:
                    met[places] += own
        phrases = [block.having_phrase(x) for x in asked["phrases"][q] or ()]
        if any(map(len, phrases)):
            places = np.unique(np.concatenate(phrases))
            scores[places[scores[places] > 0]] += 1.0
        yield q, scores, met


def quality(made: DataFrame, queries: DataFrame, key: str, most: int) -> DataFrame:
    """(qid, key, keyword): the best `most` of each query by 0.65 of the score over the best, and 0.35 of the weight met.

    `queries` is (qid, terms, weights, own, all_w, avgdl, phrases). What the best score is must be known first, so the blocks are met twice.
    """

    def highest(block: _Texts, asked: dict, state: dict) -> None:
        best = state.setdefault("best", np.zeros(len(asked["terms"])))
        state["rows"] = lambda ids: [pa.RecordBatch.from_arrays([ids, pa.array(best)], ["qid", "best"])]
        for q, scores, _ in _scores(block, asked, False):
            best[q] = max(best[q], scores.max(initial=0.0))

    def kept(block: _Texts, asked: dict, state: dict) -> None:
        held = state.setdefault("held", [K._Best(most) for _ in asked["terms"]])
        state["rows"] = lambda ids: rows(ids, held)
        nothing = lambda places: np.zeros((len(places), 2), np.int32)
        for q, scores, met in _scores(block, asked, True):
            places = np.flatnonzero(scores > 0)
            keyword = np.minimum(1.0, scores[places] / asked["best"][q] * 0.65 + np.minimum(1.0, met[places] / asked["all_w"][q]) * 0.35)
            near = keyword >= held[q].least - K.NEAR
            if near.any():
                held[q].add(block, places[near], keyword[near], nothing)

    def rows(ids: pa.Array, held: list) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(held), 1000):
            some = held[start : start + 1000]
            at = np.repeat(np.arange(len(some)), [len(b.scores) for b in some])
            columns = [ids.slice(start, 1000).take(pa.array(at)), pa.array(np.concatenate([b.keys for b in some]), mask=np.concatenate([b.absent for b in some])), pa.array(np.concatenate([b.scores for b in some]))]
            yield pa.RecordBatch.from_arrays(columns, ["qid", key, "keyword"])

    best = cut_lineage(_met(made, queries, highest, "best double"))
    return _met(made, queries.join(best.filter("best > 0"), "qid"), kept, f"{key} long, keyword double")

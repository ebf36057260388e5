"""Keyword search of a batch of queries over all chunks: postings in blocks of chunks, every block met by every group of queries.

Terms travel as 64-bit hashes. A block holds the postings of some thousand chunks; a task has a group of queries, to which
all blocks come one after another, and keeps the best rows of each query. So no pair of a query and a chunk is written
but those that are asked for, and what is read and shuffled grows with the tables, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import bounded
from tarnwick.operators.ranking import B, K1
from tarnwick.session import cut_lineage, shuffle_partitions

#: Chunks of a block (their places take two bytes), and terms of one.
BLOCK, BLOCK_TERMS = 1 << 14, 1 << 22
#: Scores are compared at nine decimals.
NEAR = 2e-9
_COUNTED = "hash long, n long, words long"
_BLOCK = "keys binary, absent binary, lengths binary, terms binary, starts binary, places binary, counts binary, marks binary, mark_starts binary, mark_places binary"


def hashed(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of a list column, and how many each row has."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def _postings(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, starts, places, counts: of each term the rows that have it, in order, and how often."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms, at = np.unique(values, return_inverse=True)
    codes, counts = np.unique(at * BLOCK + rows, return_counts=True)
    return terms, np.searchsorted(codes, np.arange(len(terms) + 1) * BLOCK), codes % BLOCK, counts


def frequencies(chunks: DataFrame, terms: Column) -> tuple[DataFrame, DataFrame]:
    """(hash, df) of all terms, and one row (chunks, avgdl)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "terms", BLOCK_TERMS):
            for start in range(0, batch.num_rows, BLOCK):
                values, lengths = _items(batch.column("terms").slice(start, BLOCK))
                found, starts, _, _ = _postings(values, lengths)
                yield _counted(found, np.diff(starts), len(lengths), int(lengths.sum()))

    return _summed(chunks.select(hashed(terms).alias("terms")).mapInArrow(count, _COUNTED))


def _counted(terms: np.ndarray, n: np.ndarray, chunks: int, words: int) -> pa.RecordBatch:
    """Rows of terms, and one without a term that counts chunks and words."""
    columns = [pa.array([*terms.tolist(), None], pa.int64()), pa.array(np.append(n, chunks), pa.int64()), pa.array(np.append(np.zeros(len(n), np.int64), words), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["hash", "n", "words"])


def _summed(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    summed = cut_lineage(counted.groupBy("hash").agg(F.sum("n").alias("df"), F.sum("words").alias("words")))
    total = summed.filter("hash IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("chunks"), (F.sum("words") / F.sum("df")).alias("avgdl"))
    return summed.filter("hash IS NOT NULL").select("hash", "df"), total


def blocks(chunks: DataFrame, key: str, terms: Column, marks: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks, written once, with (hash, df) and one row (chunks, avgdl). `marks` are other terms of which only the presence counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for whole in bounded(batches, "terms", BLOCK_TERMS):
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                more = int(_items(batch.column("terms"))[1].sum())
                if held and (rows + batch.num_rows > BLOCK or size + more > BLOCK_TERMS):
                    yield block(pa.concat_batches(held))
                    held, rows, size = [], 0, 0
                held.append(batch)
                rows, size = rows + batch.num_rows, size + more
        if held:
            yield block(pa.concat_batches(held))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = batch.column("key")
        values, lengths = _items(batch.column("terms"))
        found, starts, places, counts = _postings(values, lengths)
        marked = _postings(*_items(batch.column("marks")))
        small = np.uint8 if counts.max(initial=0) < 256 else np.int32
        parts = [pc.fill_null(key, 0).to_numpy().astype(np.int64), pc.is_null(key).to_numpy(zero_copy_only=False), lengths.astype(np.int32), found, starts.astype(np.int32), places.astype(np.uint16), counts.astype(small)]
        parts += [marked[0], marked[1].astype(np.int32), marked[2].astype(np.uint16)]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], [c.split()[0] for c in _BLOCK.split(", ")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int32)
                yield _counted(np.frombuffer(row["terms"], np.int64), np.diff(np.frombuffer(row["starts"], np.int32)), len(lengths), int(lengths.sum()))

    none = F.array().cast("array<bigint>")
    rows = chunks.select(F.col(key).cast("long").alias("key"), hashed(terms).alias("terms"), (none if marks is None else hashed(marks)).alias("marks"))
    made = cut_lineage(rows.mapInArrow(build, _BLOCK))
    return made, *_summed(made.select("lengths", "terms", "starts").mapInArrow(count, _COUNTED))


def weigh(asked: DataFrame, frequency: DataFrame, total: DataFrame) -> DataFrame:
    """(qid, terms, weights, avgdl): of (qid, term, weight) the known terms, hashed, with their weight times the inverse frequency."""
    idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = asked.select("qid", F.xxhash64("term").alias("hash"), "weight").join(frequency, "hash").crossJoin(F.broadcast(total))  # total: one row
    # One query's terms; in one order, so that sums do not depend on the run.
    held = F.array_sort(F.collect_list(F.struct("hash", (F.col("weight") * idf).alias("w"))))
    return met.groupBy("qid").agg(held.alias("held"), F.first("avgdl").alias("avgdl")).select("qid", F.col("held.hash").alias("terms"), F.col("held.w").alias("weights"), "avgdl")


class _Block:
    """A block's postings, unpacked when they are asked for."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.keys, self.absent, self.lengths = read("keys", np.int64), read("absent", np.bool_), read("lengths", np.int32)
        self.terms, self.starts, self.places = read("terms", np.int64), read("starts", np.int32), read("places", np.uint16)
        self.counts = read("counts", np.uint8 if len(row["counts"]) == len(self.places) else np.int32)
        self.marks, self.mark_starts, self.mark_places = read("marks", np.int64), read("mark_starts", np.int32), read("mark_places", np.uint16)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.marked: dict[int, np.ndarray] = {}

    @staticmethod
    def find(among: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Where the asked terms stand; -1 where they do not."""
        if not len(among):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(among, asked), len(among) - 1)
        return np.where(among[at] == asked, at, -1)

    def part(self, at: int, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the term at `at`, and what it gives each of them."""
        if at not in self.parts:
            own = slice(self.starts[at], self.starts[at + 1])
            places, counts = self.places[own].astype(np.intp), self.counts[own].astype(np.float64)
            self.parts[at] = places, counts * (K1 + 1) / (counts + norm[places])
        return self.parts[at]

    def mark(self, at: int) -> np.ndarray:
        if at not in self.marked:
            self.marked[at] = self.mark_places[self.mark_starts[at] : self.mark_starts[at + 1]].astype(np.intp)
        return self.marked[at]

    def having(self, at: int, places: np.ndarray) -> np.ndarray:
        """Which of the places have the mark."""
        own = self.mark(at)
        return own[np.minimum(np.searchsorted(own, places), len(own) - 1)] == places


class _Best:
    """The best rows of one query so far: score at nine decimals, then key, null last."""

    def __init__(self, most: int):
        self.most, self.least = most, -1.0
        self.scores, self.keys, self.absent, self.extra = np.empty(0), np.empty(0, np.int64), np.empty(0, np.bool_), np.empty((0, 2), np.int32)

    def add(self, block: _Block, places: np.ndarray, scores: np.ndarray, extra) -> None:
        """Rows of the block that may be among the best; `extra` counts what else is told of the rows that are."""
        if len(places) > self.most:
            kth = np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            keep = scores >= kth - NEAR
            places, scores = places[keep], scores[keep]
        at, before = np.arange(len(self.scores) + len(places)), len(self.scores)
        every = np.concatenate([self.scores, scores])
        keys, absent = np.concatenate([self.keys, block.keys[places]]), np.concatenate([self.absent, block.absent[places]])
        if len(every) > self.most:
            at = np.lexsort((keys, absent, -np.rint(every * 1e9)))[: self.most]
        fresh = at[at >= before] - before
        self.extra = np.concatenate([self.extra[at[at < before]], extra(places[fresh])])
        at = np.concatenate([at[at < before], fresh + before])
        self.scores, self.keys, self.absent = every[at], keys[at], absent[at]
        if len(at) == self.most:
            self.least = self.scores.min()


def search(made: DataFrame, queries: DataFrame, key: str, most: int, most_having: int = 0) -> DataFrame:
    """(qid, key, bm25, met, met_first, having): the best `most` chunks of each query by keyword; as many more that have all marks in `need`.

    `queries` is (qid, terms, weights, avgdl) as `weigh` gives them, and if there are marks also `every`, `first` and `need`, hashed;
    `met` and `met_first` say how many of `every` and `first` a chunk has. Rows of the second kind (`having`) may score 0.
    """
    kind = queries.schema["qid"].dataType.simpleString()
    lists = [name for name in ("terms", "weights", "every", "first", "need") if name in queries.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.concat_batches(held)
            flat = [pa.array([_items(rows.column(name))[i].tobytes()], pa.binary()) for name in lists for i in (0, 1)]
            avgdl = pc.max(rows.column("avgdl")).as_py()
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("qid"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([avgdl or 1.0]), *flat], ["ids", "avgdl", *(f"_{name}{i}" for name in lists for i in (0, 1))])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kept, having = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids" and (ids is None or name[0] != "_")}
                if ids is None:  # one group of queries in a task
                    ids = batch.column("ids").slice(i, 1).flatten()
                    asked = {name: (np.frombuffer(row[f"_{name}0"], np.float64 if name == "weights" else np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(row[f"_{name}1"], np.int64))])) for name in lists}
                    kept, having = [_Best(most) for _ in range(len(ids))], [_Best(most_having) for _ in range(len(ids))]
                one_block(_Block(row), max(row["avgdl"], 1.0), asked, kept, having)
        for n, told in ((0, kept), (1, having)):
            for start in range(0, len(told), 1000):
                some = told[start : start + 1000]
                sizes = np.array([len(b.scores) for b in some])
                extra, gone = np.concatenate([b.extra for b in some]), np.concatenate([b.absent for b in some])
                columns = [ids.slice(start, 1000).take(pa.array(np.repeat(np.arange(len(some)), sizes))), pa.array(np.concatenate([b.keys for b in some]), mask=gone), pa.array(np.concatenate([b.scores for b in some]))]
                columns += [pa.array(extra[:, 0].astype(np.int32)), pa.array(extra[:, 1].astype(np.int32)), pa.array(np.full(len(gone), n == 1))]
                yield pa.RecordBatch.from_arrays(columns, ["qid", key, "bm25", "met", "met_first", "having"])

    def one_block(block: _Block, avgdl: float, asked: dict, kept: list[_Best], having: list[_Best]) -> None:
        at = {name: _Block.find(block.terms if name == "terms" else block.marks, values).tolist() for name, (values, _) in asked.items() if name != "weights"}
        ends = {name: e.tolist() for name, (_, e) in asked.items()}
        own = lambda name, q: at[name][ends[name][q] : ends[name][q + 1]]
        weights = asked["weights"][0].tolist()
        norm = K1 * (1 - B + B * block.lengths / avgdl)
        scores = np.zeros(len(block.keys))

        def counts(q: int):
            def count(places: np.ndarray) -> np.ndarray:
                out = np.zeros((len(places), 2), np.int32)
                for column, name in enumerate(("every", "first")):
                    if name in at and len(places):
                        for mark in own(name, q):
                            if mark >= 0:
                                out[:, column] += block.having(mark, places)
                return out

            return count

        for q in range(len(kept)):
            scores.fill(0.0)
            begin = ends["terms"][q]
            for n, term in enumerate(own("terms", q)):
                if term >= 0:
                    places, part = block.part(term, norm)
                    scores[places] += part * weights[begin + n]
            least = kept[q].least
            places = np.flatnonzero(scores >= least - NEAR if least > NEAR else scores > 0)
            if len(places):
                kept[q].add(block, places, scores[places], counts(q))
            if most_having and (need := own("need", q)) and min(need) >= 0:
                need = sorted(need, key=lambda m: len(block.mark(m)))
                places = block.mark(need[0])
                for mark in need[1:]:
                    if not len(places):
                        break
                    places = places[block.having(mark, places)]
                if len(places):
                    having[q].add(block, places, scores[places], counts(q))

    groups = queries.repartition(shuffle_partitions(made.sparkSession), F.xxhash64("qid")).mapInArrow(pack, f"ids array<{kind}>, avgdl double, " + ", ".join(f"_{name}{i} binary" for name in lists for i in (0, 1)))
    # Every task reads the written blocks, one after another, and has one group of queries.
    met = made.coalesce(1).hint("shuffle_replicate_nl").crossJoin(cut_lineage(groups))
    return met.mapInArrow(best, f"qid {kind}, {key} long, bm25 double, met int, met_first int, having boolean")


def pair_scores(rows: DataFrame, *names: str) -> DataFrame:
    """The rows with a keyword score for each name, 0 where no term is met.

    It is made of the columns (name)_words, the hashed words of the chunk with repeats, and (name)_terms, _weights and _avgdl
    of the query as `weigh` gives them, null where no term is known; these leave the rows.
    """
    used = [f"{name}_{x}" for name in names for x in ("words", "terms", "weights", "avgdl")]
    kept = [x for x in rows.columns if x not in used]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded([whole], used[0], BLOCK_TERMS):
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *(pa.array(one(batch, name)) for name in names)], [*kept, *names])

    def one(batch: pa.RecordBatch, name: str) -> np.ndarray:
        (words, lengths), (terms, asked), (weights, _) = (_items(batch.column(f"{name}_{x}")) for x in ("words", "terms", "weights"))
        at = np.repeat(np.arange(batch.num_rows), asked)
        every, ids = np.unique(np.concatenate([words, terms]), return_inverse=True)
        codes, counts = np.unique(np.repeat(np.arange(batch.num_rows), lengths) * len(every) + ids[: len(words)], return_counts=True)
        found = _Block.find(codes, at * len(every) + ids[len(words) :])
        tf = np.where(found >= 0, counts[found] if len(counts) else 0, 0).astype(np.float64)
        avgdl = np.maximum(pc.fill_null(batch.column(f"{name}_avgdl"), 1.0).to_numpy(), 1.0)
        norm = (K1 * (1 - B + B * lengths / avgdl))[at]
        return np.bincount(at, weights * (tf * (K1 + 1) / (tf + norm)), batch.num_rows)

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema if x.name in kept), *(f"`{name}` double" for name in names)])
    return rows.mapInArrow(score, schema)


def matches(made: DataFrame, queries: DataFrame, key: str, least: int) -> DataFrame:
    """(qid, key, matched): all chunks that have at least `least` terms of a query, with the number of these.

    `queries` is (qid, words): of each term the hashed words that stand for it. Every row asked for is given out; none is kept.
    """
    kind = queries.schema["qid"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.concat_batches(held)
            terms = rows.column("words")
            (words, each), per_query = _items(terms.flatten()), pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("qid"))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in (words, each, per_query))], ["ids", "words", "each", "per_query"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"}
                yield from one_block(_Block(row), batch.column("ids").slice(i, 1).flatten(), *(np.frombuffer(row[x], np.int64) for x in ("words", "each", "per_query")))

    def one_block(block: _Block, ids: pa.Array, words: np.ndarray, each: np.ndarray, per_query: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, ends = _Block.find(block.terms, words), np.concatenate([[0], np.cumsum(each)])
        known: dict[bytes, np.ndarray] = {}
        held, size, term = [], 0, 0
        total = np.zeros(len(block.keys), np.uint16)
        for q, n in enumerate(per_query):
            total.fill(0)
            for term in range(term, term + n):
                own = at[ends[term] : ends[term + 1]]
                name = own.tobytes()
                if name not in known:
                    known[name] = np.unique(np.concatenate([np.empty(0, np.uint16), *(block.places[block.starts[x] : block.starts[x + 1]] for x in own if x >= 0)])).astype(np.intp)
                total[known[name]] += 1
            term += bool(n)
            places = np.flatnonzero(total >= least)
            if len(places):
                held.append((q, places, total[places]))
                size += len(places)
            if size >= 1 << 17 or held and q + 1 == len(per_query):
                places = np.concatenate([x[1] for x in held])
                rows = ids.take(pa.array(np.repeat([x[0] for x in held], [len(x[1]) for x in held])))
                yield pa.RecordBatch.from_arrays([rows, pa.array(block.keys[places], mask=block.absent[places]), pa.array(np.concatenate([x[2] for x in held]).astype(np.int64))], ["qid", key, "matched"])
                held, size = [], 0

    groups = queries.repartition(shuffle_partitions(made.sparkSession), F.xxhash64("qid")).mapInArrow(pack, f"ids array<{kind}>, words binary, each binary, per_query binary")
    met = made.coalesce(1).hint("shuffle_replicate_nl").crossJoin(cut_lineage(groups.withColumnRenamed("words", "_words")).withColumnRenamed("_words", "words"))
    return met.mapInArrow(count, f"qid {kind}, {key} long, matched long")

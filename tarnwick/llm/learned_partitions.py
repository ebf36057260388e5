"""Most similar vectors for every vector, through learned partitions of a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import cut_lineage, shuffle_partitions

#: Rows of a unit of comparison, on either side.
BASE_TILE, QUERY_TILE = 4096, 8192


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer: from a unit vector to the probabilities of the partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k most similar rows of each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part for each node, of nearly equal sizes, cutting few edges.

    Starts from centres with a capacity, then moves nodes to the part that holds most of their neighbours, in both
    directions of the edges, strongest wish first, as long as that part has room.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    room = -(-n * 105 // (100 * parts))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(4):
        part = _fill(x @ centres.T, room)
        for p in range(parts):
            own = x[part == p]
            if len(own):
                c = own.sum(axis=0)
                centres[p] = c / max(np.linalg.norm(c), 1e-9)
    heads = np.repeat(np.arange(n), graph.shape[1])
    tails = graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (heads, part[tails]), 1)
        np.add.at(votes, (tails, part[heads]), 1)
        votes[np.arange(n), part] += 0.5  # no move without a gain
        moved = _fill(votes, room)
        if (moved == part).all():
            break
        part = moved
    return part


def _fill(score: np.ndarray, room: int) -> np.ndarray:
    """Each row into its best column with room; rows that lose most elsewhere choose first."""
    order = np.argsort(-score, axis=1, kind="stable")
    top = np.take_along_axis(score, order[:, :2], axis=1)
    gain = top[:, 0] - top[:, -1]
    left = [room] * score.shape[1]
    out = np.zeros(len(score), np.int64)
    for i in np.argsort(-gain, kind="stable"):
        for p in order[i]:
            if left[p]:
                left[p] -= 1
                out[i] = p
                break
    return out


def train(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 5) -> Router:
    """Cross-entropy against the parts of a node and its neighbours, by Adam on small batches."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    target = np.zeros((n, parts), np.float32)
    target[np.arange(n), part] += 1.0
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1.0 / max(1, graph.shape[1]))
    target /= target.sum(axis=1, keepdims=True)
    weights = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            a, y = x[rows], target[rows]
            h = np.maximum(a @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - y) / len(rows)
            dh = (dz @ weights[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((a.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] -= 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def fit(x: np.ndarray, parts: int, neighbours: int = 10, hidden: int = 128) -> Router:
    if parts <= 1 or len(x) < 2 * parts:
        d = x.shape[1] if x.ndim == 2 and len(x) else 1
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(x, neighbours)
    return train(x, graph, balanced_partition(x, graph, parts), parts, hidden)


@dataclass(frozen=True)
class Index:
    """A router to coarse parts, and for coarse parts with too many rows one to the parts within; parts are numbered over all."""

    top: Router
    within: dict[int, Router]
    first: np.ndarray  # number of the first part of each coarse part

    def parts_of(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each row."""
        coarse = self.top.probabilities(x).argmax(axis=1)
        out = self.first[coarse]
        for c in np.unique(coarse):
            if c in self.within:
                rows = np.flatnonzero(coarse == c)
                out[rows] += self.within[c].probabilities(x[rows]).argmax(axis=1)
        return out

    def probe(self, x: np.ndarray, probes: int, mass: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, part): the most probable parts of each row, until they hold `mass` of the probability or are `probes` many, or twice
        as many where rows are routed twice."""
        probes *= 2 if self.within else 1  # two classifiers err more often than one
        who, at, share = _likely(self.top.probabilities(x), probes, mass)
        rows, parts, p = [], [], []
        for c in np.unique(at):
            here = np.flatnonzero(at == c)
            if c not in self.within:
                rows.append(who[here])
                parts.append(np.full(len(here), self.first[c]))
                p.append(share[here])
                continue
            inner, part, weight = _likely(self.within[c].probabilities(x[who[here]]), probes, mass)
            rows.append(who[here][inner])
            parts.append(self.first[c] + part)
            p.append(share[here][inner] * weight)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, part, weight = np.concatenate(rows), np.concatenate(parts), np.concatenate(p)
        order = np.lexsort((part, -weight, row))
        row, part, weight = row[order], part[order], weight[order]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        begun = np.repeat(start, np.diff(np.concatenate([start, [len(row)]])))
        before = np.cumsum(weight) - weight
        keep = (np.arange(len(row)) - begun < probes) & (before - before[begun] < mass)
        return row[keep], part[keep]


def _likely(p: np.ndarray, probes: int, mass: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = np.argsort(-p, axis=1, kind="stable")[:, :probes]
    share = np.take_along_axis(p, best, axis=1)
    who, at = np.nonzero(np.cumsum(share, axis=1) - share < mass)
    return who, best[who, at], share[who, at]


def _fit_index(classes: DataFrame, width: int, total: int, sample: int, rows_per_part: int, max_parts: int) -> Index:
    """Fit one level where `max_parts` parts are enough, else a second within each coarse part, the latter in parallel.

    Every fit sees at most `sample` rows, those with the smallest hashes; the driver holds at most max_parts + 1 routers.
    """
    drawn = classes.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow()
    x = drawn.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float32)
    wanted = -(-total // rows_per_part)
    top = fit(x, min(max_parts, wanted))
    coarse = top.b2.shape[0]
    if wanted <= max_parts:
        return Index(top, {}, np.arange(coarse))
    shared = classes.sparkSession.sparkContext.broadcast(top)
    kind = classes.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = shared.value.probabilities(_matrix(batch, width)).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(part)], ["key", "v", "part"])

    placed = cut_lineage(classes.mapInArrow(place, f"key {kind}, v array<float>, part int"))
    sizes = {r["part"]: -(-r["n"] // rows_per_part) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_parts
    order = Window.partitionBy("part").orderBy(F.xxhash64("key"), "key")
    some = placed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).select("part", "v")

    def learn(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        rows = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float32)
        router = fit(rows, min(max_parts, sizes[part]), hidden=64)
        weights = [w.astype(np.float32) for w in (router.w1, router.b1, router.w2, router.b2)]
        return pa.table({"part": pa.array([part], pa.int32()), "hidden": pa.array([weights[1].shape[0]], pa.int32()), "weights": pa.array([b"".join(w.tobytes() for w in weights)], pa.binary())})

    within, first, at = {}, np.zeros(coarse, np.int64), 0
    learned = {r["part"]: r for r in some.groupBy("part").applyInArrow(learn, "part int, hidden int, weights binary").collect()}
    for c in range(coarse):
        first[c] = at
        if c in learned and sizes[c] > 1:
            flat, h = np.frombuffer(learned[c]["weights"], np.float32), learned[c]["hidden"]
            n = (len(flat) - width * h - h) // (h + 1)
            w1, b1, w2, b2 = np.split(flat, np.cumsum([width * h, h, h * n]))
            within[c] = Router(w1.reshape(width, h), b1, w2.reshape(h, n), b2)
            at += n
        else:
            at += 1
    return Index(top, within, first)


def _matrix(batch: pa.RecordBatch, width: int, column: str = "v") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): unit vectors of float32. Null, zero and non-finite vectors are left out."""
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            counts = np.diff(lists.offsets.to_numpy())
            some = counts > 0
            norms = np.zeros(len(counts))
            if some.any():
                starts = (np.cumsum(counts) - counts)[some]
                with np.errstate(over="ignore", invalid="ignore"):
                    norms[some] = np.sqrt(np.add.reduceat(flat * flat, starts))
            good = np.isfinite(norms) & (norms > 0)
            owner = np.repeat(np.arange(len(counts)), counts)
            keep = good[owner]
            unit = (flat[keep] / norms[owner[keep]]).astype(np.float32)
            edges = np.concatenate([[0], np.cumsum(counts[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(edges), pa.array(unit))], ["key", "v"])

    return rows.mapInArrow(run, f"key {kind}, v array<float>").groupBy("key").agg(F.max("v").alias("v"))


def nearest(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 10,
    queries: str | None = None,
    min_similarity: float = -1.0,
    sample: int = 8192,
    rows_per_part: int = 1536,
    max_parts: int = 256,
    mass: float = 0.995,
    probes: int = 12,
) -> DataFrame:
    """The k vectors most similar by cosine to each query vector: (key, neighbour, similarity, place).

    All rows are queries, or those of which the SQL condition `queries` on the key holds; every usable row is
    searched. Only neighbours with at least `min_similarity` are given. Null, all-zero and non-finite vectors take
    no part; vectors whose length is not the most frequent one are left out. Directions that agree to a millionth in every coordinate are one class
    in the search and come back as single rows with one similarity (at 64 coordinates within 0.00001 of their own); ties go to the smaller key. Of repeated keys the greatest vector counts. Other columns are
    ignored; an empty table gives an empty result.

    The index is fitted on at most `sample` rows, those with the smallest hash of their key: the graph of their
    neighbours is partitioned into balanced parts, about one for `rows_per_part` rows, and a classifier learns them. Where that makes
    more than `max_parts`, rows are routed twice: to one of `max_parts` coarse parts, and within it by a classifier fitted in the same
    way on at most `sample` rows of that part; so parts stay near `rows_per_part` up to max_parts^2 of them, and grow with the rows only
    beyond. All rows are indexed in their most probable part. A query is compared, exactly, with the rows of its most
    probable parts, until these hold `mass` of the probability or are `probes` many, twice as many where rows are routed twice. Parts of any size are compared in tiles.
    """
    spark = df.sparkSession
    vectors = _unit_vectors(df, key, vector)
    lengths = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    kind = dict(df.dtypes)[key]
    shape = f"key {kind}, neighbour {kind}, similarity double, place int"
    if not lengths:
        return spark.createDataFrame([], shape.replace("key", f"`{key}`", 1))
    width = lengths[0]["d"]
    named = vectors.filter(F.size("v") == width)
    coarse = F.transform("v", lambda x: F.round(x * 1_000_000).cast("int"))
    named = cut_lineage(named.withColumn("h1", F.xxhash64(coarse)).withColumn("h2", F.xxhash64(F.lit(7), F.reverse(coarse))))
    # Of a class of equal directions, the smallest keys: as many as any list can show.
    order = Window.partitionBy("h1", "h2").orderBy("key")
    shown = named.select("key", "h1", "h2").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    heads = shown.groupBy("h1", "h2").agg(F.min("key").alias("class"), F.array_sort(F.collect_list("key")).alias("members"))
    heads = cut_lineage(heads)
    classes = cut_lineage(named.select("key", "v").join(heads.select(F.col("class").alias("key")), "key", "left_semi"))
    total = classes.count()
    index = spark.sparkContext.broadcast(_fit_index(classes, width, total, sample, rows_per_part, max_parts))

    def place(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, width)
                who, part = index.value.probe(x, probes, mass) if query else (np.arange(len(x)), index.value.parts_of(x))
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("v").take(take), pa.array(part.astype(np.int32))], ["key", "v", "part"])

        return run

    row = f"key {kind}, v array<float>, part int"
    asked = classes
    if queries is not None:
        wanted = named.filter(F.expr(queries.replace(key, "key"))).select("h1", "h2").distinct()
        asked = classes.join(heads.join(wanted, ["h1", "h2"], "left_semi").select(F.col("class").alias("key")), "key", "left_semi")
    base, query = classes.mapInArrow(place(False), row), asked.mapInArrow(place(True), row)
    # No more rows than parts: how many tiles each side of a part has.
    sizes = base.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BASE_TILE).cast("int").alias("bases"))
    asks = query.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_TILE).cast("int").alias("asks"))
    tiles = F.broadcast(sizes.join(asks, "part"))
    own = F.pmod(F.xxhash64("key"), F.col("bases")).cast("int")
    left = base.join(tiles, "part").select("key", "v", "part", own.alias("b"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("q"), F.lit(0).alias("role"))
    own = F.pmod(F.xxhash64("key"), F.col("asks")).cast("int")
    right = query.join(tiles, "part").select("key", "v", "part", F.explode(F.sequence(F.lit(0), F.col("bases") - 1)).alias("b"), own.alias("q"), F.lit(1).alias("role"))
    both = left.unionByName(right).select(F.xxhash64("part", "b", "q").alias("unit"), "role", "key", "v")
    ordered = both.repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit", "role")
    floor = np.float32(min_similarity - 1e-4)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, keys, whole = None, [], [], None
        for batch in batches:
            units, roles = batch.column("unit").to_numpy(), batch.column("role").to_numpy()
            v, names = _matrix(batch, width), batch.column("key")
            edges = [0, *(np.flatnonzero((units[1:] != units[:-1]) | (roles[1:] != roles[:-1])) + 1), len(units)]
            for a, b in zip(edges, edges[1:]):
                if units[a] != unit:
                    unit, held, keys, whole = units[a], [], [], None
                if roles[a] == 0:
                    held.append(v[a:b])
                    keys.append(names.slice(a, b - a))
                    continue
                if not held:
                    continue
                if whole is None:
                    whole = np.concatenate(held), pa.concat_arrays(keys)
                for at in range(a, b, 1024):
                    yield _best(v[at : min(b, at + 1024)], names.slice(at, min(b, at + 1024) - at), *whole, k, floor)

    found = ordered.mapInArrow(compare, f"q {kind}, b {kind}, s double").filter("q != b")
    best = found.distinct().withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "b"))).filter(F.col("n") <= k).drop("n")
    # Back from classes to rows: the class itself comes first, with similarity 1.
    itself = asked.select(F.col("key").alias("q"), F.col("key").alias("b"), F.lit(1.0).alias("s"))
    listed = best.unionByName(itself).join(heads.select(F.col("class").alias("b"), "members"), "b")
    listed = listed.select("q", F.transform("members", lambda m: F.struct((-F.col("s")).alias("d"), m.alias("key"))).alias("some"))
    lists = listed.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k + 1).alias("near"))  # at most (k + 1)^2 entries
    rows = named.select("key", "h1", "h2")
    if queries is not None:
        rows = rows.filter(F.expr(queries.replace(key, "key")))
    rows = rows.join(heads.select("h1", "h2", F.col("class").alias("q")), ["h1", "h2"]).join(lists, "q")
    near = F.slice(F.filter("near", lambda e: e["key"] != F.col("key")), 1, k)
    out = rows.select("key", F.posexplode(near).alias("at", "e"))
    out = out.select("key", F.col("e.key").alias("neighbour"), (-F.col("e.d")).alias("similarity"), (F.col("at") + 1).alias("place"))
    return out.filter(F.col("similarity") >= min_similarity).withColumnRenamed("key", key)


def _best(query: np.ndarray, names: pa.Array, base: np.ndarray, keys: pa.Array, k: int, floor: np.float32) -> pa.RecordBatch:
    """The k best of the base for each query (one more, for the query itself), above the floor."""
    s = query @ base.T
    if s.shape[1] > k + 1:
        at = np.argpartition(-s, k, axis=1)[:, : k + 1]
    else:
        at = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    i, j = np.nonzero(np.take_along_axis(s, at, axis=1) >= floor)
    b = at[i, j]
    exact = np.einsum("ij,ij->i", query[i].astype(np.float64), base[b].astype(np.float64))
    return pa.RecordBatch.from_arrays([names.take(pa.array(i)), keys.take(pa.array(b)), pa.array(np.minimum(1.0, exact))], ["q", "b", "s"])

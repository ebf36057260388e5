"""Mixing sources to target weights: exact quotas, split over shards by a hypergeometric tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import cut_lineage

U = 2.0**63
#: Most size of a shard, which one task puts in order, and the least number of shards; a source's blocks are numbered below TURNS.
SHARD_SIZE, LEAST_SHARDS, TURNS = 1 << 30, 64, 1 << 40


def split_quotas(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """blocks[s] blocks of each source, dealt to shards: a (shards, sources) array with exact sums.

    Each node of the tree halves its shards and draws how many blocks of each source go left from the
    multivariate hypergeometric distribution, so that every shard gets its share of all blocks.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(blocks)), dtype=np.int64)

    def descend(have: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        total = int(have.sum())
        want = total * (middle - first) // (last - first)
        left = np.zeros_like(have)
        rest, need = total, want
        for s, n in enumerate(have):  # one hypergeometric draw for each source, given those before
            rest -= int(n)
            left[s] = _draw(rng, int(n), rest, need)
            need -= int(left[s])
        descend(left, first, middle)
        descend(have - left, middle, last)

    descend(np.asarray(blocks, dtype=np.int64), 0, shards)
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    # numpy's draw ends at 10^9; beyond it the normal limit is exact to far less than a block
    n, p = sample, good / (good + bad)
    sd = (n * p * (1 - p) * (good + bad - n) / max(1, good + bad - 1)) ** 0.5
    return int(np.clip(round(rng.normal(n * p, sd)), max(0, n - bad), min(good, n)))


def plan_quotas(have: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, float]]:
    """Tokens to take of each source, and its share among sources that exist.

    The size of the mix is the largest at which every existing source reaches its share without more
    than its repeats, or `total` if that is less.
    """
    there = {s: (w, r) for s, (w, r) in targets.items() if have.get(s, 0) > 0 and w and w > 0 and r and r > 0}
    weight = sum(w for w, _ in there.values())
    if not there:
        return {}
    most = min(have[s] * r * weight / w for s, (w, r) in there.items())
    size = most if total is None else min(most, total)
    return {s: (int(size * w / weight), w / weight) for s, (w, _) in there.items()}


def mix(
    sizes: DataFrame,
    item: str,
    source: str,
    size: str,
    targets: DataFrame,
    share: str = "target_share",
    repeats: str = "max_repeats",
    target_source: str = "source",
    total: int | None = None,
    shards: int | None = None,
    block: int | None = None,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). `sizes` has one row for each item; `targets` one for each source and is of fixed size.

    Mix rows are (item, source, copy, size, block, shard, place): each row is one use of an item, `place` its
    place in the shard. Report rows are (source, target_share, actual_share, size_available, size_used, items_used,
    most_uses, max_repeats). Whole passes over a source take every item once; the last pass takes items in
    permuted order up to the quota, the one that crosses it if that comes nearer. A source without a target
    is not used; a target without items has an actual share of 0 and the others keep their proportions.
    Items without size (null or not positive), and null items or sources, are not used. An item is never used more than max_repeats times.
    Other columns are ignored; empty tables give empty results (report: the targets with zeros). `shards` are by default
    64, or as many as keep each under SHARD_SIZE; `block` is the size of the stretches dealt to shards, by default a 256th of a
    shard's share, at least 512.

    All sums over items run in hash buckets of bounded size, so a source with any part of the rows is spread over tasks.
    """
    kind = dict(sizes.dtypes)[item]
    rows = sizes.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(size).cast("long").alias("n"))
    rows = cut_lineage(rows.filter("item IS NOT NULL AND source IS NOT NULL AND n > 0"))
    spark = sizes.sparkSession
    wanted = {r[0]: (r[1], r[2]) for r in targets.select(target_source, share, repeats).filter(F.col(target_source).isNotNull()).collect()}
    names = spark.createDataFrame([(s,) for s in wanted], "source string") if wanted else spark.createDataFrame([], "source string")
    have = {r[0]: (r[1], r[2]) for r in rows.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("n"), F.count("*")).collect()}  # no more rows than targets
    quotas = plan_quotas({s: t for s, (t, _) in have.items()}, wanted, total)
    shards = shards or max(LEAST_SHARDS, -(-sum(q for q, _ in quotas.values()) // SHARD_SIZE))
    block = block or max(512, sum(q for q, _ in quotas.values()) // (shards * 256))
    plan = []
    for number, (s, (quota, aim)) in enumerate(sorted(quotas.items())):
        tokens, count = have[s]
        passes = min(quota // tokens, wanted[s][1])
        rest = quota - passes * tokens if passes < wanted[s][1] else 0
        plan.append((s, number, int(passes), int(rest), max(1, -(-count // 2000)), max(1, -(-quota // block)), tokens))
    schema = "source string, number int, passes long, rest long, buckets long, blocks long, tokens long"
    plans = F.broadcast(spark.createDataFrame(plan, schema) if plan else spark.createDataFrame([], schema))

    # Place of each item on the line of its source: buckets by hash, sums over buckets, sums within each.
    unit = (F.xxhash64("item", F.lit(seed)) / F.lit(2 * U) + F.lit(0.5)).alias("u")
    placed = rows.join(plans, "source").select("*", unit)
    placed = placed.withColumn("bucket", F.least(F.floor(F.col("u") * F.col("buckets")), F.col("buckets") - 1))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n").alias("in_bucket"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("u", "item").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.join(sums, ["source", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    extra = F.when(F.col("start") + F.col("n") / 2 <= F.col("rest"), 1).otherwise(0)
    uses = lined.withColumn("uses", F.col("passes") + extra).filter("uses > 0")
    copies = uses.select("item", "source", "number", "n", "start", "tokens", "blocks", F.posexplode(F.sequence(F.lit(1), F.col("uses"))).alias("copy", "_"))
    # A block is a stretch of the source's line, passes one after another; blocks are dealt in permuted order.
    line = F.col("copy") * F.col("tokens") + F.col("start")
    copies = copies.withColumn("block", F.least(F.floor(line / F.lit(block)), F.col("blocks") - 1))

    sources = [p[0] for p in plan]
    dealt = split_quotas(np.array([p[5] for p in plan], dtype=np.int64), shards, seed) if plan else np.zeros((shards, 0), dtype=np.int64)
    # The ends of the shards on each source's line of blocks, one after another: sources x shards numbers, 8 bytes for each 2^30 / sources of size.
    ends = spark.sparkContext.broadcast((np.arange(len(sources))[:, None] * TURNS + dealt.cumsum(axis=0).T).ravel())
    # A permutation of the blocks: multiplication by a number prime to their count.
    steps = [(p[0], _coprime(p[5], seed + p[1])) for p in plan]
    steps_df = spark.createDataFrame(steps, "source string, step long") if steps else spark.createDataFrame([], "source string, step long")
    turned = copies.join(F.broadcast(steps_df), "source").withColumn("turn", ((F.col("block") * F.col("step")) % F.col("blocks")))
    turned = turned.select("item", "source", "copy", "n", "block", (F.col("number") * F.lit(TURNS) + F.col("turn")).alias("turn"))
    names = ["item", "source", "copy", "n", "block"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(ends.value, batch.column("turn").to_numpy(), "right") % shards
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(at.astype(np.int32))], [*names, "shard"])

    mixed = turned.mapInArrow(deal, turned.select(*names, F.lit(0).alias("shard")).schema)
    local = Window.partitionBy("shard").orderBy(F.xxhash64("item", "copy", F.lit(seed + 1)), "item", "copy")
    mixed = mixed.select(F.col("item").cast(kind).alias(item), "source", (F.col("copy") + 1).cast("int").alias("copy"), F.col("n").alias("size"), "block", "shard", F.row_number().over(local).alias("place"))

    used = uses.groupBy("source").agg(F.sum(F.col("n") * F.col("uses")).alias("size_used"), F.sum("uses").alias("items_used"), F.max("uses").alias("most_uses"))
    whole = Window.partitionBy()
    there = spark.createDataFrame([(s, t) for s, (t, _) in have.items()] or [], "source string, size_available long")
    asked = targets.filter(F.col(target_source).isNotNull()).select(F.col(target_source).alias("source"), F.col(share).alias("target_share"), F.col(repeats).alias("max_repeats"))
    report = asked.join(there, "source", "left").join(used, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = report.select("source", "target_share", zero("size_available"), zero("size_used"), zero("items_used"), zero("most_uses"), "max_repeats")
    report = report.withColumn("actual_share", F.coalesce(F.col("size_used") / F.nullif(F.sum("size_used").over(whole), F.lit(0)), F.lit(0.0)))
    return mixed, report.select("source", "target_share", "actual_share", "size_available", "size_used", "items_used", "most_uses", "max_repeats")


def _coprime(n: int, seed: int) -> int:
    if n <= 2:
        return 1
    step = int(n * 0.6180339887) + seed % 97
    while np.gcd(step := step + 1, n) != 1:
        pass
    return step % n or 1

"""One ranking from several differently scaled scores, by median rank aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.hot_ranks import rank_column, ranks_of_split_groups


def _weighted_median(places: Sequence[Column], weights: Sequence[float]) -> Column:
    """Middle of the places by weight; the mean of the two middle places where the weight halves evenly."""
    half = sum(weights) / 2
    pairs = F.array_sort(F.array(*[F.struct(p.cast("double").alias("p"), F.lit(float(w)).alias("w")) for p, w in zip(places, weights)]))

    def step(acc: Column, x: Column) -> Column:
        total = acc.w + x.w
        return F.struct(
            total.alias("w"),
            F.when(acc.lo.isNull() & (total >= half), x.p).otherwise(acc.lo).alias("lo"),
            F.when(acc.hi.isNull() & (total > half), x.p).otherwise(acc.hi).alias("hi"),
        )

    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("w"), none.alias("lo"), none.alias("hi"))
    return F.aggregate(pairs, start, step, lambda acc: (acc.lo + acc.hi) / 2)


def median_rank(
    df: DataFrame,
    group: str,
    item: str,
    scores: Sequence[str],
    weights: Sequence[float] | None = None,
    delivered: str | None = None,
    hot_rows: int = 500_000,
) -> DataFrame:
    """Rank the items of each group by the weighted median of their places in the single scores.

    Each score, higher being better, gives an item its place among the group's items; equal scores
    share the best place they cover, and a null or NaN score has the last place, the number of items.
    The order is by median place, then mean place, then item. Rows are (group, item, place_<score>...,
    median_place, mean_place, rank), one for each pair of group and item: of repeated rows the last by
    `delivered` counts (without it the greatest scores). Rows with a null group or item are left out;
    other columns are ignored, and an empty table gives an empty result.

    Groups of up to `hot_rows` rows are ranked by windows behind one shuffle. Larger ones are ranked
    through range-partitioned values, so that no group has to fit a task; nothing is left out either way.
    """
    weights = list(weights or [1.0] * len(scores))
    if len(weights) != len(scores) or min(weights) <= 0:
        raise ValueError("one positive weight for each score")
    clean = [F.when(~F.isnan(F.col(s)), F.col(s)).cast("double").alias(s) for s in scores]
    at = [F.col(delivered).alias("_at")] if delivered else []
    rows = df.select(group, item, *clean, *at).filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows).select(group)
    if sizes.isEmpty():
        return _by_windows(_settled(rows.repartition(group), group, item, scores, at), group, item, scores, weights)
    cool = _settled(rows.join(sizes, group, "left_anti").repartition(group), group, item, scores, at)
    hot = _settled(rows.join(sizes, group, "left_semi"), group, item, scores, at)
    return _by_windows(cool, group, item, scores, weights).unionByName(_split(hot, group, item, scores, weights))


def _settled(rows: DataFrame, group: str, item: str, scores: Sequence[str], at: list) -> DataFrame:
    if not at:
        return rows.groupBy(group, item).agg(*[F.max(s).alias(s) for s in scores])
    last = F.max_by(F.struct(*scores), F.struct(F.col("_at"), *scores)).alias("_s")
    return rows.groupBy(group, item).agg(last).select(group, item, *[F.col("_s")[s].alias(s) for s in scores])


def _finish(placed: DataFrame, group: str, item: str, scores: Sequence[str], weights: Sequence[float]) -> DataFrame:
    places = [F.coalesce(F.col(f"place_{s}"), F.col("_items")).cast("long") for s in scores]
    total = float(sum(weights))
    mean = sum((p * F.lit(w / total) for p, w in zip(places, weights)), F.lit(0.0))
    return placed.select(
        group,
        item,
        *[p.alias(f"place_{s}") for p, s in zip(places, scores)],
        _weighted_median(places, weights).alias("median_place"),
        F.round(mean, 9).alias("mean_place"),
    )


def _by_windows(rows: DataFrame, group: str, item: str, scores: Sequence[str], weights: Sequence[float]) -> DataFrame:
    whole = Window.partitionBy(group)
    placed = rows.select("*", *[rank_column(group, s).alias(f"place_{s}") for s in scores], F.count(F.lit(1)).over(whole).alias("_items"))
    done = _finish(placed, group, item, scores, weights)
    order = whole.orderBy("median_place", "mean_place", item)
    return done.withColumn("rank", F.row_number().over(order).cast("long"))


def _split(rows: DataFrame, group: str, item: str, scores: Sequence[str], weights: Sequence[float]) -> DataFrame:
    placed = rows.join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_items")), group)
    for s in scores:
        placed = ranks_of_split_groups(placed, group, s, f"place_{s}")
    done = _finish(placed, group, item, scores, weights)
    # The order of the items is a rank too: of one value that holds the three keys, greatest first.
    key = F.struct(-F.col("median_place"), -F.col("mean_place"), _descending(done, item)).alias("_key")
    return ranks_of_split_groups(done.withColumn("_key", key), group, "_key", "rank").drop("_key").select(*done.columns, F.col("rank").cast("long"))


def _descending(df: DataFrame, item: str) -> Column:
    """A value that falls as `item` rises; text falls by the complement of its bytes."""
    kind = dict(df.dtypes)[item]
    if kind in ("string", "binary"):
        # With a sign of the end above every complemented digit a prefix comes after what it begins.
        return F.concat(F.translate(F.lower(F.hex(F.col(item).cast("binary"))), "0123456789abcdef", "fedcba9876543210"), F.lit("g"))
    if kind == "date":
        return -F.unix_date(item)
    if kind == "timestamp":
        return -F.unix_micros(item)
    if kind == "boolean":
        return ~F.col(item)
    return -F.col(item)

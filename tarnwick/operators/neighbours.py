"""Joins over the order of a document: neighbours, as-of, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(seeds: DataFrame, chunks: DataFrame, keys: Sequence[str], position: str, width: int) -> DataFrame:
    """Chunks within `width` places of a seed, with the least distance: (seed columns..., chunk columns..., distance).

    A range join as an equi-join: every seed asks for each place around it by name.
    """
    asked = seeds.withColumn("_at", F.explode(F.sequence(F.col(position) - width, F.col(position) + width)))
    asked = asked.withColumn("distance", F.abs(F.col("_at") - F.col(position))).drop(position).withColumnRenamed("_at", position)
    return asked.join(chunks, [*keys, position])


def latest_anchor(df: DataFrame, keys: Sequence[str], position: str, is_anchor: Column, value: Column, window: int, out: str) -> DataFrame:
    """As-of join by a window: `value` of the last anchor at or up to `window` places before each row."""
    span = Window.partitionBy(*keys).orderBy(position).rangeBetween(-window, 0)
    return df.withColumn(out, F.last(F.when(is_anchor, value), ignorenulls=True).over(span))


def in_spans(df: DataFrame, spans: DataFrame, keys: Sequence[str], position: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """Rows whose position lies in a span, through buckets of positions: equi-join, then the exact bounds."""
    wide = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    narrow = df.withColumn("_bucket", F.floor(F.col(position) / bucket))
    return narrow.join(wide, [*keys, "_bucket"]).filter(F.col(position).between(F.col(start), F.col(end))).drop("_bucket")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, out: str = "island") -> DataFrame:
    """Number of the run of rows between breaks, counted from 0 within the keys."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_break", breaks).withColumn(out, F.sum(F.when(F.col("_break"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def heading_paths(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, title: str, depth: int = 6) -> DataFrame:
    """The stack of headings above each row: at each level the last title, unless a higher heading is newer."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_place", F.row_number().over(place))
    for n in range(1, depth + 1):
        out = out.withColumn(f"_h{n}", F.last(F.when(F.col(level) == n, F.struct(F.col("_place").alias("at"), F.col(title).alias("title"))), ignorenulls=True).over(by))
    live = []
    for n in range(1, depth + 1):
        newest = [F.col(f"_h{m}.at") for m in range(1, n)]
        over = F.greatest(*newest, F.lit(0)) if len(newest) >= 1 else F.lit(0)
        live.append(F.when(F.col(f"_h{n}.at") > F.coalesce(over, F.lit(0)), F.col(f"_h{n}.title")))
    path = F.filter(F.array(*live), lambda t: t.isNotNull())
    return out.withColumn("section_path", path).drop("_place", *[f"_h{n}" for n in range(1, depth + 1)])


def repeated_margins(df: DataFrame, source: str, page: str, line: str, place: str, lines: str, edge: int = 3, share: float = 0.6, least: int = 3, longest: int = 120) -> DataFrame:
    """Lines at the edges of pages whose digit-masked form stands on enough pages of the source."""
    mask = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(line))), "[0-9]+", "#"), r"\s+", " ")
    edges = df.filter(((F.col(place) <= edge) | (F.col(place) > F.col(lines) - edge)) & (F.char_length(F.trim(F.col(line))).between(1, longest))).withColumn("signature", mask)
    total = df.groupBy(source).agg(F.countDistinct(page).alias("_pages"))
    often = edges.groupBy(source, "signature").agg(F.countDistinct(page).alias("on_pages")).join(total, source)
    often = often.filter(F.col("on_pages") >= F.greatest(F.lit(least), F.floor(F.col("_pages") * share + 0.5)))
    return often.select(source, "signature", "on_pages")

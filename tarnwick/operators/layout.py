"""Words on a page: lines, segments, boxes, tables over pages."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(words: DataFrame, keys: list[str], x0: str, x1: str, text: str, page_width: float) -> DataFrame:
    """Words of a line parted where the gap is wider than max(18, 3.2 % of the page): (keys..., segment, x0, x1, text)."""
    wide = max(18.0, page_width * 0.032)
    by = Window.partitionBy(*keys).orderBy(x0, x1)
    gap = F.col(x0) - F.lag(x1).over(by)
    rows = words.withColumn("_new", F.when(F.coalesce(gap, F.lit(0.0)) > wide, 1).otherwise(0))
    rows = rows.withColumn("segment", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(x0, x1, text))), lambda w: w[text]), " ")  # the words of a line
    return rows.groupBy(*keys, "segment").agg(F.min(x0).alias(x0), F.max(x1).alias(x1), joined.alias(text))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Area two boxes share, as a part of the smaller; boxes are structs of x0, y0, x1, y1."""
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, width * height / smaller).otherwise(F.lit(0.0))


def multipage_tables(tables: DataFrame, document: str) -> DataFrame:
    """Tables that go on: on the next page, above y 420, with the same number of columns; each with the number of its whole."""
    by = Window.partitionBy(document).orderBy("page", "y0")
    goes_on = (F.col("page") == F.lag("page_end").over(by) + 1) & (F.col("y0") < 420) & (F.col("columns") == F.lag("columns").over(by))
    return tables.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("whole", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lines_of(words: list[dict], tolerance: float = 4.0, recent: int = 6) -> list[dict]:
    """Words of one page with the number of their line, lines from the top: a word joins the nearest of the last lines begun."""
    heights: list[list[float]] = []
    numbered = []
    for word in sorted(words, key=lambda w: ((w["y0"] + w["y1"]) / 2, w["x0"])):
        at = (word["y0"] + word["y1"]) / 2
        near = [(abs(at - sum(h) / len(h)), i) for i, h in list(enumerate(heights))[-recent:]]
        best = min(near, default=(tolerance + 1, -1))
        if best[0] <= tolerance:
            line = best[1]
            heights[line].append(at)
        else:
            line = len(heights)
            heights.append([at])
        numbered.append({**word, "line": line})
    return numbered


def column_positions(values: list[float], tolerance: float) -> list[float]:
    """Centres of groups of positions on one axis, each the median of its members."""
    groups: list[list[float]] = []
    for value in sorted(values):
        near = min(((abs(value - median(g)), i) for i, g in enumerate(groups)), default=(tolerance + 1, -1))
        if near[0] <= tolerance:
            groups[near[1]].append(value)
        else:
            groups.append([value])
    return [median(g) for g in groups]

"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import cut_lineage

SALTS = 16


def ranks_of_split_groups(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Competition rank of `value` (greatest first) within `group`, without a task per group.

    Equal values are counted first; the distinct values are range-partitioned over all tasks and
    get their rank from running sums: over the partitions, and within each. A value that many rows
    share is joined back through salted copies of its one rank row. Null values get a null rank.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    # Written once: a second run of the exchange might number its parts otherwise.
    placed = cut_lineage(values.repartitionByRange(F.col(group), F.col(value).desc()).withColumn("_part", F.spark_partition_id()))
    in_part = Window.partitionBy("_part", group).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(group, "_part").agg(F.sum("_n").alias("_total"))
    before = totals.select(group, "_part", F.coalesce(F.sum("_total").over(over_parts), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_within", F.coalesce(F.sum("_n").over(in_part), F.lit(0))).join(before, [group, "_part"])
    ranked = ranked.select(group, value, (F.col("_before") + F.col("_within") + 1).alias(out))
    copies = ranked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [group, value, "_salt"], "left").drop("_salt")


def rank_column(group: str, value: str) -> Column:
    """The same rank by a window, for groups that fit a task; null where `value` is null."""
    by = Window.partitionBy(group).orderBy(F.col(value).desc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.rank().over(by))

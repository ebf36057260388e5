"""Numbers for the rows of a global order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import cut_lineage


def number_rows(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Row numbers from 1 in the given total order: range parts, their sizes summed, then numbers within each part."""
    # Written once: a second run of the exchange might number its parts otherwise.
    parted = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each part
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")

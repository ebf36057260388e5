"""Reading parquet tables and settling repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """One row for each key: of repeated deliveries the last by `by`, else any of the equal rows.

    A null `by` counts as earliest. Rows with a null key are one key of their own. The choice is
    made by an aggregate, so repeats of a hot key are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    if by is None:
        return df.dropDuplicates(keys)
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    kept = df.groupBy(*keys).agg(F.max_by(row, F.coalesce(F.col(by), F.lit("0001-01-01").cast("timestamp"))).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)

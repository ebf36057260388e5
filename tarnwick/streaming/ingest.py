"""Continuous ingestion: new files of a folder become the newest state of a table, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each new file's rows under its batch number; a batch that is run again replaces itself.

    With the checkpoint the files are read exactly once, across restarts; the query ends when none is left.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(spark: SparkSession, target: str, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, "batch")).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest if c != "batch"])

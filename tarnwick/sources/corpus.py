"""The corpus tables with repeated deliveries settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.tables import latest, load


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = load(spark, folder, "text_chunk")
    return latest(df.select("chunk_key", *[c for c in columns if c != "chunk_key"]) if columns else df, ["chunk_key"])


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return latest(load(spark, folder, "retrieved_chunk"), ["qid", "chunk_key"], "ingested_at")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as doubles, so that sums do not depend on the engine."""
    df = latest(load(spark, folder, "document_chunks").select("vec_key", "document_id", "embedding"), ["vec_key"])
    return df.withColumn("embedding", F.col("embedding").cast("array<double>"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    return latest(load(spark, folder, "pdf_documents"), ["document_id"], "created_at")


def audit(spark: SparkSession, folder: str) -> DataFrame:
    return latest(load(spark, folder, "audit_logs"), ["id"], "ingested_at")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return latest(load(spark, folder, "page_text"), ["page_id"], "ingested_at")


def plans(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "query_plans")

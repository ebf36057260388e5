"""Versioned tables: a generation becomes visible when its manifest is written, and not before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def publish(df: DataFrame, root: str, name: str, run: str, document: str = "document_id") -> None:
    """Write a generation of `df` under its run, then the manifest that makes it the active one of its documents.

    A run that fails before the last write stays invisible; writing the same run again replaces it.
    """
    path = f"{root}/{name}/run_id={run}"
    df.write.mode("overwrite").parquet(path)
    done = df.sparkSession.read.parquet(path).select(document).distinct()
    done.select(document, F.lit(name).alias("table_name"), F.lit(run).alias("run"), F.current_timestamp().alias("published_at")).write.mode("overwrite").parquet(f"{root}/_manifest/{name}-{run}")


def manifest(spark: SparkSession, root: str, name: str, document: str = "document_id") -> DataFrame | None:
    """The active run of each document: the last that was published, by time and name."""
    rows = _read(spark, f"{root}/_manifest/*")
    if rows is None:
        return None
    last = Window.partitionBy(document).orderBy(F.desc("published_at"), F.desc("run"))
    return rows.filter(F.col("table_name") == name).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(document, F.col("run").alias("run_id"))


def active(spark: SparkSession, root: str, name: str, document: str = "document_id") -> DataFrame:
    """The rows of the active generations; rows of other runs are left out by a join with the manifest."""
    runs = manifest(spark, root, name, document)
    if runs is None:
        raise FileNotFoundError(f"no generation of {name} is published")
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/run_id=*")
    return rows.withColumn("run_id", F.col("run_id").cast("string")).join(runs, [document, "run_id"])


def pending(documents: DataFrame, root: str, name: str, run: str, document: str = "document_id") -> DataFrame:
    """Documents whose active generation is not of this run: what an incremental job has to do."""
    runs = manifest(documents.sparkSession, root, name, document)
    return documents if runs is None else documents.join(runs.filter(F.col("run_id") == run), document, "left_anti")


def pdf_files(spark: SparkSession, path: str, largest: int = 64 << 20) -> DataFrame:
    """Files that claim to be PDF: name, size, content, and whether the signature says so; larger ones are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    rows = rows.filter(F.col("length") <= largest)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"), "content")

"""Exact vector search for a stated set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block; the rows meet every block of queries, a block at a time.
QUERIES = 2048


def exact_neighbours(df: DataFrame, key: str, vector: str, queries: str, k: int) -> DataFrame:
    """(query_key, key, similarity, place): the k rows most similar by cosine, for rows with the condition `queries`.

    Rows and queries meet in tiles: queries in blocks of QUERIES, rows in one part for each task, and a tile emits the k best
    of its own only. Null and zero vectors take no part; similarities are rounded to 6 places and ties go by key.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    asked = rows.filter(F.expr(queries.replace(key, "key")))
    blocks = max(1, -(-asked.count() // QUERIES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = asked.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(0).alias("role"), "key", "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)).cast("int").alias("p"), F.lit(1).alias("role"), "key", "v")
    tiles = left.unionByName(right).select(F.xxhash64("b", "p").alias("tile"), "role", "key", "v")
    ordered = tiles.repartition("tile").sortWithinPartitions("tile", "role")
    kind = dict(df.dtypes)[key]

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            names, roles = batch.column("tile").to_numpy(), batch.column("role").to_numpy()
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (roles[1:] != roles[:-1])) + 1), len(names)]
            for a, b in zip(edges, edges[1:]):
                if names[a] != tile:
                    tile, held = names[a], []
                part = batch.slice(a, b - a)
                if roles[a] == 0:
                    held.append(part)
                    continue
                for block in held:
                    yield best(block, part)

    def best(block: pa.RecordBatch, part: pa.RecordBatch) -> pa.RecordBatch:
        q, x = matrix(block), matrix(part)
        qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.maximum(0, (q @ x.T) / np.outer(qn, xn))
        s = np.where(np.isfinite(s), np.round(s, 6), -1)
        some = min(k + 1, s.shape[1])
        # Ties at the edge are kept: every row as good as the last that counts.
        edge = -np.partition(-s, some - 1, axis=1)[:, some - 1]
        i, j = np.nonzero((s >= edge[:, None]) & (s >= 0))
        return pa.RecordBatch.from_arrays([block.column("key").take(pa.array(i)), part.column("key").take(pa.array(j)), pa.array(s[i, j])], ["query_key", "key", "similarity"])

    found = ordered.mapInArrow(run, f"query_key {kind}, key {kind}, similarity double").filter("query_key != key")
    order = Window.partitionBy("query_key").orderBy(F.desc("similarity"), "key")
    top = found.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k)
    return top.withColumnRenamed("key", key)

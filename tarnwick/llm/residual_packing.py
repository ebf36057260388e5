"""Filling containers of fixed capacity by hierarchical residual packing."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.session import cut_lineage

#: Container ids hold round, part and place: 8, 24 and 31 bits.
ROUND, PART = 55, 31


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, largest items first, each into the fullest bin with room."""
    bins = [0] * len(sizes)
    room: list[tuple[int, int]] = []  # free space and bin, sorted
    opened = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            free, b = capacity, opened
            opened += 1
        else:
            free, b = room.pop(at)
        bins[i] = b
        if free > sizes[i]:
            bisect.insort(room, (free - sizes[i], b))
    return bins


def _round(rows: DataFrame, number: int, parts: int, capacity: int, least: int, last: bool) -> DataFrame:
    """Pack the units of each part; a bin with at least `least` filled is done, others become units."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "unit"], T.StructField("unit", T.LongType()), T.StructField("done", T.BooleanType())])
    spread = rows.repartition(parts, F.xxhash64(F.lit(number), "unit"))
    members = schema["members"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        units, sizes, inside = [], [], []
        for batch in batches:
            units += batch.column("unit").to_pylist()
            sizes += batch.column("size").to_pylist()
            inside += batch.column("members").to_pylist()
        if not units:
            return
        order = sorted(range(len(units)), key=units.__getitem__)  # no dependence on the order of arrival
        sizes, inside = [sizes[i] for i in order], [inside[i] for i in order]
        filled: dict[int, int] = {}
        packed: dict[int, list] = {}
        for i, b in enumerate(best_fit(sizes, capacity)):
            filled[b] = filled.get(b, 0) + sizes[i]
            packed.setdefault(b, []).extend(inside[i])
        ids = [(number << ROUND) | (part << PART) | b for b in filled]
        done = [last or n >= least for n in filled.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled.values(), pa.int64()), pa.array([packed[b] for b in filled], to_arrow(members)), pa.array(ids, pa.int64()), pa.array(done)],
            ["size", "members", "unit", "done"],
        )

    return spread.mapInArrow(run, T.StructType([schema["size"], schema["members"], schema["unit"], schema["done"]]))


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def pack(sizes: DataFrame, item: str, size: str, capacity: int, slack: float = 0.02, bins_per_part: int = 512, fan_in: int = 16) -> DataFrame:
    """Put items of varying size into containers of `capacity`, splitting only an item that alone exceeds it.

    Method: items are spread over parts and packed best-fit there; bins filled to 1 - `slack` are done, the
    others are carried as units into fewer parts, up a tree, and packed again until one part is left.

    Rows are (container_id, item, piece, size, oversize, filled, capacity). An item over capacity is cut into
    full pieces, a container each, and a last piece that is packed like an item. Items with no size (null or
    not positive) need no container: theirs is null, filled 0. Sizes are expected once for each item; a null
    item is left out. An empty table gives an empty result. Ties are settled by unit ids, so the result
    depends neither on the order of the rows nor on their place in files. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = dict(sizes.dtypes)[item]
    rows = sizes.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    rows = cut_lineage(rows)  # sizes come from whole texts: count those once
    over = F.col("n") > capacity
    full = F.when(over, F.floor(F.col("n") / capacity)).otherwise(F.lit(0))
    rest = F.when(over, F.col("n") % capacity).otherwise(F.col("n"))
    cut = rows.filter(F.col("n") > 0).select("item", over.alias("oversize"), full.alias("full"), rest.alias("rest"))
    whole = cut.filter("full > 0").select("item", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"), F.lit(capacity).cast("long").alias("size"), F.lit(True).alias("oversize"))
    loose = cut.filter("rest > 0").select(
        F.col("rest").alias("size"),
        F.array(F.struct("item", F.col("full").cast("int").alias("piece"), F.col("rest").alias("size"), "oversize")).alias("members"),
        F.xxhash64("item").alias("unit"),
    )
    total = loose.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least = capacity - int(capacity * slack)
    parts = max(1, -(-total // (capacity * bins_per_part)))
    done, number = [], 1
    units = loose
    while True:
        last = parts == 1
        state = _round(units, number, parts, capacity, least, last)
        if last:
            done.append(state)
            break
        state = cut_lineage(state)
        done.append(state.filter("done"))
        units = state.filter("NOT done").drop("done")
        parts, number = -(-parts // fan_in), number + 1
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    packed = bins.select(F.col("unit").alias("container_id"), F.col("size").alias("filled"), F.explode("members").alias("m"))
    packed = packed.select("container_id", F.col("m.item").alias("item"), F.col("m.piece").alias("piece"), F.col("m.size").alias("size"), F.col("m.oversize").alias("oversize"), "filled")
    # Full pieces of an oversize item come with ids below zero, from item and piece.
    own = whole.select((-F.abs(F.xxhash64("item", "piece") % F.lit(2**62)) - 1).alias("container_id"), "item", "piece", "size", "oversize", F.lit(capacity).cast("long").alias("filled"))
    empty = rows.filter("n <= 0").select(F.lit(None).cast("long").alias("container_id"), "item", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("oversize"), F.lit(0).cast("long").alias("filled"))
    out = packed.unionByName(own).unionByName(empty).withColumn("capacity", F.lit(capacity).cast("long"))
    return out.select("container_id", F.col("item").cast(kind).alias(item), "piece", "size", "oversize", "filled", "capacity")

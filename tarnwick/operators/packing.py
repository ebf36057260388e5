"""Greedy, order-dependent steps: one pass over each query's or document's rows, in Arrow groups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: T.StructType, fn: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Run `fn` over the rows of each group in the given order; a group is what one query or document returns.

    Rows are shuffled and sorted by Spark and read as a stream, so that only one group is held at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        name = None
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if held and key != name:
                    yield pa.RecordBatch.from_pylist(fn(held), schema=arrow)
                    held = []
                name = key
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(fn(held), schema=arrow)

    return ordered.mapInArrow(run, schema)


def per_row(df: DataFrame, schema: T.StructType, fn: Callable[[dict], list[dict]], rows: int = 256) -> DataFrame:
    """Run `fn` over each row where it is read, `rows` of them at a time; nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pylist([out for row in batch.slice(at, rows).to_pylist() for out in fn(row)], schema=arrow)

    return df.mapInArrow(run, schema)


def half_fill_mixed_cap(rows: list[dict], document: str, kind: str, limit: int, cap: int, table_cap: int) -> list[dict]:
    """Rows in rank order; once half of the limit is filled a document may have `cap` rows, table rows up to `table_cap`."""
    taken: dict = {}
    out: list[dict] = []
    for row in rows:
        if len(out) == limit:
            break
        most = table_cap if row[kind] == "table_row" else cap
        if len(out) >= limit // 2 and taken.get(row[document], 0) >= most:
            continue
        taken[row[document]] = taken.get(row[document], 0) + 1
        out.append(row)
    return out


def diversify(rows: list[dict], terms: str, page: Sequence[str], limit: int, per_page: int = 2, alike: float = 0.88) -> list[dict]:
    """Rows in rank order without those too like a kept one, and no more than `per_page` of a page."""
    kept: list[dict] = []
    sets: list[set] = []
    pages: dict = {}
    for row in rows:
        at, own = tuple(row[p] for p in page), set(row[terms] or [])
        if pages.get(at, 0) >= per_page:
            continue
        if own and any(len(own & s) >= alike * len(own | s) for s in sets):
            continue
        kept.append(row)
        sets.append(own)
        pages[at] = pages.get(at, 0) + 1
        if len(kept) == limit:
            break
    return kept


def batches(rows: list[dict], size: str, most: int, out: str) -> list[dict]:
    """Consecutive rows together up to `most`; a row larger than that is alone."""
    number, used = 0, 0
    result = []
    for row in rows:
        if used and used + row[size] > most:
            number, used = number + 1, 0
        used += row[size]
        result.append({**row, out: number})
    return result


def paragraphs(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed up to `size`, each piece beginning with the last whole paragraphs of the one before, up to `overlap`."""
    parts = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    pieces: list[list[str]] = []
    current: list[str] = []
    for part in parts:
        for unit in [part[i : i + size] for i in range(0, len(part), size)]:
            if current and sum(map(len, current)) + 2 * len(current) + len(unit) > size:
                pieces.append(current)
                tail: list[str] = []
                for p in reversed(current[-3:]):
                    if sum(map(len, tail)) + len(p) > overlap:
                        break
                    tail.insert(0, p)
                current = tail if sum(map(len, tail)) + 2 * len(tail) + len(unit) <= size else []
            current.append(unit)
    return ["\n\n".join(p) for p in [*pieces, current] if p]


def table_pieces(text: str, size: int, headers: int = 2) -> list[str]:
    """Rows of a table packed up to `size`; each piece begins with the header lines, and no row is cut."""
    lines = [x for x in text.split("\n") if x.strip()]
    head, rows = lines[:headers], lines[headers:]
    if not rows:
        return ["\n".join(head)] if head else []
    pieces, current = [], []
    room = size - sum(len(x) + 1 for x in head)
    for row in rows:
        if current and sum(len(x) + 1 for x in current) + len(row) > room:
            pieces.append(current)
            current = []
        current.append(row)
    return ["\n".join([*head, *p]) for p in [*pieces, current]]


def long_unit(text: str, target: int, overlap: int) -> list[str]:
    """Sentences packed up to `target`; a sentence above it is cut into steps that overlap."""
    pieces: list[str] = []
    current = ""
    for sentence in re.split(r"(?<=[.!?;])\s+", text.strip()):
        if len(sentence) > target:
            if current:
                pieces.append(current)
                current = ""
            step = max(1, target - overlap)
            pieces += [sentence[i : i + target] for i in range(0, max(1, len(sentence) - overlap), step)]
        elif current and len(current) + 1 + len(sentence) > target:
            pieces.append(current)
            current = sentence
        else:
            current = f"{current} {sentence}" if current else sentence
    return [*pieces, current] if current else pieces

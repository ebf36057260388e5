"""A deterministic lexical embedding without a model: signed hashing of words, character runs and word pairs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of the features, and the share of a feature's second slot.
WORD, RUNS, PAIR, SECOND = 1.0, {3: 0.35, 4: 0.2}, 0.7, 0.5
TOKEN = re.compile(r"\w+", re.UNICODE)

_slots: dict[str, tuple[int, float, int, float]] = {}


def _slot(feature: str) -> tuple[int, float, int, float]:
    found = _slots.get(feature)
    if found is None:
        if len(_slots) > 300_000:
            _slots.clear()
        d = hashlib.blake2b(feature.encode(), digest_size=16).digest()
        low, high = np.frombuffer(d, "<u8").tolist()
        found = _slots[feature] = (low, 1.0 if d[0] & 1 else -1.0, high, 1.0 if d[8] & 1 else -1.0)
    return found


def features(text: str | None) -> dict[str, float]:
    """What a text consists of, and with which weight; a text without words has one feature of its own."""
    words = [w.casefold() for w in TOKEN.findall(text or "")] or ["__empty__"]
    out: dict[str, float] = {}

    def add(name: str, weight: float) -> None:
        out[name] = out.get(name, 0.0) + weight

    for word in words:
        add(f"w:{word}", WORD)
        edged = f"^{word}$"
        for size, weight in RUNS.items():
            for i in range(len(edged) - size + 1):
                add(f"c{size}:{edged[i : i + size]}", weight)
    for a, b in zip(words, words[1:]):
        add(f"b:{a}|{b}", PAIR)
    return out


def embed(texts: list[str | None], dimensions: int) -> np.ndarray:
    if dimensions < 64:
        raise ValueError("at least 64 dimensions")
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts):
        for name, weight in features(text).items():
            a, sa, b, sb = _slot(name)
            row[a % dimensions] += weight * sa
            row[b % dimensions] += weight * sb * SECOND
        norm = np.linalg.norm(row)
        if norm > 0:
            row /= norm
    return out


def hashing_embeddings(df: DataFrame, key: str, text: str, dimensions: int = 384) -> DataFrame:
    """(key, embedding): unit vectors; a null text is embedded like an empty one."""
    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = embed(batch.column("_text").to_pylist(), dimensions).astype(np.float32)
            edges = pa.array(np.arange(0, flat.size + 1, dimensions, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(edges, pa.array(flat.ravel()))], [key, "embedding"])

    return rows.mapInArrow(run, f"`{key}` {kind}, embedding array<float>")

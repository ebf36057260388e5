"""Token counts of a public byte-level tokenizer, through Arrow batches."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import bounded

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The split rule published with this vocabulary; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The counts of words kept by a worker; a full memo starts anew.
MEMO = 200_000

_counters: dict[str, TokenCounter] = {}
_RUN = re.compile(r"\s ")


class TokenCounter:
    """Counts the tokens of whole texts, exactly as the tokenizer would.

    The split rule never joins what stands before a single blank with what follows it, so the count of a
    text is the sum of the counts of its words, each with the blank before it. Counts of words are kept.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def count(self, text: str) -> int:
        if _RUN.search(text) or text[-1:] == " ":
            return len(self.encoding.encode_ordinary(text))  # runs of blanks share tokens
        words = text.split(" ")
        total = len(self.encoding.encode_ordinary(words[0]))
        memo = self.memo
        try:
            return total + sum(map(memo.__getitem__, words[1:]))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        encode = self.encoding.encode_ordinary
        for word in words[1:]:
            n = memo.get(word)
            if n is None:
                n = memo[word] = len(encode(" " + word))
            total += n
        return total


def counter(vocabulary: str = VOCABULARY) -> TokenCounter:
    if vocabulary not in _counters:
        _counters[vocabulary] = TokenCounter(vocabulary)
    return _counters[vocabulary]


def _shipped(df: DataFrame, vocabulary: str) -> str:
    """The vocabulary's file goes to every executor with the job, so that only the driver needs to have it."""
    context = df.sparkSession.sparkContext
    name = os.path.basename(vocabulary)
    if os.path.exists(vocabulary) and not any(path.endswith(f"/{name}") for path in context.listFiles):
        context.addFile(vocabulary)
    return name


def token_sizes(df: DataFrame, key: str, text: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, keep..., n_tokens): whole texts are counted; a null text has no tokens. Rows with a null key are left out.

    One row for each key: of repeated keys the largest size counts, with the greatest kept values.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, *keep, F.col(text).alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    names = [f.name for f in fields]

    name = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        count = counter(SparkFiles.get(name)).count
        for batch in bounded(batches, "_text"):
            sizes = [0 if t is None else count(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sizes, pa.int64())], [*names, "n_tokens"])

    schema = rows.select(*names, F.lit(0).cast("long").alias("n_tokens")).schema
    sized = rows.mapInArrow(run, schema)
    best = F.max(F.struct("n_tokens", *keep)).alias("_best")
    return sized.groupBy(key).agg(best).select(key, *[F.col("_best")[k].alias(k) for k in keep], F.col("_best.n_tokens").alias("n_tokens"))

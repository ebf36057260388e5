"""Lines repeated across one source's documents, by content-defined chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.arrow import bounded
from tarnwick.session import cut_lineage

#: Rolling hash: letters of the window, multiplier; fixed values.
WINDOW, BASE = 4, np.uint64(0x9E3779B97F4A7C15)
#: So many excessive chunks or lines (24 bytes each) may be broadcast; more are met by a merge join, which adaptive execution splits.
BROADCAST_KEYS = 1 << 20
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(line: str) -> str:
    """The line reduced to its lower-cased letters."""
    return _NOT_LETTERS.sub("", line).lower()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _run_hashes(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each of the runs that cover the letters: every letter turned by its place in the run."""
    with np.errstate(over="ignore"):
        place = np.arange(len(code)) - np.repeat(starts, sizes)
        sums = np.add.reduceat(_mix(code * BASE + place.astype(np.uint64)), starts) if len(starts) else np.zeros(0, np.uint64)
        return _mix(sums + sizes.astype(np.uint64)).view(np.int64)


def chunk_streams(code: np.ndarray, sizes: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of streams of letters, `sizes` letters each: (start, size, hash, natural) of each chunk.

    A chunk ends where the rolling hash of the last WINDOW letters falls into one of `mean` parts, wherever lines end;
    and, not `natural`, where the stream ends.
    """
    total = len(code)
    if total == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        roll = np.zeros(total, np.uint64)
        power = np.uint64(1)
        for back in range(WINDOW):
            roll[back:] += code[: total - back] * power
            power *= BASE
        cut = (_mix(roll) % np.uint64(mean) == 0) & (at >= WINDOW - 1)
    natural = cut.copy()
    cut[np.cumsum(sizes)[sizes > 0] - 1] = True
    ends = np.flatnonzero(cut)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts + 1
    return starts, lengths, _run_hashes(code, starts, lengths), natural[ends]


def page_chunks(pages: list[str | None], mean: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of pages of text: (page, hash) of their distinct chunks, and (page, line_no, whole, lead, has_lead) of their lines with letters.

    The letters of a page are one stream; its lines play no part in the chunks. A chunk lies inside a line if both its ends were
    decided by letters of the line: then it is there wherever the line is. `lead` is the longest of these.
    """
    split = [[] if t is None else t.split("\n") for t in pages]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    lines = [letters(line) for page in split for line in page]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    page_of = np.repeat(np.arange(len(split)), counts)
    number = np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    code = _codes(lines)
    stream = np.bincount(page_of, sizes, minlength=len(split)).astype(np.int64)
    starts, lengths, hashes, natural = chunk_streams(code, stream, mean)
    owner = np.repeat(np.arange(len(split)), stream)
    pairs = np.unique(np.stack([owner[starts], hashes]), axis=1) if len(starts) else np.zeros((2, 0), np.int64)
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    whole = _run_hashes(code, first, sizes[some])
    lead, has = np.zeros(len(some), np.int64), np.zeros(len(some), bool)
    if len(starts):
        line = np.searchsorted(first, starts, "right") - 1
        inside = natural & (starts >= first[line] + WINDOW) & (starts + lengths <= first[line] + sizes[some][line])
        order = np.flatnonzero(inside)[np.lexsort((-lengths[inside], line[inside]))]
        found, at = np.unique(line[order], return_index=True)
        lead[found], has[found] = hashes[order[at]], True
    return (pairs[0], pairs[1]), (page_of[some], number[some].astype(np.int32), whole, lead, has)


def _lists(page: np.ndarray, pages: int, *values: pa.Array) -> list[pa.ListArray]:
    edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(page, minlength=pages))]).astype(np.int32))
    return [pa.ListArray.from_arrays(edges, v) for v in values]


def _chunks(pages: DataFrame, mean: int) -> DataFrame:
    """(source, page, chunk, line, whole, lead): each page's distinct chunks, and of its lines with letters the number, the
    hash of all letters, and the longest chunk inside (null if there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1_000_000):  # the work arrays take some 100 bytes a letter
            (page, chunk), (on, line, whole, lead, has) = page_chunks(batch.column("text").to_pylist(), mean)
            lists = [*_lists(page, batch.num_rows, pa.array(chunk)), *_lists(on, batch.num_rows, pa.array(line), pa.array(whole), pa.array(lead, mask=~has))]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("page"), *lists], ["source", "page", "chunk", "line", "whole", "lead"])

    longs = T.ArrayType(T.LongType())
    kinds = [pages.schema["source"], pages.schema["page"], T.StructField("chunk", longs), T.StructField("line", T.ArrayType(T.IntegerType())), T.StructField("whole", longs), T.StructField("lead", longs)]
    return pages.mapInArrow(run, T.StructType(kinds))


def _pages(df: DataFrame, source: str, page: str, text: str) -> DataFrame:
    rows = df.select(F.col(source).alias("source"), F.col(page).alias("page"), F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.col("page").isNotNull() & F.col("source").isNotNull())
    return rows.groupBy("page").agg(F.max(F.struct("source", "text")).alias("_r")).select("page", "_r.source", "_r.text")


def _excessive(seen: DataFrame, sizes: DataFrame, value: str, pages: int, share: float) -> DataFrame:
    """(source, value, on, of) that stand on at least `pages` pages and `share` of the source's pages; hinted for a join."""
    counted = seen.groupBy("source", value).agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= pages)
    out = cut_lineage(counted.join(sizes.hint("merge"), "source").filter(F.col("on") >= F.col("of") * F.lit(share) - 1e-9).select("source", value, "on", "of"))
    return F.broadcast(out) if out.count() <= BROADCAST_KEYS else out.hint("merge")


def repeated_lines(df: DataFrame, source: str, page: str, text: str, min_pages: int = 4, min_share: float = 0.3, mean_chunk: int = 12) -> DataFrame:
    """Lines that come back on many of their source's pages: (source, page, line_no, on_pages, of_pages).

    Method: the letters of a page, lower-cased, are one stream that a rolling hash cuts into content-defined chunks, whatever
    its lines; distinct pages are counted for each chunk and source, and chunks on at least `min_pages` and `min_share` of the
    source's pages are excessive. Mapped back to lines (the pieces of the text between newlines, counted from 1), a line whose longest
    chunk inside is not excessive is not repeated; of the others, with those too short to have a chunk inside, the letters are counted exactly
    in the same way. Lines without letters are never repeated. All pages count, blank and null ones too, each page once:
    of repeated pages the one with the greatest source and text. Rows with a null page or source are left out; other columns are ignored.

    A page emits each of its chunks once and counts are combined before the shuffle. What is excessive is broadcast where it is
    small, and the many rows of one notice are not shuffled; otherwise they meet it in a merge join that is split where it is skewed.
    """
    chunks = cut_lineage(_chunks(_pages(df, source, page, text), mean_chunk))
    kind = dict(df.dtypes)[page]
    found = _repeated(chunks, min_pages, min_share)
    return found.select(F.col("source").alias(source), F.col("page").cast(kind).alias(page), "line_no", "on_pages", "of_pages")


def _repeated(chunks: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    sizes = cut_lineage(chunks.groupBy("source").agg(F.count(F.lit(1)).alias("of")))
    often = _excessive(chunks.select("source", F.explode("chunk").alias("lead")), sizes, "lead", min_pages, min_share)
    parts = chunks.select("source", "page", F.explode(F.arrays_zip("line", "whole", "lead")).alias("z"))
    parts = parts.select("source", "page", F.col("z.line").alias("line_no"), "z.whole", "z.lead")
    lines = parts.filter("lead IS NOT NULL").join(often.select("source", "lead"), ["source", "lead"], "left_semi").select("source", "page", "line_no", "whole")
    lines = cut_lineage(lines.unionByName(parts.filter("lead IS NULL").select("source", "page", "line_no", "whole")))
    # A page that has a line twice counts once.
    once = lines.groupBy("source", "whole", "page").agg(F.lit(1).alias("one"))
    whole = _excessive(once, sizes, "whole", min_pages, min_share)
    return lines.join(whole, ["source", "whole"]).select("source", "page", "line_no", F.col("on").alias("on_pages"), F.col("of").alias("of_pages"))


def without_repeated_lines(df: DataFrame, source: str, page: str, text: str, min_pages: int = 4, min_share: float = 0.3, mean_chunk: int = 12) -> DataFrame:
    """Every page with the repeated lines cut: (page, source, kept_text, cut_lines). Null texts stay null.

    Parameters and the treatment of repeated rows and nulls as in `repeated_lines`.
    """
    pages = _pages(df, source, page, text)
    found = repeated_lines(df, source, page, text, min_pages, min_share, mean_chunk)
    gone = found.groupBy(F.col(page).alias("page")).agg(F.collect_set("line_no").alias("gone"))  # no more than the lines of a page
    joined = pages.join(gone.hint("merge"), "page", "left")
    numbered = F.arrays_zip(F.split("text", "\n").alias("t"), F.sequence(F.lit(1), F.size(F.split("text", "\n"))).alias("n"))
    kept: Column = F.transform(F.filter(numbered, lambda x: ~F.array_contains("gone", x["n"])), lambda x: x["t"])
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(F.col("page").alias(page), F.col("source").alias(source), clean.alias("kept_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("cut_lines"))


def without_repeated_chunks(df: DataFrame, source: str, page: str, text: str, min_pages: int = 4, min_share: float = 0.3, mean_chunk: int = 12, least: int = 3) -> DataFrame:
    """Every page with runs of excessive chunks cut, however they are broken into lines: (page, source, kept_text, cut_letters).

    A run of at least `least` excessive chunks is cut from its first letter to its last, with the blanks, digits and marks between; so a
    notice goes that is wrapped otherwise on every page, but for a chunk at either end that reaches into its neighbours. Chunks,
    parameters, repeated rows and nulls as in `repeated_lines`. Null texts stay null.
    """
    pages = cut_lineage(_pages(df, source, page, text))
    chunks = cut_lineage(_chunks(pages, mean_chunk).select("source", "page", "chunk"))
    sizes = cut_lineage(chunks.groupBy("source").agg(F.count(F.lit(1)).alias("of")))
    often = _excessive(chunks.select("source", F.explode("chunk").alias("lead")), sizes, "lead", min_pages, min_share)
    met = chunks.select("source", "page", F.explode("chunk").alias("lead")).join(often.select("source", "lead"), ["source", "lead"], "left_semi")
    per = met.groupBy("page").agg(F.collect_list("lead").alias("gone"))  # no more than a page's chunks
    joined = pages.join(per.hint("merge"), "page", "left").select("page", "source", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1_000_000):
            kept, cut = [], []
            for t, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                t, n = cut_chunks(t, set(gone or ()), mean_chunk, least)
                kept.append(t)
                cut.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("source"), pa.array(kept, pa.string()), pa.array(cut, pa.int32())], ["page", "source", "kept_text", "cut_letters"])

    shape = T.StructType([joined.schema["page"], joined.schema["source"], T.StructField("kept_text", T.StringType()), T.StructField("cut_letters", T.IntegerType())])
    done = joined.mapInArrow(run, shape)
    return done.select(F.col("page").alias(page), F.col("source").alias(source), "kept_text", "cut_letters")


def cut_chunks(text: str | None, gone: set[int], mean: int, least: int) -> tuple[str | None, int]:
    """The text without its runs of at least `least` chunks in `gone`, and how many letters were cut."""
    if not text or not gone:
        return text, 0
    runs = [(m.start(), m.group()) for m in _LETTERS.finditer(text)]
    stream = [(start + i, low) for start, word in runs for i, c in enumerate(word) for low in c.lower()]  # a letter may have two lower ones
    starts, lengths, hashes, _ = chunk_streams(_codes([c for _, c in stream]), np.array([len(stream)]), mean)
    bad = np.array([h in gone for h in hashes.tolist()] + [False])
    kept, at, n, k = [], 0, 0, 0
    while k < len(starts):
        if not bad[k]:
            k += 1
            continue
        end = k + int(np.argmin(bad[k:]))
        if end - k >= least:
            last = starts[end - 1] + lengths[end - 1] - 1
            kept.append(text[at : stream[starts[k]][0]])
            at = stream[last][0] + 1
            n += int(last - starts[k] + 1)
        k = end
    return "".join([*kept, text[at:]]), n

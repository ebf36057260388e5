"""Splitting oversized items at natural boundaries, by packing the tree of their structure."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.arrow import bounded

Span = tuple[int, int]

#: A heading and what tells its depth: marks, markup, a number with its parts, or capitals (depth 1).
HEADING = re.compile(r"(?m)^[ \t]*(?:(?P<marks>#{1,6})[ \t]+\S|<h(?P<tag>[1-6])[ >]|(?P<number>(?:\d+\.)*\d+)\.?[ \t]+[A-ZÀ-Þ][^.!?\n]{0,80}$|[A-ZÀ-Þ][A-ZÀ-Þ0-9 ,&/()'-]{2,80}$)")
PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
FENCE = re.compile(r"(?m)^[ \t]*(```|~~~)")
TABLE = re.compile(r"(?m)(?:^[ \t]*\|.*(?:\n|\Z))+")
ITEM = re.compile(r"(?m)^(?P<indent>[ \t]*)(?:[-*•–]|\(?[a-zA-Z0-9]{1,3}[.)])[ \t]+\S")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?…][\"'”»)\]]*\s+(?=[\"'“«(\[]*[^\W_])|[。！？]")
CLAUSE = re.compile(r"[;:,|]\s+")
WORD = re.compile(r"\s+")

#: From the outermost boundary inwards.
KINDS = ("heading", "paragraph", "block", "item", "line", "sentence", "clause", "word", "character")
HEADINGS, PARAGRAPHS, BLOCKS, ITEMS, LINES, SENTENCES, CLAUSES, WORDS, CHARACTERS = range(9)
_ENDS = {PARAGRAPHS: PARAGRAPH, LINES: LINE, SENTENCES: SENTENCE, CLAUSES: CLAUSE, WORDS: WORD}


def fences(text: str) -> list[Span]:
    """Stretches of fenced code, with their marks; an open fence goes on to the end."""
    marks = list(FENCE.finditer(text)) if "```" in text or "~~~" in text else []
    out, i = [], 0
    while i < len(marks):
        close = next((m for m in marks[i + 1 :] if m.group(1) == marks[i].group(1)), None)
        end = len(text) if close is None else (text.find("\n", close.end()) + 1 or len(text))
        out.append((marks[i].start(), end))
        i = len(marks) if close is None else marks.index(close) + 1
    return out


def _depth(match: re.Match) -> int:
    if match["marks"]:
        return len(match["marks"])
    if match["tag"]:
        return int(match["tag"])
    return match["number"].count(".") + 1 if match["number"] else 1


def _outermost(found: list[tuple[int, int]]) -> list[int]:
    """The places with the least depth."""
    least = min((d for _, d in found), default=0)
    return [at for at, d in found if d == least]


def children(text: str, span: Span, level: int, code: list[Span]) -> tuple[list[Span], int, int]:
    """The parts of a span at the outermost level, from `level` on, that divides it; that level; and the level to open the parts at.

    Headings and items are trees of their own: a section is cut at the least deep headings below its own, a list at its
    least indented items. Fenced code and tables are blocks; inside code neither headings nor items nor paragraphs are seen.
    """
    start, end = span
    inside = [(a, b) for a, b in code if a < end and b > start]

    def free(at: int) -> bool:
        return start < at < end and not any(a < at < b for a, b in inside)

    for at in range(level, CHARACTERS):
        if at == HEADINGS:
            cuts = _outermost([(m.start(), _depth(m)) for m in HEADING.finditer(text, start, end) if free(m.start()) and not any(a == m.start() for a, _ in inside)])
        elif at == ITEMS:
            cuts = _outermost([(m.start(), len(m["indent"].expandtabs(4))) for m in ITEM.finditer(text, start, end) if free(m.start())])
        elif at == BLOCKS:
            edges = {x for m in TABLE.finditer(text, start, end) for x in m.span()} | {x for piece in inside for x in piece}
            cuts = sorted(x for x in edges if free(x))
        else:
            cuts = [m.end() for m in _ENDS[at].finditer(text, start, end)]
            cuts = [c for c in cuts if (free(c) if at < LINES else start < c < end)]
        if cuts:
            edges = [start, *cuts, end]
            return list(zip(edges, edges[1:])), at, at if at in (HEADINGS, ITEMS) else at + 1
    return [], CHARACTERS, CHARACTERS


def _bare(text: str, span: Span) -> bool:
    """A part that is nothing but one heading line."""
    part = text[slice(*span)].strip()
    return "\n" not in part and bool(HEADING.match(part))


def _characters(text: str, span: Span, limit: int) -> list[Span]:
    """Cuts of a word that is too long, never before a combining mark unless nothing else is left."""
    out, start = [], span[0]
    while span[1] - start > limit:
        end = start + limit
        while end > start + 1 and unicodedata.combining(text[end]):
            end -= 1
        if end == start + 1 and limit > 1:
            end = start + limit
        out.append((start, end))
        start = end
    return [*out, (start, span[1])]


def pack_tree(text: str, span: Span, limit: int, level: int = HEADINGS, found: int = HEADINGS, code: list[Span] | None = None) -> list[tuple[Span, int]]:
    """Spans of at most `limit` characters that cover `span`, with the level of the boundary before each.

    A node that fits is one piece. Of a larger one, children that fit and follow each other are merged from the left while they
    fit; a child that does not fit is opened, and its pieces are joined with nothing outside it. A heading
    that stands alone goes with the part after it.
    """
    if span[1] - span[0] <= limit:
        return [(span, found)]
    code = fences(text) if code is None else code
    parts, at, after = children(text, span, level, code)
    if not parts:
        return [(p, found if i == 0 else CHARACTERS) for i, p in enumerate(_characters(text, span, limit))]
    if at in (PARAGRAPHS, LINES):
        for i in range(len(parts) - 2, -1, -1):
            if _bare(text, parts[i]):
                parts[i : i + 2] = [(parts[i][0], parts[i + 1][1])]
    if len(parts) == 1:
        return pack_tree(text, span, limit, at + 1, found, code)
    out: list[tuple[Span, int]] = []
    open_run = False  # the last piece is a run of whole children
    for i, part in enumerate(parts):
        before = found if i == 0 else at
        if part[1] - part[0] > limit:
            out += pack_tree(text, part, limit, after, before, code)
            open_run = False
        elif open_run and part[1] - out[-1][0][0] <= limit:
            out[-1] = ((out[-1][0][0], part[1]), out[-1][1])
        else:
            out.append((part, before))
            open_run = True
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, level) of each piece: ends at the tree's boundaries, starts `overlap` before the last end.

    The overlap is at most half of the limit. Text without its overlaps is the text again.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    overlap = max(0, min(overlap, limit // 2))
    if len(text) <= limit:
        return [(0, len(text), 0)]
    spans = pack_tree(text, (0, len(text)), limit - overlap)
    if len(spans) > 1 and spans[0][0][1] < overlap:
        spans = [((0, spans[1][0][1]), 0), *spans[2:]]  # too short to be overlapped by; with the next one it fits, having no overlap before it
    return [(max(0, start - overlap), end, level) for (start, end), level in spans]


def split_oversized(df: DataFrame, key: str, text: str, limit: str, overlap: str, *keep: str) -> DataFrame:
    """Pieces of every row whose text has more characters than its `limit`; rows that fit give none.

    Method: headings with their depth, paragraphs, code and tables, nested items, lines, sentences, clauses and words make a tree;
    siblings that fit are merged bottom-up, and only a node over the limit is opened (`pack_tree`).

    Rows are (key, keep..., piece, start, end, boundary, piece_text): pieces in the order of the text, at most
    `limit` characters long, each after the first beginning with the last `overlap` characters of the one before
    (at most half the limit). `boundary` names the kind of boundary before the piece's own part. Characters are
    Unicode code points. Null texts, keys and limits give no pieces, nor does a limit below 1; a null or negative
    overlap is 0. One set of pieces for each key: of repeated keys the one with the greatest text. Kept columns may be nested and null;
    other columns, also ones named like the new ones, are ignored. Whole texts are read; nothing is shuffled but oversized rows.
    """
    rows = df.select(F.col(key), *[F.col(k) for k in keep], F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.greatest(F.coalesce(F.col(overlap).cast("int"), F.lit(0)), F.lit(0)).alias("_overlap"))
    rows = rows.filter(F.col(key).isNotNull() & (F.col("_limit") >= 1) & (F.char_length("_text") > F.col("_limit")))
    rest = [c for c in rows.columns if c != key]
    rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_text", "_limit")).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])
    names = [key, *keep]
    fields = [rows.schema[n] for n in names]
    new = [T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("boundary", T.StringType()), ("piece_text", T.StringType()))]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text"):
            take, columns = [], [[], [], [], [], []]
            for i, (t, size, lap) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_text", "_limit", "_overlap")))):
                for n, (start, end, level) in enumerate(split_text(t, size, lap)):
                    take.append(i)
                    for column, value in zip(columns, (n, start, end, KINDS[level], t[start:end])):
                        column.append(value)
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(index) for n in names), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*names, *(f.name for f in new)])

    return rows.mapInArrow(run, T.StructType([*fields, *new]))

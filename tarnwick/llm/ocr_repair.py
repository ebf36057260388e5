"""Repair of text from scanned pages: joined words, misread words, margins, paragraphs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.arrow import bounded
from tarnwick.llm.boosting import Boosted, boost
from tarnwick.session import cut_lineage

# Usual misreadings, as (read as, stands for)
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("lc", "k"), ("in", "m"), ("iii", "m"),
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("0", "o"), ("o", "0"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("l", "1"), ("5", "s"), ("s", "5"), ("8", "b"), ("6", "b"), ("6", "g"),
    ("9", "g"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("2", "z"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("q", "g"), ("g", "q"), ("j", "i"), ("i", "j"), ("!", "l"), ("|", "l"), ("$", "s"),
)
HYPHENS = r"\-¬\u00ad\u2010\u2011"

CODE = re.compile(r"^\W*[A-Za-z]{1,3}[-–]?\d+(?:[/.–-][A-Za-z\d]+)*\W*$")
PAGE = re.compile(r"(?i)^[\W_]*(?:(?:page|pg|p|seite|s|sheet|folio|blatt|página|pág|no)\b[\W_]*)?(?:\d{1,5}|[ivxlc]{1,7})(?:\s*(?:of|/|von|de|sur)\s*\d{1,5})?[\W_]*$")
ROMAN = re.compile(r"(?i)^[\W_]*(?:page|pg|p)?[\W_]*(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})[\W_]*$")
CORE = re.compile(r"^[^\w]*(.*?)[^\w]*$")
LETTER = re.compile(r"[^\W\d_]")
CUT = re.compile(rf"([^\W\d_][\w{HYPHENS}]*|[^\W_]+)[{HYPHENS}]\s*$")
START = re.compile(rf"^\s*([^\W_][\w]*(?:[{HYPHENS}][^\W_]\w*)*)")
NUMBERED = re.compile(r"^\d+\.\s")
PLAIN = re.compile(r"[^\W\d_]+")


def is_page_number(line: str) -> bool:
    """A line that is a page number only, in digits or Roman numerals, with or without a word for it."""
    if len(line) > 40 or not PAGE.match(line):
        return False
    return any(c.isdigit() for c in line) or bool(ROMAN.match(line))


def reduced(line: str) -> int:
    """Hash of the line's lower-cased letters; 0 without letters."""
    text = re.sub(r"[\W\d_]+", "", line).lower()
    return zlib.crc32(text.encode()) << 8 | min(len(text), 255) if text else 0


_cores: dict[str, tuple[str, str]] = {}


def _core(token: str) -> tuple[str, str]:
    if len(_cores) > 200_000:
        _cores.clear()
    core = CORE.match(token).group(1)
    found = _cores[token] = (core, core.lower() if LETTER.search(core) and not CODE.match(core) else "")
    return found


_lowers: dict[str, str] = {}


def lower_words(line: str) -> list[str]:
    """The lower-cased cores of `words_of` alone."""
    tokens = line.split()
    try:
        return list(map(_lowers.__getitem__, tokens))
    except KeyError:
        if len(_lowers) > 200_000:
            _lowers.clear()
        for token in tokens:
            if token not in _lowers:
                _lowers[token] = _core(token)[1]
        return list(map(_lowers.__getitem__, tokens))


def words_of(line: str) -> list[tuple[str, str]]:
    """(core as written, lower-cased core) of each token; the core of a token without letters or of a code is ''."""
    get = _cores.get
    return [get(token) or _core(token) for token in line.split()]


_DIGIT = re.compile(r"\d")


def _ended(line: str) -> bool:
    """Does a line end like a sentence, quotes and brackets aside?"""
    return line.rstrip().rstrip("\"')]")[-1:] in tuple(".!?:;…")


#: Numbers that describe a line between its neighbours.
FEATURES = 15


# Line-pair classifiers
def line_features(lines: list[str], i: int, again: int, voice: float) -> list[float]:
    """What tells furniture from text, of a line between its neighbours; `again`: pages of the file that have the line."""
    line = lines[i].strip()
    tokens = line.split()
    some = [t for t in tokens if not t.isdigit()]
    upper = sum(t[0].isupper() for t in some)
    before = after = ""
    for k in range(i - 1, -1, -1):
        if lines[k].strip():
            before = lines[k]
            break
    for k in range(i + 1, len(lines)):
        if lines[k].strip():
            after = lines[k]
            break
    ended = _ended(line)
    lower = after[:1].islower()
    broken = lower and bool(before) and not _ended(before)
    digits = [t for t in tokens if _DIGIT.search(t)] if _DIGIT.search(line) else []
    return [
        float(np.log1p(again)), voice, len(tokens), len(line) / 10, upper / max(1, len(some)), sum(map(str.isupper, some)) / max(1, len(some)),
        sum(not t.isdigit() and bool(CODE.match(t)) for t in digits), len(digits), float(ended), float(bool(NUMBERED.match(line))),
        float(broken), float(not before), float(not after), float(line.count("|") + line.count(" - ")),
        float(not ended and not lower),
    ]


@dataclass(frozen=True)
class Furniture:
    """Boosted trees over line features and the words that speak for furniture."""

    trees: Boosted
    voices: dict[str, float]

    def voice(self, line: str) -> float:
        found = PLAIN.findall(line.lower())
        return sum(self.voices.get(w, 0.0) for w in found) / max(1, len(found))


def train_furniture(sample: list[tuple[str, str, str, int, bool]], most_words: int = 20_000) -> Furniture:
    """From (line before, line, line after, pages that have it, furniture or not)."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for _, line, _, _, furniture in sample:
        counts[furniture].update(set(re.findall(r"[^\W\d_]+", line.lower())))
    sums = [max(1, sum(f == k for *_, f in sample)) for k in (False, True)]
    words = [w for w, _ in (counts[0] + counts[1]).most_common(most_words)]
    voices = {w: float(np.clip(np.log((counts[1][w] + 0.5) / (sums[1] + 1)) - np.log((counts[0][w] + 0.5) / (sums[0] + 1)), -6, 6)) for w in words}
    if not all(any(f == k for *_, f in sample) for k in (False, True)):
        # Nothing to learn from: lines that come back on three pages are furniture, others are not.
        return Furniture(Boosted(np.zeros((1, 1), np.int64), np.full((1, 1), np.log1p(2.5)), np.array([[-8.0, 8.0]]), 0.0), {})
    model = Furniture(boost(np.zeros((0, FEATURES)), np.zeros(0)), voices)
    # The repeats that made the labels are hidden from half of the sample, so that the words and shapes are learned too.
    x = [line_features([a, line, b], 1, 1 if i % 2 else again, model.voice(line)) for i, (a, line, b, again, _) in enumerate(sample)]
    y = [float(f) for *_, f in sample]
    return Furniture(boost(np.array(x).reshape(-1, FEATURES), np.array(y)), voices)


def pair_features(joined: int, hyphened: int, left: int, right: int, a: str, b: str) -> list[float]:
    """What tells a word's own hyphen from one of the line break; the numbers are counts in clean text."""
    return [np.log1p(joined), np.log1p(hyphened), np.log1p(left), np.log1p(right), len(a), len(b)]


def train_joins(words: dict[str, int], seed: int = 3) -> Boosted:
    """True: keep the hyphen. Words with a hyphen are cut there, others at random places."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for word, n in words.items():
        if "-" in word[1:-1]:
            a, _, b = word.rpartition("-")
            x.append(pair_features(0, n, words.get(a, 0), words.get(b, 0), a, b))
            y.append(1.0)
        elif len(word) >= 4:
            k = int(rng.integers(2, len(word) - 1))
            a, b = word[:k], word[k:]
            x.append(pair_features(n, 0, words.get(a, 0), words.get(b, 0), a, b))
            y.append(0.0)
        if rng.random() < 0.3 and len(word) >= 4 and "-" not in word:  # words never seen: a name cut in two
            x.append(pair_features(0, 0, 0, 0, word[:2], word[2:]))
            y.append(0.0)
    return boost(np.array(x).reshape(-1, 6), np.array(y), trees=40)


# Ranking of corrections
_COST = {(a, b): (0.25 if len(a) == len(b) else 0.3) for a, b in CONFUSIONS}
#: Misreadings by the first letter that is read.
_FROM = {x: [(a, b, c) for (a, b), c in _COST.items() if a[0] == x] for x in {a[0] for a, _ in CONFUSIONS}}


def misread_cost(read: str, right: str, most: float = 3.5) -> float:
    """Least cost of reading `right` as `read`: usual misreadings are cheap, any other edit costs 1.

    What both begin and end with is left out, but for a letter that may be part of a misreading.
    """
    k, short = 0, min(len(read), len(right))
    while k < short and read[k] == right[k]:
        k += 1
    k = max(0, k - 1)
    e = 0
    while e < short - k and read[-1 - e] == right[-1 - e]:
        e += 1
    e = max(0, e - 1)
    read, right = read[k : len(read) - e], right[k : len(right) - e]
    n, m = len(read), len(right)
    if abs(n - m) > 4:
        return 99.0
    wide = 15  # row i holds places i - 7 to i + 7
    table = [[99.0] * wide for _ in range(n + 1)]
    table[0][7] = 0.0
    for i in range(n + 1):
        row = table[i]
        for j in range(max(0, i - 4), min(m, i + 4) + 1):
            at = j - i + 7
            here = row[at]
            if here > most:
                continue
            if i < n:
                below = table[i + 1]
                if here + 1 < below[at - 1]:
                    below[at - 1] = here + 1
                if j < m:
                    step = here if read[i] == right[j] else here + 1
                    if step < below[at]:
                        below[at] = step
                for a, b, c in _FROM.get(read[i], ()):
                    if right.startswith(b, j) and read.startswith(a, i) and here + c < table[i + len(a)][at + len(b) - len(a)]:
                        table[i + len(a)][at + len(b) - len(a)] = here + c
            if j < m and here + 1 < row[at + 1]:
                row[at + 1] = here + 1
    return table[n][m - n + 7]


def correction_features(cost: float, edits: int, shared: float, read: str, right: str, n: int, before: int, after: int) -> list[float]:
    return [cost, edits, shared, abs(len(read) - len(right)), len(right), np.log1p(n), np.log1p(before), np.log1p(after), float(read[:1] == right[:1]), float(read[-1:] == right[-1:])]


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 2] for i in range(len(padded) - 1)]


def _shared(a: str, b: str) -> float:
    x, y = set(grams(a)), set(grams(b))
    return len(x & y) / max(1, min(len(x), len(y)))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def train_corrections(words: dict[str, int], pairs: dict[tuple[str, str], int], contexts: list[tuple[str, str, str]], seed: int = 5, rounds: int = 3000) -> Boosted:
    """Words of clean text are misread on purpose; the true word is ranked against others that share q-grams."""
    rng = np.random.default_rng(seed)
    index: dict[str, list[str]] = {}
    for w in words:
        for g in set(grams(w)):
            index.setdefault(g, []).append(w)
    x, y = [], []
    for _ in range(rounds if contexts else 0):
        before, word, after = contexts[int(rng.integers(len(contexts)))]
        fits = [(a, b, k) for a, b in CONFUSIONS for k in (word.find(b),) if k >= 0 and a != b]
        if not fits or len(word) < 3:
            continue
        a, b, k = fits[int(rng.integers(len(fits)))]
        read = word[:k] + a + word[k + len(b) :]
        if read in words:
            continue
        near = Counter(w for g in set(grams(read)) for w in index.get(g, ()))
        for other in {word, *(w for w, _ in near.most_common(4))}:
            if abs(len(other) - len(read)) > 2:
                continue
            x.append(correction_features(misread_cost(read, other), _edits(read, other), _shared(read, other), read, other, words.get(other, 0), pairs.get((before, other), 0), pairs.get((other, after), 0)))
            y.append(float(other == word))
    return boost(np.array(x).reshape(-1, 10), np.array(y))


# The plan
def scan_rows(df: DataFrame, table: str, key: str, source: str, text: str, scanned: str, pages: bool) -> DataFrame:
    """(table, key, pages, scanned, text, source), one row for each key, for `repair_scans`.

    `pages` says whether the rows are whole pages, whose running lines come back from page to page of a source.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.lit(table).alias("table"), F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(scanned), F.lit(False)).alias("scanned"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    one = rows.groupBy("table", "key").agg(F.max(F.struct("scanned", "text", "source")).alias("r"))
    return one.select("table", "key", F.lit(pages).alias("pages"), "r.*")


def _counts(clean: DataFrame) -> DataFrame:
    """(a, b, n): how often word a is followed by word b; b null: how often a stands at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single: Counter = Counter()
        double: Counter = Counter()

        def out() -> pa.RecordBatch:
            a = [*single, *(p[0] for p in double)]
            b = [*([None] * len(single)), *(p[1] for p in double)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array([*single.values(), *double.values()], pa.int64())], ["a", "b", "n"])

        for batch in bounded(batches, "text"):
            words: list[str] = []
            for text in batch.column("text").to_pylist():
                for line in text.split("\n"):
                    words += lower_words(line)
                    words.append("")  # no word follows across lines
            single.update(words)
            double.update(zip(words, words[1:]))
            if len(double) > 200_000:
                yield out()
                single, double = Counter(), Counter()
        if single:
            yield out()

    counted = clean.select("text").mapInArrow(run, "a string, b string, n long").filter("a != '' AND (b IS NULL OR b != '')")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _again(pages: DataFrame) -> DataFrame:
    """(source, h, again): on how many rows of a source a line stands, by its letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            take, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                some = {reduced(line) for line in text.split("\n")} - {0}
                take += [i] * len(some)
                found += some
            yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(take, pa.int64())), pa.array(found, pa.int64())], ["source", "h"])

    return pages.select("source", "text").mapInArrow(run, "source string, h long").groupBy("source", "h").agg(F.count(F.lit(1)).alias("again")).filter("again > 1")


@dataclass(frozen=True)
class Repair:
    """Findings (table, key, line_no, kind, word), and the texts to which `repaired` applies them."""

    found: DataFrame
    scanned: DataFrame

    def repaired(self) -> DataFrame:
        """(table, key, source, text, repairs): continuous paragraphs without furniture, words joined and corrected."""
        per = self.found.groupBy("table", "key").agg(F.collect_list(F.struct("line_no", "kind", "word", "read")).alias("found"))  # no more than a row's words
        rows = self.scanned.join(per.hint("merge"), ["table", "key"], "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, "text"):
                texts, counts = [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                    texts.append(rewrite(text, [(f["line_no"], f["kind"], f["word"], f["read"]) for f in found or []]))
                    counts.append(len(found or []))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("table", "key", "source")), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["table", "key", "source", "text", "repairs"])

        return rows.mapInArrow(run, "table string, key long, source string, text string, repairs int")


def rewrite(text: str, found: list[tuple[int, str, str, str]]) -> str:
    """The text with the findings applied: furniture dropped, lines of a paragraph joined by blanks."""
    gone = {n for n, kind, _, _ in found if kind in ("header", "page_number")}
    joins = {n: (word, read) for n, kind, word, read in found if kind == "hyphenated"}
    fixes: dict[int, list[tuple[str, str]]] = {}
    for n, kind, word, read in found:
        if kind == "misread":
            fixes.setdefault(n, []).append((read, word))
    paragraphs: list[str] = []
    current = ""
    pending = ""  # a word begun on the last line
    for n, line in enumerate(text.split("\n"), 1):
        if n in gone:
            continue
        for read, word in fixes.get(n, []):
            right = word[:1].upper() + word[1:] if read[:1].isupper() and read[1:] != read[1:].upper() else word
            line = line.replace(read, right)
        line = " ".join(line.split())
        if pending:
            match = START.match(line)
            line = pending + (line[match.end(1) :] if match else " " + line)
            pending = ""
        if not line:
            if current:
                paragraphs.append(current)
                current = ""
            continue
        if n in joins and (match := CUT.search(line)):
            word, read = joins[n]
            begun = match.group(1)
            pending = line[: match.start(1)] + (word[:1].upper() + word[1:] if begun[:1].isupper() else word)
            continue
        current = f"{current} {line}" if current else line
    if pending:
        current = f"{current} {pending}" if current else pending
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)


def repair_scans(tables: list[DataFrame], sample: int = 6_000, words: int = 10_000, sure: float = 0.5) -> Repair:
    """Find what scanning left in texts. `tables` come from `scan_rows`; their clean rows teach, their scanned rows are repaired.
    Only lines of rows that are whole pages (`pages`) are counted as coming back.

    Findings, of scanned rows only, each once: `header` and `page_number` lines, lines `hyphenated` within a word that
    goes on in the next line of the text, and words `misread`, with the right word in lower case.
    Furniture is told from text by boosted trees over line pairs, fitted on at most `sample` lines of each kind: lines that
    come back on three rows of their source, and lines amid text that do not. Page numbers go by their form.
    Words of clean text, counted over all rows, are the dictionary. A word of a scanned line that is not in it meets the
    words with which it shares rare character q-grams, through an inverted join, and boosted trees choose among them by misreading cost,
    edits, frequency and neighbours; they are fitted on purposely misread words, from at most `words` words of the dictionary. A second classifier over the two halves decides if a
    hyphen at a line's end stays. Unreadable words without a candidate stay as they are. Null texts count as empty, null keys are left out; of
    repeated keys a scanned row comes first, then the greatest text. Empty tables give empty results. Whole texts are read.
    """
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    spark = rows.sparkSession
    scanned = cut_lineage(rows.filter("scanned AND text != ''").drop("scanned"))
    paged = scanned.filter("pages")
    counts = cut_lineage(_counts(rows.filter("NOT scanned")))
    known = counts.filter("b IS NULL").select(F.col("a").alias("word"), "n")
    follows = counts.filter("b IS NOT NULL")

    top = known.orderBy(F.desc("n"), "word").limit(words).toArrow().to_pydict()
    dictionary = dict(zip(top["word"], top["n"]))
    common = spark.sparkContext.broadcast(frozenset(dictionary))  # at most `words`: spares the join of most tokens

    # Furniture: lines that come back teach; a bounded sample of lines with their neighbours.
    again = cut_lineage(_again(paged))
    drawn = paged.orderBy(F.xxhash64("key"), "key").limit(max(1, sample // 6)).select("source", "text").toArrow().to_pylist()
    # The repeats of every line of these few rows, counted over all rows.
    some = spark.createDataFrame([(r["source"], h) for r in drawn for h in {reduced(line) for line in r["text"].split("\n")} - {0}] or [], "source string, h long").distinct()
    met = again.join(F.broadcast(some), ["source", "h"], "left_semi").toArrow().to_pydict()  # lines of at most sample / 6 rows
    seen = dict(zip(zip(met["source"], met["h"]), met["again"]))
    furniture = spark.sparkContext.broadcast(train_furniture(_labelled(drawn, seen, sample)))

    hashed = _line_hashes(scanned)
    met = hashed.join(again.hint("merge"), ["source", "h"]).groupBy("table", "key").agg(F.collect_list(F.struct("line_no", "again")).alias("again"))  # no more than a row's lines

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, usual = furniture.value, common.value
        for batch in bounded(batches, "text", 2_000_000):
            take, out = [], [[], [], [], [], [], [], []]

            def add(i: int, *values) -> None:
                take.append(i)
                for column, value in zip(out, values):
                    column.append(value)

            split = [text.split("\n") for text in batch.column("text").to_pylist()]
            often = [{m["line_no"]: m["again"] for m in met or []} for met in batch.column("again").to_pylist()]
            for i, (lines, kinds) in enumerate(zip(split, kinds_of(split, often, model))):
                body = [n for n, kind in enumerate(kinds) if kind == "text" and lines[n].strip()]
                for n, kind in enumerate(kinds):
                    if kind in ("header", "page_number"):
                        add(i, n + 1, kind, "", "", "", "", "")
                begun = False
                for place, n in enumerate(body):
                    tokens = words_of(lines[n])
                    after = body[place + 1] if place + 1 < len(body) else None
                    cut = CUT.search(lines[n])
                    start = START.match(lines[after]) if cut and after is not None else None
                    goes = bool(cut and start and LETTER.search(cut.group(1)) and lines[after].strip()[:1].isalnum() and not any(not x.strip() for x in lines[n + 1 : after]))
                    first, last = (1 if begun else 0), len(tokens) - (1 if goes else 0)
                    for t in range(first, last):
                        raw, word = tokens[t]
                        if word and word not in usual:
                            add(i, n + 1, "word", word, raw, tokens[t - 1][1] if t else "", tokens[t + 1][1] if t + 1 < last else "", "")
                    if goes:
                        a, b = cut.group(1).lower(), start.group(1).lower()
                        add(i, n + 1, "cut", a + b, a + "-" + b, a, b, tokens[-2][1] if len(tokens) > 1 else "")
                    begun = goes
            columns = [pa.array(out[0], pa.int32()), *(pa.array(c, pa.string()) for c in out[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("table").take(pa.array(take, pa.int64())), batch.column("key").take(pa.array(take, pa.int64())), *columns], ["table", "key", "line_no", "kind", "word", "raw", "before", "after", "more"])

    tagged = scanned.join(met.hint("merge"), ["table", "key"], "left").mapInArrow(tag, "table string, key long, line_no int, kind string, word string, raw string, before string, after string, more string")
    margins = F.col("kind").isin("header", "page_number", "cut")
    # Known words are dropped at once: what is left is written.
    parts = tagged.join(known.select("word", F.lit(1).alias("known")).hint("merge"), "word", "left").filter(margins | F.col("known").isNull())
    parts = cut_lineage(parts)
    lines = parts.filter(F.col("kind").isin("header", "page_number")).select("table", "key", "line_no", "kind", F.lit("").alias("word"), F.lit("").alias("read"))

    joins = spark.sparkContext.broadcast(train_joins(dictionary))
    cuts = _settle_cuts(parts.filter("kind = 'cut'"), known, joins)
    whole = cuts.filter("keep IS NOT NULL").select("table", "key", "line_no", F.lit("hyphenated").alias("kind"), F.when(F.col("keep"), F.col("raw")).otherwise(F.col("word")).alias("word"), F.lit("").alias("read"))
    unsettled = cuts.filter("keep IS NULL")

    odd = parts.filter("kind = 'word'").select("table", "key", "line_no", "kind", "word", "raw", "before", "after")
    torn = unsettled.select("table", "key", "line_no", "kind", F.explode(F.array("word", "raw")).alias("word"), "raw", F.col("more").alias("before"), F.lit("").alias("after"))
    asked = odd.unionByName(torn)
    top = follows.orderBy(F.desc("n"), "a", "b").limit(words * 4).toArrow().to_pydict()
    pairs = dict(zip(zip(top["a"], top["b"]), top["n"]))
    contexts = _contexts(pairs, words)
    ranker = spark.sparkContext.broadcast(train_corrections(dictionary, pairs, contexts))
    best = _corrections(asked, known, follows, ranker, sure)
    misread = best.filter("kind = 'word'").select("table", "key", "line_no", F.lit("misread").alias("kind"), F.col("right").alias("word"), F.col("raw").alias("read"))
    mended = best.filter("kind = 'cut'").withColumn("n", F.row_number().over(Window.partitionBy("table", "key", "line_no").orderBy(F.desc("score"), "right"))).filter("n = 1")
    mended = mended.select("table", "key", "line_no", F.lit("hyphenated").alias("kind"), F.col("right").alias("word"), F.lit("").alias("read"))
    rest = unsettled.join(mended.select("table", "key", "line_no").hint("merge"), ["table", "key", "line_no"], "left_anti")
    rest = rest.select("table", "key", "line_no", F.lit("hyphenated").alias("kind"), "word", F.lit("").alias("read"))
    found = lines.unionByName(whole).unionByName(misread).unionByName(mended).unionByName(rest)
    return Repair(cut_lineage(found), scanned)


def _contexts(pairs: dict[tuple[str, str], int], most: int) -> list[tuple[str, str, str]]:
    """Words between neighbours, as pairs chain; some with one neighbour or none, as beside numbers and codes."""
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    out = []
    for i, (a, b) in enumerate(list(pairs)[:most]):
        c = after[b][i % len(after[b])] if b in after else ""
        out.append(((a, b, c), (a, b, c), (a, b, ""), ("", b, c), ("", b, ""))[i % 5])
    return out


def kinds_of(texts: list[list[str]], often: list[dict[int, int]], model: Furniture) -> list[list[str]]:
    """header, page_number or text for each line of each text; the trees see the lines of all texts at once."""
    kinds = [["page_number" if line.strip() and is_page_number(line) else "text" for line in lines] for lines in texts]
    places = [(t, i) for t, lines in enumerate(texts) for i, line in enumerate(lines) if kinds[t][i] == "text" and line.strip()]
    if places:
        x = np.array([line_features(texts[t], i, often[t].get(i + 1, 1), model.voice(texts[t][i])) for t, i in places])
        for (t, i), p in zip(places, model.trees.probability(x)):
            if p > 0.5:
                kinds[t][i] = "header"
    return kinds


def _labelled(drawn: list, seen: dict, sample: int) -> list[tuple[str, str, str, int, bool]]:
    """Lines with a sure label: come back on three rows of the source, or stand amid text and come back nowhere."""
    furniture, body = [], []
    for row in drawn:
        lines = [x for x in row["text"].split("\n") if x.strip() and not is_page_number(x)]
        again = [seen.get((row["source"], reduced(x)), 1) for x in lines]
        for i, line in enumerate(lines):
            near = (lines[i - 1] if i else "", line, lines[i + 1] if i + 1 < len(lines) else "")
            short = bool(re.match(r"^\s*[a-z0-9].*[.]\s*$", line)) and len(line.split()) <= 4  # the end of a paragraph
            if again[i] >= 3 and not short:
                furniture.append((*near, again[i], True))
            elif again[i] == 1 and 2 <= i < len(lines) - 3 and again[i - 1] == again[i + 1] == 1:
                body.append((*near, 1, False))
            elif short:
                body.append((*near, again[i], False))
    return furniture[:sample] + body[:sample]


def _line_hashes(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            take, numbers, found = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, line in enumerate(text.split("\n"), 1):
                    if h := reduced(line):
                        take.append(i)
                        numbers.append(n)
                        found.append(h)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("table", "key", "source")), pa.array(numbers, pa.int32()), pa.array(found, pa.int64())], ["table", "key", "source", "line_no", "h"])

    return rows.mapInArrow(run, "table string, key long, source string, line_no int, h long")


def _settle_cuts(cuts: DataFrame, known: DataFrame, joins) -> DataFrame:
    """keep: whether the hyphen stays; null where neither form is a known word."""
    own = ["table", "key", "line_no", "kind", "word", "raw", "before", "after", "more"]
    # The four forms of a cut are looked up in one join.
    parts = cuts.select(*own, F.posexplode(F.array("word", "raw", "before", "after")).alias("slot", "form"))
    met = parts.join(known.select(F.col("word").alias("form"), "n").hint("merge"), "form", "left")
    out = met.groupBy(*own).agg(*[F.coalesce(F.max(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)).alias(name) for i, name in enumerate(("nj", "nh", "na", "nb"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            x = np.array([pair_features(*v) for v in zip(d["nj"], d["nh"], d["na"], d["nb"], d["before"], d["after"])]).reshape(-1, 6)
            keep = joins.value.probability(x) > 0.5
            values = [None if not j and not h else bool(k) for j, h, k in zip(d["nj"], d["nh"], keep)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("table", "key", "line_no", "kind", "word", "raw", "more")), pa.array(values, pa.bool_())], ["table", "key", "line_no", "kind", "word", "raw", "more", "keep"])

    return cut_lineage(out.mapInArrow(run, "table string, key long, line_no int, kind string, word string, raw string, more string, keep boolean"))


#: Places in a word, or lengths, in one band.
BAND = 4


def _gram_rows(words: DataFrame) -> DataFrame:
    """(id, len, bag, gram, at): every q-gram of two characters of a word with its ends marked, and its place.

    `id` is a hash that stands for the word, `bag` has a bit for each character in it. A word of any length costs as much as its
    characters.
    """
    lettered = words.select(F.xxhash64("word").alias("id"), F.char_length("word").alias("len"), F.split("word", "").alias("c"))
    zero = F.lit(0).cast("long")
    bag = F.aggregate("c", zero, lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))
    lettered = lettered.select("id", "len", bag.alias("bag"), F.concat(F.array(F.lit("^")), "c", F.array(F.lit("$"))).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("len")), lambda i: F.struct(F.concat(F.get("c", i), F.get("c", i + 1)).alias("gram"), i.alias("at")))
    return lettered.select("id", "len", "bag", F.explode(pairs).alias("g")).select("id", "len", "bag", "g.gram", "g.at")


def _corrections(asked: DataFrame, known: DataFrame, follows: DataFrame, ranker, sure: float, rare: int = 7) -> DataFrame:
    """The best right word for each place, with its score, where it is surer than `sure`.

    Candidates come from a join of the rarest q-grams of unknown words with those of the dictionary, at places within 3 and in
    words of lengths within 2 (bands of BAND). An edit spoils at most two q-grams of two characters and moves the others by one place, so `rare`
    of them find all words within three edits. Words of one letter have no candidates.
    """
    size = F.char_length("word")
    unknown = asked.select("word").filter(size >= 2).distinct()
    met = F.xxhash64("gram", "band", "size").alias("met")
    near_by = lambda c, by: F.transform(F.sequence(F.floor((F.col(c) - by) / BAND), F.floor((F.col(c) + by) / BAND)), lambda x: x.cast("int"))
    in_band = lambda c: F.floor(F.col(c) / BAND).cast("int")
    right = known.filter(size >= 2).select("word")
    grams_known = cut_lineage(_gram_rows(right))
    often = grams_known.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ours = _gram_rows(unknown).join(often.hint("merge"), "gram")
    ours = ours.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("often", "gram", "at"))).filter(F.col("n") <= rare)
    ours = ours.select("id", "len", "bag", "gram", F.explode(near_by("at", 3)).alias("band")).filter("band >= 0")
    ours = ours.select("id", "len", "bag", "gram", "band", F.explode(near_by("len", 2)).alias("size")).select(met, "id", "len", "bag").distinct()
    answers = grams_known.select("gram", in_band("at").alias("band"), in_band("len").alias("size"), F.col("id").alias("other"), F.col("len").alias("long"), F.col("bag").alias("letters")).select(met, "other", "long", "letters").distinct()
    # An edit changes the letters of a word by two at most.
    alike = (F.abs(F.col("len") - F.col("long")) <= 2) & (F.bit_count(F.col("bag").bitwiseXOR(F.col("letters"))) <= 6)
    near = ours.join(answers.hint("merge"), "met").filter(alike).select("id", "other").distinct()
    near = near.join(unknown.select(F.xxhash64("word").alias("id"), "word").hint("merge"), "id").join(right.select(F.xxhash64("word").alias("other"), F.col("word").alias("right")).hint("merge"), "other")
    near = near.select("word", "right")
    edits = F.levenshtein("word", "right", 3)
    near = near.withColumn("edits", edits).filter(F.col("edits").between(0, F.when(F.char_length("word") <= 4, 2).otherwise(3)))
    # Of the candidates within the fewest edits and one more; a misread letter is at most two edits.
    fewest = F.min("edits").over(Window.partitionBy("word"))
    near = near.withColumn("fewest", fewest).filter(F.col("edits") <= F.col("fewest") + 1).drop("fewest")

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            costs = [misread_cost(a, b) for a, b in zip(d["word"], d["right"])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "right", "edits")), pa.array(costs, pa.float64()), pa.array([_shared(a, b) for a, b in zip(d["word"], d["right"])], pa.float64())], ["word", "right", "edits", "cost", "shared"])

    priced = near.mapInArrow(cost, "word string, right string, edits int, cost double, shared double")
    best = F.min("cost").over(Window.partitionBy("word"))
    priced = priced.withColumn("best", best).filter(F.col("cost") <= F.col("best") + 0.6).drop("best")
    priced = cut_lineage(priced.join(known.select(F.col("word").alias("right"), "n").hint("merge"), "right"))
    places = asked.join(priced.hint("merge"), "word")
    before = follows.select(F.col("a").alias("before"), F.col("b").alias("right"), F.col("n").alias("nb"))
    after = follows.select(F.col("a").alias("right"), F.col("b").alias("after"), F.col("n").alias("na"))
    places = places.join(before.hint("merge"), ["before", "right"], "left").join(after.hint("merge"), ["right", "after"], "left")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            x = [correction_features(*v) for v in zip(d["cost"], d["edits"], d["shared"], d["word"], d["right"], d["n"], (v or 0 for v in d["nb"]), (v or 0 for v in d["na"]))]
            scores = ranker.value.probability(np.array(x).reshape(-1, 10))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("table", "key", "line_no", "kind", "raw", "word", "right")), pa.array(scores)], ["table", "key", "line_no", "kind", "raw", "word", "right", "score"])

    ranked = places.select("table", "key", "line_no", "kind", "raw", "word", "right", "cost", "edits", "shared", "n", "nb", "na").mapInArrow(rank, "table string, key long, line_no int, kind string, raw string, word string, right string, score double")
    first = ranked.groupBy("table", "key", "line_no", "kind", "raw", "word").agg(F.max(F.struct("score", "right")).alias("best"))
    return first.select("table", "key", "line_no", "kind", "raw", "best.right", "best.score").filter(F.col("score") >= sure)

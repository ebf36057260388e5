"""Smaller text predicates and extractions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may be in a state, by the words that name it, and the states it may have, as (word, what it counts as).
#: Longer words come first.
EQUIPMENT = {
    "vcb": (("vcb",), (("tripped", "tripped"), ("closed", "closed"), ("open", "open"))),
    "pantograph": (("pantograph",), (("lowered", "lowered"), ("raised", "raised"), ("down", "lowered"), ("up", "raised"))),
    "line_voltage": (("line voltage", "voltage"), (("not available", "unavailable"), ("unavailable", "unavailable"), ("available", "available"), ("abnormal", "abnormal"), ("present", "available"), ("absent", "unavailable"), ("normal", "normal"))),
    "traction": (("traction",), (("not available", "unavailable"), ("unavailable", "unavailable"), ("available", "available"), ("failure", "failed"), ("failed", "failed"), ("normal", "normal"))),
    "brake": (("brakes", "brake"), (("inoperative", "failed"), ("defective", "failed"), ("isolated", "isolated"), ("healthy", "normal"), ("failed", "failed"), ("normal", "normal"))),
}
#: Words that may stand between a thing and its state.
LINKS = ("is", "are", "remains", "remain", "shows", "showing", "=")


def states(text: Column) -> Column:
    """`name=value` of each thing whose state a text names, values made equal, in the order of EQUIPMENT.

    The text is read as words: a name, then any of LINKS or nothing, then a state.
    """
    line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+|="), F.lit(0)), " "), F.lit(" "))
    found = []
    for name, (called, values) in EQUIPMENT.items():
        first = F.regexp_extract(line, f" (?:{'|'.join(called)}) (?:(?:{'|'.join(LINKS)}) )?({'|'.join(v for v, _ in values)}) ", 1)
        means = F.create_map(*[F.lit(x) for pair in values for x in pair])
        found.append(F.when(first != "", F.concat(F.lit(f"{name}="), F.try_element_at(means, first))))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def duration_seconds(text: Column) -> Column:
    """Seconds of `90`, `1m30s`, `250ms`; null where nothing of the kind stands."""
    t = F.lower(F.trim(text))
    part = lambda unit, scale: F.aggregate(F.regexp_extract_all(t, F.lit(rf"([0-9]+(?:\.[0-9]+)?)\s*{unit}"), F.lit(1)), F.lit(0.0), lambda s, x: s + x.cast("double") * scale)
    total = part("ms", 0.001) + part("s(?![a-z])", 1.0) + part("m(?![a-z])", 60.0) + part("h", 3600.0)
    return F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.greatest(F.lit(0.0), t.cast("double"))).when(t.rlike(r"[0-9]\s*(ms|s|m|h)"), total)


def enumeration_bonus(text: Column) -> Column:
    t = F.lower(text)
    namely, following = F.contains(t, F.lit("namely")), F.contains(t, F.lit("following"))
    return F.when(namely & following, 0.16).when(namely, 0.10).when(t.rlike(r"(?s)\bfollowing\b.{0,160}\b(are|include|includes|comprise|consist)"), 0.08).otherwise(0.0)


def column_name_score(value: Column) -> Column:
    """How much a table cell looks like a column's name, 0 to 1."""
    v = F.trim(F.regexp_replace(value, r"\s+", " "))
    letters = F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    count = F.size(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0)))
    full = F.least(F.lit(1.0), 0.35 + F.least(F.lit(0.45), letters / 40.0) + F.least(F.lit(0.20), count * 0.05))
    none = (v == "") | F.lower(v).startswith("column ") | v.rlike(r"^\(?[0-9]+\)?$")
    return F.when(none, 0.0).when((letters < 3) | (count == 0), 0.05).when((F.length(v) <= 3) & (count <= 1), 0.10).otherwise(full)


def abbreviations(text: Column) -> Column:
    """Words in capitals, or of two to four letters, that are no stop words, each once, sorted."""
    words = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z0-9&/-]*\b"), F.lit(0))
    stop = "the and for with from this that what when where which how are is in on of to an or by as be do does can who why has had was were may not near must at it".split()
    short = lambda w: ((F.upper(w) == w) & w.rlike("[A-Z]")) | w.rlike("^[A-Za-z]{2,4}$")
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: short(w) & ~F.lower(w).isin(stop)), lambda w: F.lower(w))))


def corruption(text: Column) -> Column:
    """Share of lines that consist of repeated fragments of one or two letters; 0 for fewer than three such lines."""
    tokens = lambda x: F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.lower(t))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def broken(line: Column) -> Column:
        t = tokens(line)
        short = F.size(F.filter(t, lambda w: F.length(w) <= 2)) / F.size(t)
        repeated = 1 - F.size(F.array_distinct(t)) / F.size(t)
        return (F.size(t) >= 6) & ((short >= 0.68) | ((short >= 0.52) & (repeated >= 0.34)) | ((F.regexp_count(line, F.lit(r"\|")) >= 4) & (short >= 0.55)))

    bad = F.filter(lines, broken)
    count = lambda xs: F.aggregate(F.transform(xs, lambda x: F.size(tokens(x))), F.lit(0), lambda s, n: s + n)
    score = F.least(F.lit(1.0), count(bad) / count(lines) * 0.7 + F.size(bad) / F.size(lines) * 0.3)
    return F.when((F.size(bad) >= 3) & (count(lines) > 0), score).otherwise(F.lit(0.0))

"""Derived indexes: terminology, numeric facts and rules, amendments and what is in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Unit aliases; fixed values.
UNITS = {"kmph": "km/h", "km/h": "km/h", "kph": "km/h", "bar": "bar", "bars": "bar", "seconds": "s", "second": "s", "sec": "s", "s": "s", "minutes": "min", "minute": "min", "min": "min", "metres": "m", "meters": "m", "m": "m"}
#: Comparison words and the operator they stand for; fixed values, in order of precedence.
COMPARISONS = (("at least", ">="), ("not less than", ">="), ("more than", ">"), ("exceeds", ">"), ("exceeding", ">"), ("at most", "<="), ("not more than", "<="), ("up to", "<="), ("less than", "<"), ("below", "<"))
UNIT = "kmph|km/h|kph|bars?|seconds?|sec|minutes?|min|metres|meters|m|s"
CONNECTIVES = "of|and|the|for|to|in|on"


def initials(phrase: Column, strict: bool = True) -> Column:
    """First letters of a phrase's words; connectives are skipped unless strict."""
    words = F.filter(F.split(phrase, r"[\s/-]+"), lambda w: w != "")
    kept = words if strict else F.filter(words, lambda w: ~F.lower(w).rlike(f"^({CONNECTIVES})$"))
    return F.upper(F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), ""))


def _with_confidence(found: Column, sure: float) -> Column:
    return F.transform(found, lambda x: F.struct(x["alias"].alias("alias"), x["canonical"].alias("canonical"), F.lit(sure).alias("confidence")))


def terminology(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alias, canonical, confidence): definitions in a text whose initials support the alias.

    Shapes: `Long Name (LN)` .98, `LN (Long Name)` .98, `LN means long name` .96, `LN - Long Name` .97.
    """
    alias, name = "[A-Z][A-Z0-9]{1,9}", "[A-Z][A-Za-z]+(?:[ /-](?:[A-Z][A-Za-z]+|of|and|the|for|to|in|on)){1,7}"
    shapes = ((rf"({name}) \(({alias})\)", 2, 1, 0.98), (rf"\b({alias}) \(({name})\)", 1, 2, 0.98), (rf"\b({alias}) means ([A-Za-z]+(?: [A-Za-z]+){{1,7}})", 1, 2, 0.96), (rf"\b({alias}) [-–:] ({name})", 1, 2, 0.97))
    arrays = []
    for pattern, a, b, sure in shapes:
        found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(a)).alias("alias"), F.regexp_extract_all(text, F.lit(pattern), F.lit(b)).alias("canonical"))
        arrays.append(_with_confidence(found, sure))
    rows = df.select(F.col(key), F.explode(F.concat(*arrays)).alias("t")).select(key, "t.alias", "t.canonical", "t.confidence")
    # A name may begin within a longer capitalised run: the shortest tail with the alias's initials is the name.
    words = F.split("canonical", " ")
    tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, n, F.size(words)), " "))
    fits = F.filter(tails, lambda t: (initials(t) == F.col("alias")) | (initials(t, False) == F.col("alias")))
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    means = F.filter(heads, lambda t: (initials(t) == F.col("alias")) | (initials(t, False) == F.col("alias")))
    name = F.coalesce(F.get(fits, F.size(fits) - 1), F.get(means, F.lit(0)))
    return rows.withColumn("canonical", name).filter(F.col("canonical").isNotNull()).groupBy(key, "alias", "canonical").agg(F.max("confidence").alias("confidence"))


def dominant_terms(terms: DataFrame, ambiguous: float = 0.65) -> DataFrame:
    """(alias, canonical, mentions, confidence, ambiguous): the most mentioned meaning of each alias."""
    counted = terms.groupBy("alias", F.lower("canonical").alias("canonical")).agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg("confidence"), 6).alias("confidence"))
    by = Window.partitionBy("alias").orderBy(F.desc("mentions"), F.desc("confidence"), "canonical")
    ranked = counted.withColumn("n", F.row_number().over(by)).withColumn("second", F.lead("mentions").over(by))
    return ranked.filter("n = 1").select("alias", "canonical", "mentions", "confidence", (F.coalesce("second", F.lit(0)) >= F.col("mentions") * ambiguous).alias("ambiguous"))


def unit(value: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    return F.coalesce(F.try_element_at(names, F.lower(value)), F.lower(value))


def numeric_rules(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, subject, operator, threshold, unit): `<subject> at least 25 km/h` and the like."""
    operator = "|".join(p for p, _ in COMPARISONS)
    pattern = rf"(?i)([a-z]+(?: [a-z]+)?) (?:is |are |of |)({operator}) ([0-9]+(?:\.[0-9]+)?) ?({UNIT})?"
    part = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    rows = df.select(F.col(key), F.explode(F.arrays_zip(part(1).alias("s"), part(2).alias("o"), part(3).alias("v"), part(4).alias("u"))).alias("r"))
    sign = F.lit(None).cast("string")
    for words, symbol in reversed(COMPARISONS):
        sign = F.when(F.lower(F.col("r.o")) == words, symbol).otherwise(sign)
    return rows.select(key, F.lower("r.s").alias("subject"), sign.alias("operator"), F.col("r.v").cast("double").alias("threshold"), F.when(F.col("r.u") != "", unit(F.col("r.u"))).alias("unit"))


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """Whether a value satisfies a threshold; an unknown operator never does."""
    return (
        F.when(operator == ">=", value >= threshold).when(operator == ">", value > threshold).when(operator == "<=", value <= threshold).when(operator == "<", value < threshold).when(operator == "==", value == threshold).otherwise(F.lit(False))
    )


def rule_scores(facts: DataFrame, rules: DataFrame, fact_key: str, rule_key: str) -> DataFrame:
    """(fact key, rule key, score): +0.32 for each rule a fact satisfies and -0.18 for each it breaks, within -0.35 and 0.45."""
    met = facts.withColumnRenamed("unit", "_unit").join(rules, "subject").filter(F.col("_unit").eqNullSafe(F.col("unit")))
    part = F.when(compare(F.col("value"), F.col("operator"), F.col("threshold")), 0.32).otherwise(-0.18)
    return met.groupBy(fact_key, rule_key).agg(F.round(F.greatest(F.lit(-0.35), F.least(F.lit(0.45), F.sum(part))), 6).alias("score"))


def directives(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, target, old, new): words replaced, sections replaced, clauses omitted."""
    shapes = (
        ("replace_words", r'(?i)in (rule|section|clause) ([0-9A-Za-z.]+), for the words "([^"]+)", the words "([^"]+)" shall be substituted', 2, 3, 4),
        ("replace_section", r"(?i)for (rule|section|clause) ([0-9A-Za-z.]+), the following shall be (?:substituted|replaced)", 2, None, None),
        ("omit", r"(?i)(rule|section|clause) ([0-9A-Za-z.]+) shall be omitted", 2, None, None),
    )
    out = None
    for kind, pattern, target, old, new in shapes:
        part = lambda n, pattern=pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(n)) if n else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.lit(None).cast("string"))
        rows = df.select(F.col(key), F.explode(F.arrays_zip(part(target).alias("target"), part(old).alias("old"), part(new).alias("new"))).alias("d"))
        rows = rows.select(key, F.lit(kind).alias("kind"), "d.target", "d.old", "d.new")
        out = rows if out is None else out.unionByName(rows)
    return out


def authority_status(df: DataFrame, document: str, position: str, text: str, span: int = 48) -> DataFrame:
    """Status of each row: current_explicit where it replaces, current_replacement after it up to a boundary, historical_appended beyond.

    A boundary is a row that begins an older instrument (`... Rules, 1998`) after a replacement; rows before any replacement are unknown.
    """
    by = Window.partitionBy(document).orderBy(position)
    up = by.rowsBetween(Window.unboundedPreceding, 0)
    replaces = F.col(text).rlike(r"(?i)shall be (substituted|replaced)")
    boundary = F.col(text).rlike(r"^[A-Z][A-Za-z ]+(Rules|Regulations|Act), (19|20)[0-9]{2}\b") & ~replaces
    at = F.last(F.when(replaces, F.col(position)), ignorenulls=True).over(up)
    edge = F.last(F.when(boundary, F.col(position)), ignorenulls=True).over(up)
    status = (
        F.when(F.col("_r"), "current_explicit").when(F.col("_at").isNull(), "unknown").when(F.col("_edge") > F.col("_at"), "historical_appended").when(F.col(position) - F.col("_at") <= span, "current_replacement").otherwise("unknown")
    )
    return df.withColumn("_r", replaces).withColumn("_at", at).withColumn("_edge", edge).withColumn("authority_status", status).drop("_r", "_at", "_edge")


def scope_labels(text: Column) -> Column:
    """Labels of lines and stock that a text names, zero-stripped, each once, sorted."""
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bline[- ]?0*([0-9]+)"), F.lit(1)), lambda n: F.concat(F.lit("LINE-"), n))
    stock = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\brs[- ]?0*([0-9]+)"), F.lit(1)), lambda n: F.concat(F.lit("RS-"), n))
    return F.array_sort(F.array_distinct(F.concat(lines, stock)))

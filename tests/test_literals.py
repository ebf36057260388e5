"""Small rows with known answers for operators whose queries run over whole tables."""

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import patterns as P
from tarnwick.functions import text as T
from tarnwick.operators import evidence_index as I
from tarnwick.operators import layout as L
from tarnwick.operators import neighbours as N

TERMS = [
    (1, "The Automatic Train Operation (ATO) mode needs a clear track. ATO is checked daily."), (2, "SC means station controller, who keeps the key."), (3, "OCC (Operations Control Centre) informs the driver."),
    (4, "Use of ATO (Automatic Train Operation) is recorded."), (5, "PSD - Platform Screen Door faults are rare."), (6, "A Traffic Order (XYZ) is not a definition."), (7, "ATO means alarm test officer in old papers."), (8, ""),
]
AMENDMENTS = [
    ("d1", 1, "General Rules, 1998 apply."), ("d1", 2, 'In rule 7, for the words "two bells", the words "three bells" shall be substituted.'), ("d1", 3, "The new text of the rule."), ("d1", 4, "Opening of Lines Rules, 1995 begin here."), ("d1", 5, "Old text."),
    ("d2", 1, "Clause 12A shall be omitted."), ("d2", 2, "For section 4, the following shall be substituted"), ("d2", 3, "Section 4 reads anew."), ("d3", 1, "Nothing to see."),
]
RULES = [(1, "Speed at least 25 km/h applies. Pressure more than 5 bar is unsafe."), (2, "Brake pressure below 3.5 bar stops the train, delay up to 30 seconds."), (3, "No number here."), (4, "speed less than 80 kmph")]


def column(spark, values, f):
    """What a function of a text column says about each value."""
    rows = spark.createDataFrame(list(enumerate(values)), "id int, text string").select("id", f(F.col("text")).alias("out")).collect()
    return [r.out for r in sorted(rows)]


def test_terms(spark):
    found = I.terminology(spark.createDataFrame(TERMS, "id int, text string"), "id", "text")
    assert {(r.id, r.alias, r.canonical) for r in found.collect()} == {
        (1, "ATO", "Automatic Train Operation"), (2, "SC", "station controller"), (3, "OCC", "Operations Control Centre"), (4, "ATO", "Automatic Train Operation"), (5, "PSD", "Platform Screen Door"), (7, "ATO", "alarm test officer"),
    }
    assert {(r.alias, r.canonical, r.mentions, r.ambiguous) for r in I.dominant_terms(found).collect()} == {
        ("ATO", "automatic train operation", 2, False), ("OCC", "operations control centre", 1, False), ("PSD", "platform screen door", 1, False), ("SC", "station controller", 1, False),
    }


def test_rules_and_facts(spark):
    rules = I.numeric_rules(spark.createDataFrame(RULES, "id int, text string"), "id", "text")
    assert {tuple(r) for r in rules.collect()} == {(1, "speed", ">=", 25.0, "km/h"), (1, "pressure", ">", 5.0, "bar"), (2, "brake pressure", "<", 3.5, "bar"), (2, "delay", "<=", 30.0, "s"), (4, "speed", "<", 80.0, "km/h")}
    facts = spark.createDataFrame([(10, "speed", 30.0, "km/h"), (11, "speed", 20.0, "km/h"), (13, "brake pressure", 2.0, "bar"), (14, "speed", 90.0, "km/h")], "fact int, subject string, value double, unit string")
    assert {tuple(r) for r in I.rule_scores(facts, rules, "fact", "id").collect()} == {(10, 1, 0.32), (10, 4, 0.32), (11, 1, -0.18), (11, 4, 0.32), (13, 2, 0.32), (14, 1, 0.32), (14, 4, -0.18)}


def test_amendments(spark):
    df = spark.createDataFrame(AMENDMENTS, "document_id string, at int, text string")
    found = I.directives(df.withColumn("k", F.struct("document_id", "at")), "k", "text").select("k.*", "kind", "target", "old", "new").collect()
    assert {tuple(r) for r in found} == {("d1", 2, "replace_words", "7", "two bells", "three bells"), ("d2", 1, "omit", "12A", None, None), ("d2", 2, "replace_section", "4", None, None)}
    status = {(r.document_id, r.at): r.authority_status for r in I.authority_status(df, "document_id", "at", "text").collect()}
    assert [status["d1", n] for n in range(1, 6)] == ["unknown", "current_explicit", "current_replacement", "historical_appended", "historical_appended"] and status["d2", 3] == "current_replacement"


def test_states_scopes_durations(spark):
    text = ["VCB is open and the pantograph lowered", "Line voltage available; brakes isolated", "Traction not available", "nothing", "", None, "the pantograph is up"]
    assert column(spark, text, lambda c: F.array_join(P.states(c), ",")) == ["vcb=open,pantograph=lowered", "line_voltage=available,brake=isolated", "traction=unavailable", "", "", "", "pantograph=raised"]
    assert column(spark, ["Line 04 and line-7 use RS-010 trains", "RS 2 on Line 2, RS-2 again", "none"], lambda c: F.array_join(I.scope_labels(c), ",")) == ["LINE-4,LINE-7,RS-10", "LINE-2,RS-2", ""]
    assert column(spark, ["90", "1m30s", "250ms", "2h", "soon", "-3", "1.5s"], P.duration_seconds) == [90, 90, 0.25, 7200, None, 0, 1.5]
    assert column(spark, ["What was the limit in 1998?", "What is the current limit after the 2004 amendment?", "Old rule before 2001 and 1999", "The 2003 list", "What applied during 2010?"], T.explicit_year) == [1998, None, 1999, None, 2010]


def test_cells_and_lines(spark):
    assert column(spark, ["Column 1", "Signal aspect", "12", "(3)", "No", "Maximum permissible speed in km/h", ""], lambda c: F.round(P.column_name_score(c), 6)) == [0, 0.75, 0, 0, 0.05, 1.0, 0]
    broken = ["tt tT TT rT tt tt\nTT tt rt RT tt TT\nab ab cd ef ab ab\nnormal words stand here too", "All of the words of this line are well formed words\nand so are these", ""]
    assert column(spark, broken, P.corruption) == [pytest.approx(18 / 23 * 0.7 + 3 / 4 * 0.3), 0, 0]
    assert column(spark, ["The following modes, namely A and B", "Types, namely X", "the following signals are used", "no list"], P.enumeration_bonus) == [0.16, 0.10, 0.08, 0]
    words = [{"w": w, "x0": x, "y0": y, "y1": z} for w, x, y, z in (("b", 50.0, 10.0, 20.0), ("a", 5.0, 11.0, 21.0), ("c", 5.0, 40.0, 50.0))]
    assert [(w["w"], w["line"]) for w in L.lines_of(words)] == [("b", 0), ("a", 0), ("c", 1)]
    assert L.column_positions([5.0, 50.0, 5.0, 6.0], 4.0) == [5.0, 50.0]


def test_boxes_and_tables(spark):
    box = lambda x0, y0, x1, y1: F.struct(*[F.lit(float(v)).alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])
    shares = spark.range(1).select(L.overlap_of_smaller(box(0, 0, 10, 10), box(5, 5, 15, 15)), L.overlap_of_smaller(box(0, 0, 10, 10), box(0, 0, 2, 2)), L.overlap_of_smaller(box(0, 0, 1, 1), box(2, 2, 3, 3))).first()
    assert tuple(shares) == (0.25, 1.0, 0.0)
    rows = [("d", 1, 1, 300.0, 3), ("d", 2, 2, 60.0, 3), ("d", 3, 3, 50.0, 4), ("d", 4, 4, 500.0, 4), ("e", 1, 2, 10.0, 2), ("e", 3, 3, 10.0, 2)]
    found = L.multipage_tables(spark.createDataFrame(rows, "document_id string, page int, page_end int, y0 double, columns int"), "document_id").collect()
    assert {(r.document_id, r.page, r.whole) for r in found} == {("d", 1, 1), ("d", 2, 1), ("d", 3, 2), ("d", 4, 3), ("e", 1, 1), ("e", 3, 1)}


def test_heading_stack(spark):
    heads = [("d", i, *r) for i, r in enumerate([(1, "One"), (0, "a"), (2, "One.A"), (3, "deep"), (0, "c"), (2, "One.B"), (1, "Two"), (0, "e"), (3, "skip")], 1)] + [("e", 1, 0, "none"), ("e", 2, 2, "late")]
    found = N.heading_paths(spark.createDataFrame(heads, "doc string, place int, level int, title string"), ["doc"], ["place"], "level", "title")
    path = {(r.doc, r.place): " > ".join(r.section_path) for r in found.collect()}
    assert [path["d", n] for n in range(1, 10)] == ["One", "One", "One > One.A", "One > One.A > deep", "One > One.A > deep", "One > One.B", "Two", "Two", "Two > skip"] and path["e", 1] == "" and path["e", 2] == "late"

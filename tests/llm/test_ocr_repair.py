import random

import numpy as np
import pytest

from tarnwick.llm.boosting import boost
from tarnwick.llm.ocr_repair import is_page_number, misread_cost, repair_scans, rewrite, scan_rows, words_of

CLEAN = "The signal must be cleared before the points are locked. The guard closes the late-night gate.\nThe driver reads the signal and the guard confirms the overlap. The points are locked again by the guard."


@pytest.mark.parametrize(("line", "is_one"), [("7", True), ("- 10 -", True), ("Page 8", True), ("Pg.5", True), ("[12]", True), ("47 |", True), ("xiv", True), ("Sheet 2 of 9", True), ("~ 9 ~", True), ("Document AB-12 Sheet 7 of 9", False), ("register.", False), ("mix", False), ("", False), ("...", False)])
def test_page_numbers(line, is_one):
    assert is_page_number(line) == is_one


def test_misreadings_are_cheap():
    assert misread_cost("greasecl", "greased") < 0.5 and misread_cost("tbat", "that") < 0.5 and misread_cost("riight", "night") < 0.8
    assert misread_cost("signal", "signal") == 0 and misread_cost("abc", "xyz") >= 3 and misread_cost("", "ab") == 2


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boost(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == (y[1500:] > 0.5)).mean() > 0.93
    assert boost(np.zeros((0, 3)), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]


def rows(spark):
    pages = [(i, "f", CLEAN, False) for i in range(30)]
    rng = random.Random(5)
    words = "guard driver points signal overlap gate locked cleared again reads confirms before".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = lambda i: ["Signal Handbook / issue AB-%d" % i, f"The {some(5)} and the late-", f"night gate. The {some(5)} the sig¬", f"nal and tbe {some(5)} the overlap.", f"- {i} -"]
    pages += [(100 + i, "f", "\n".join(lines(i)), True) for i in range(12)]
    pages += [(200, "f", None, True), (201, "f", "", True), (None, "f", "x", True), (100, "f", None, True), (202, None, "Only 1 line", None)]
    return spark.createDataFrame(pages, "k long, s string, t string, o boolean").selectExpr("*", "'z' line_no", "1 kind", "2 as word")


def test_repair(spark):
    found = repair_scans([scan_rows(rows(spark), "page_text", "k", "s", "t", "o", True)])
    rows_ = {(r["key"], r["line_no"], r["kind"], r["word"]) for r in found.found.collect()}
    for i in range(100, 112):
        assert {(i, 2, "hyphenated", "late-night"), (i, 3, "hyphenated", "signal"), (i, 4, "misread", "the"), (i, 5, "page_number", "")} <= rows_
        assert (i, 1, "header", "") in rows_
    assert {r[0] for r in rows_} == set(range(100, 112))
    texts = {r["key"]: r["text"] for r in found.repaired().collect()}
    assert "and the late-night gate. The " in texts[105] and "the signal and the " in texts[105] and "Handbook" not in texts[105] and "\n" not in texts[105]


def test_empty(spark):
    assert repair_scans([scan_rows(rows(spark).limit(0), "page_text", "k", "s", "t", "o", True)]).found.count() == 0


def test_rewrite_keeps_paragraphs_and_case():
    text = "Tbe  first line\ngoes on.\n\nSecond para-\n7\ngraph here."
    found = [(1, "misread", "the", "Tbe"), (4, "hyphenated", "paragraph", ""), (5, "page_number", "", "")]
    assert rewrite(text, found) == "The first line goes on.\n\nSecond paragraph here."


def test_misread_digits_make_no_codes():
    assert [w for _, w in words_of("the l0cked b0x by AB-123/E, km5 and KZ-1352")] == ["the", "l0cked", "b0x", "by", "", "", "and", ""]


def test_rare_and_very_long_words_are_candidates(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    rows = [(1, "f", f"The {long} must confirm that the pantograph is safe.", False), (2, "f", f"The {long[:-6]}rn{long[-5:]} must confirm.\nThe pant0graph is safe.", True)]
    rows += [(10 + i, "f", "The yard master must confirm that the signal is safe again today.", False) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, s string, t string, o boolean")
    found = {(r["kind"], r["word"]) for r in repair_scans([scan_rows(df, "a", "k", "s", "t", "o", True)]).found.collect()}
    assert ("misread", "pantograph") in found

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwick.llm.tree_split import split_oversized, split_text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .\n-é́#|;", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_round_trip(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    overlap = min(overlap, limit // 2)
    assert "".join(text[a + (overlap if n else 0) : b] for n, (a, b, _) in enumerate(pieces)) == text
    assert all(b - a <= limit for a, b, _ in pieces)
    assert all(x[1] - y[0] == overlap for x, y in zip(pieces, pieces[1:]))


def test_cuts_at_natural_boundaries():
    text = "# One\nFirst part here. It has two sentences.\n\nSecond paragraph.\n# Two\n- item one is long\n- item two is long\n"
    pieces = [text[a:b] for a, b, _ in split_text(text, 66, 0)]
    assert pieces[0].startswith("# One") and any(p.startswith("# Two") for p in pieces)
    assert all(len(p) <= 66 for p in pieces)


def cut(text, limit):
    return [text[a:b] for a, b, _ in split_text(text, limit, 0)]


def test_only_siblings_are_merged():
    long = "words of the first section go on. " * 6 + "tail of one.\n"
    pieces = cut(f"# One\n{long}# Two\nshort two.\n# Three\nshort three.\n", 150)
    assert pieces[0].startswith("# One\nwords") and pieces[-1] == "# Two\nshort two.\n# Three\nshort three.\n"
    assert not any("tail of one" in p and "# Two" in p for p in pieces)


def test_headings_have_depth():
    text = "# A\nintro of a.\n## A1\ntext of a one.\n### A1x\ndeep text.\n## A2\ntext of a two.\n# B\ntext of b.\n"
    pieces = cut(text, 60)
    # B is a sibling of A, not of A2: it is never merged with A's last subsection.
    assert pieces == ["# A\nintro of a.\n## A1\ntext of a one.\n### A1x\ndeep text.\n", "## A2\ntext of a two.\n", "# B\ntext of b.\n"]
    text = "1 Scope\nintro.\n1.1 Trains\n" + "some words here. " * 3 + "\n1.2 Yards\nmore.\n2 Rules\nlast.\n"
    assert cut(text, 80)[-1] == "2 Rules\nlast.\n"


def test_code_and_tables_stay_whole():
    code = "```\n# no heading\n- no item\n\nstill code\n```\n"
    table = "| a | b |\n| 1 | 2 |\n| 3 | 4 |\n"
    pieces = cut("Some words before the code stand here.\n" + code + "Some words after it.\n" + table + "The end of the text is here.\n", 60)
    assert any(code in p for p in pieces) and any(table in p for p in pieces)


def test_nested_items():
    text = "- one\n  - one a is long enough\n  - one b is long enough\n- two\n  - two a is long enough\n"
    pieces = cut(text, 60)
    assert pieces == ["- one\n  - one a is long enough\n  - one b is long enough\n", "- two\n  - two a is long enough\n"]


def test_operator(spark):
    rows = [(1, "x" * 30, 10, 3, ["h"]), (1, "x" * 30, 10, 3, ["h"]), (2, "short", 10, 3, None), (3, None, 10, 0, None), (None, "y" * 30, 10, 0, None), (4, "z" * 30, None, 0, None), (5, "w" * 12, 10, None, []), (6, "v" * 12, 0, 1, None)]
    df = spark.createDataFrame(rows, "k long, t string, l int, o int, path array<string>").selectExpr("*", "'c' as piece", "1 as start")
    found = split_oversized(df, "k", "t", "l", "o", "path").orderBy("k", "piece").collect()
    assert {r["k"] for r in found} == {1, 5}
    assert [r["piece_text"] for r in found if r["k"] == 5] == ["w" * 10, "w" * 2]
    first = [r for r in found if r["k"] == 1]
    assert first[0]["path"] == ["h"] and first[0]["piece_text"] + "".join(r["piece_text"][3:] for r in first[1:]) == "x" * 30
    assert split_oversized(df.limit(0), "k", "t", "l", "o").count() == 0

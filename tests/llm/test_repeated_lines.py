import numpy as np
import pytest

from tarnwick.llm import repeated_lines as R
from tarnwick.llm.repeated_lines import letters, page_chunks, repeated_lines, without_repeated_chunks, without_repeated_lines

ROWS = [(i, "f", f"HEADER of file 12{i}\nUnique words number {'abcdefgh'[i]} stand here {'xyzw' * (i + 1)}\n\n{i}\nEnd") for i in range(6)] + [(7, "f", None), (8, "f", ""), (9, "g", "HEADER of file\nx"), (10, "g", "y"), (None, "f", "End"), (11, None, "End")]


def brute(rows, least=4, share=0.3):
    pages, on, of = {}, {}, {}
    for p, s, t in rows:
        if p is not None and s is not None:
            pages[p] = (s, t or "")
    for p, (s, t) in pages.items():
        of.setdefault(s, set()).add(p)
        for line in t.split("\n"):
            if letters(line):
                on.setdefault((s, letters(line)), set()).add(p)
    good = {k for k, v in on.items() if len(v) >= least and len(v) >= share * len(of[k[0]])}
    return {(p, n) for p, (s, t) in pages.items() for n, line in enumerate(t.split("\n"), 1) if (s, letters(line)) in good}


def test_against_brute_force(spark):
    rows = [*ROWS, ROWS[0], (6, "f", "Ünïcode End\nEND.\nheader OF file 9")]
    df = spark.createDataFrame(rows, "p long, s string, t string").selectExpr("*", "'x' chunk", "1 line_no", "2 whole")
    for mean in (2, 16):
        found = repeated_lines(df, "s", "p", "t", mean_chunk=mean)
        assert {(r["p"], r["line_no"]) for r in found.collect()} == brute(rows)
    kept = {r["p"]: r["kept_text"] for r in without_repeated_lines(df, "s", "p", "t").collect()}
    assert "End" not in kept[1] and kept[7] is None and kept[8] == "" and kept[10] == "y"
    assert repeated_lines(df.limit(0), "s", "p", "t").count() == 0


def test_chunks_inside_a_line_are_there_wherever_it_stands():
    line = "All rights stay with the railway; passing on needs written consent. " * 3
    pages = ["abc\n" + line + "\n\nother words", line, "x y z " + "\nquite another beginning\n" + line + "\nend"]
    (page, chunk), (on, number, _, lead, has) = page_chunks(pages, 8)
    found = [lead[(on == p) & (number == n)] for p, n in ((0, 2), (1, 1), (2, 3))]
    assert has[(on == 0) & (number == 2)].all() and len({int(f[0]) for f in found}) == 1
    assert all(int(found[0][0]) in set(chunk[page == p].tolist()) for p in range(3))


def test_chunks_do_not_depend_on_where_lines_end():
    text = "All rights stay with the railway; passing on needs written consent of the editor."
    one, two = (page_chunks([t], 8)[0][1] for t in (text, text.replace(" ", "\n", 9)))
    assert one.tolist() == two.tolist() and len(one) > 3


def test_a_notice_wrapped_otherwise_on_every_page_is_cut(spark):
    words = "all rights stay with the railway and passing on of this manual needs the written consent of the editing cell".split()
    own = ["amber brick cedar dune", "eagle flint grove harbour", "island jungle kettle lantern", "meadow needle orchard pebble", "quarry ribbon saddle timber"]
    rows = [(i, "f", f"{own[i]}\n" + " ".join(words[: 4 + i]) + "\n" + " ".join(words[4 + i :]) + f"\n{own[-1 - i]} {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "p long, s string, t string")
    assert repeated_lines(df, "s", "p", "t").count() == 0
    for r in without_repeated_chunks(df, "s", "p", "t", mean_chunk=6).collect():
        assert own[r["p"]] in r["kept_text"] and "passing on of this manual" not in r["kept_text"].replace("\n", " ") and r["cut_letters"] > 60


@pytest.mark.parametrize("keys", [0, 1 << 20])
def test_broadcast_and_merge_give_the_same(spark, monkeypatch, keys):
    monkeypatch.setattr(R, "BROADCAST_KEYS", keys)
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "st", "un", "vel", "xim")]
    lines = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(40)]
    rows = [(i, f"s{i % 3}", "\n".join(str(rng.choice(lines)) if rng.random() < 0.5 else " ".join(rng.choice(words, 7)) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(rows, "p long, s string, t string")
    assert {(r["p"], r["line_no"]) for r in repeated_lines(df, "s", "p", "t", min_share=0.2).collect()} == brute(rows, share=0.2)


def test_hot_source(spark):
    df = spark.range(3000).selectExpr("id p", "if(id % 3 = 0, 'hot', concat('s', id % 50)) s", "concat('same line everywhere\nown ', repeat(chr(97 + cast(id % 26 as int)), cast(id % 60 as int)), '\n', id) t")
    rows = [tuple(r) for r in df.collect()]
    assert {(r["p"], r["line_no"]) for r in repeated_lines(df, "s", "p", "t").collect()} == brute(rows)

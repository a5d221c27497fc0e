import random
import time

import pytest

from tidewords.llm import pieces


def test_text_pieces_keep_limit_overlap_and_words():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice(["word", "end.", "part,", "x"]) for _ in range(rng.randint(1, 400))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t"]) for w in words)
        got = pieces.cut_text(text, 120, 15)
        assert all(n <= 120 for _, n, _ in got)
        assert got[0][0] == 0 and got[-1][0] + got[-1][1] == len(words)
        for (a, n, _), (b, _, _) in zip(got, got[1:], strict=False):
            assert a + n - b == 15  # exactly the overlap
        for a, n, t in got:
            assert t.split() == words[a : a + n]
        assert (len(got) > 1) == (len(words) > 120)


def test_cuts_lie_at_sentence_ends():
    text = " ".join(["one two three four five six seven eight nine ten."] * 30)
    got = pieces.cut_text(text, 120, 15)
    assert all(t.endswith(".") for _, _, t in got)


OUTLINE = """# One

Intro words here that go on. Second sentence here.

## Sub

- item one is here
  - nested a
  - nested b
- item two is longer than that

# Heading two

## Deeper

Body of two, with clauses; and more. Another sentence now. Third one is here too.

<h2>Tagged title</h2> <p>para one</p> <ul><li>aa</li> <li>bb <ol><li>cc</li></ol></li></ul>
"""


def test_headings_lists_and_markup_are_parsed():
    spans, depth = pieces.depths(OUTLINE)
    at = {OUTLINE[a:b]: d for (a, b), d in zip(spans, depth, strict=True)}
    assert [at[w] for w in ("Intro", "Body", "<p>para", "item", "nested")] == [pieces.GLUED] * 5
    assert [d for (a, b), d in zip(spans, depth, strict=True) if OUTLINE[a:b] in ("#", "##", "-")] == [1, 2, pieces.GLUED, 9, 9, 8, 1, pieces.GLUED]
    assert [at["<h2>Tagged"], at["<ul><li>aa</li>"], at["<li>bb"], at["<ol><li>cc</li></ol></li></ul>"]] == [2, 7 + 1, 8, 9]


def test_headings_stay_with_what_follows():
    for most in range(9, 40):
        for a, n, t in pieces.cut_text(OUTLINE, most, 0):
            lines = [x for x in t.splitlines() if x.strip()]
            if len(t.split()) > 4 or most > 12:
                assert not lines[-1].startswith("#") and lines[-1].strip() != "-"
        assert sum(n for _, n, _ in pieces.cut_text(OUTLINE, most, 0)) == len(OUTLINE.split())
    # sections that fit are merged whole, one that doesn't fit begins a piece of its own
    text = "# A\nalpha beta.\n# B\n" + "gamma delta. " * 8 + "\n# C\nlast one.\n# D\nvery last."
    got = [t.split("\n")[0] for *_, t in pieces.cut_text(text, 12, 0)]
    assert got[0] == "# A" and "# B" in got and got[-1] == "# C"


def _w(t, a, b):
    return {"text": t, "start_s": a, "end_s": b}


def test_timed_pieces():
    words = [_w(f"w{i}", i * 0.5, i * 0.5 + 0.4) for i in range(100)]
    got = pieces.cut_timed("", None, None, words, 15.0, 1.0)
    assert all(b - a <= 15.0 + 1e-9 for a, b, _ in got)
    for (_, b, _), (a, _, _) in zip(got, got[1:], strict=False):
        assert abs(b - a - 1.0) < 1e-9
    assert {x for _, _, t in got for x in t.split()} == {f"w{i}" for i in range(100)}
    # a word that is far too long, no usable words, nothing known at all
    assert all(b - a <= 15 for a, b, _ in pieces.cut_timed("x", 0.0, 50.0, [_w("x", 0.0, 50.0)], 15.0, 1.0))
    assert " ".join(t for *_, t in pieces.cut_timed("a b c d", 0.0, 40.0, [_w("q", None, 1.0)], 15.0, 1.0)) == "a b c d"
    assert pieces.cut_timed("a", None, 3.0, None, 15.0, 1.0) == []


def test_timed_pieces_overlap_exactly():
    rng = random.Random(5)
    for _ in range(300):
        t, words = rng.uniform(0, 5), []
        for i in range(rng.randint(1, 120)):
            size = rng.choice([0.0, 0.2, 0.4, 1.1, 3.0, 20.0]) if rng.random() < 0.1 else 0.3
            words.append(_w(f"w{i}" + rng.choice(["", "", ".", ","]), t, t + size))
            t = max(0.0, t + size + rng.choice([-0.4, 0.0, 0.0, 0.05, 0.3, 0.7, 40.0 if rng.random() < 0.02 else 0.1]))
        own = rng.random() < 0.5
        a, b = (words[0]["start_s"] - 0.5, max(w["end_s"] for w in words) + 0.5) if own else (None, None)
        got = pieces.cut_timed("", a, b, words, 15.0, 1.0)
        assert all(y - x <= 15.0 + 1e-9 for x, y, _ in got)
        assert all(abs(y - x - 1.0) < 1e-9 for (_, y, _), (x, _, _) in zip(got, got[1:], strict=False))
        assert abs(got[0][0] - (a if own else min(w["start_s"] for w in words))) < 6e-4 and abs(got[-1][1] - (b if own else max(w["end_s"] for w in words))) < 6e-4
        said = [w for *_, x in got for w in x.split()]
        assert set(said) == {w["text"] for w in words}


def test_long_texts_take_linear_time():
    began = time.time()
    assert sum(n for _, n, _ in pieces.cut_text("word " * 400_000, 120, 0)) == 400_000
    assert sum(n for _, n, _ in pieces.cut_text("one two.\n- three\n" * 60_000, 120, 0)) == 240_000
    assert time.time() - began < 30


def test_rows_of_every_kind(spark):
    rows = [("a", "w " * 121), ("a", "w " * 121), ("b", "w " * 120), ("c", ""), ("d", None), ("e", "x　" * 200_000)]
    df = spark.createDataFrame([(*r, 0, 9) for r in rows], "row_key string, text string, piece_no int, size int")
    got = pieces.text_pieces(df, ["row_key"], 120, 15).collect()
    assert {r.row_key for r in got} == {"a", "e"}
    assert sum(r.row_key == "a" and r.piece_no == 0 for r in got) == 2
    word = "array<struct<text:string,start_s:double,end_s:double,confidence:double>>"
    w = [("x", 0.0, 16.0, 1.0), ("y", float("nan"), 99.0, 1.0), ("z", 5.0, 4.0, None)]
    items = [("a", "x", None, 3.0, w), ("b", "x", 0.0, 15.0, w), ("c", "x", 0.0, 15.001, None), ("d", None, None, None, None), ("e", "x", 0.0, None, [])]
    df = spark.createDataFrame(items, f"row_key string, text string, start_s double, end_s double, words {word}")
    assert {r.row_key for r in pieces.timed_pieces(df, ["row_key"], 15.0, 1.0).collect()} == {"a", "c"}
    assert pieces.timed_pieces(df.limit(0), ["row_key"], 15.0, 1.0).count() == 0
    with pytest.raises(ValueError):
        pieces.text_pieces(df, ["row_key"], 15, 15)

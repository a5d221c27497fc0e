import pytest

from tidewords.llm import charforms as cf

ZWJ, SHY, NBSP, ACUTE = "‍", "­", " ", "́"
CASES = [
    ("ｈｉ １２", "hi 12"),
    ("oﬃce", "office"),
    ("cafe" + ACUTE, "café"),
    ("й", "й"),
    ("a" + NBSP + "b　c", "a b c"),
    ("in" + SHY + "vis​ible﻿", "invisible"),
    ("mаnаgers", "managers"),
    ("билeты", "билеты"),
    ("t" + ZWJ + "he", "the"),
    ("ｶﾞｷﾞ ﾊﾟ", "ガギ パ"),
    ("ｏｈ！", "oh!"),
    ("\U0001d407\U0001d41e\U0001d425\U0001d425\U0001d428 \U0001d7d0", "Hello 2"),
    ("\u0501ance", "dance"),
    ("\u0261o", "go"),
    ("\u04c0taly", "Italy"),
]
STABLE = ["", "plain text", "“quotes” — dots…", "весь хор and words", "\U0001f469" + ZWJ + "\U0001f4bb", "\U0001f3f4" + ZWJ + "☠️ ok", "USB-кабель", "naïve üß"]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_one_form(text, want):
    assert cf.canonical(text) == want
    assert cf.canonical(want) == want


@pytest.mark.parametrize("text", STABLE)
def test_stable_text_is_untouched(text):
    assert cf.canonical(text) == text


def test_rows_of_every_kind(spark):
    long = "word " * 50_000
    rows = [(1, t) for t, _ in CASES] + [(2, t) for t in STABLE] + [(3, None), (4, ACUTE + "a"), (2, long), (2, long)]
    df = spark.createDataFrame([(k, t, "x", True) for k, t in rows], "k int, text string, canonical string, changed boolean")
    got = cf.with_canonical(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.changed == (r.k in (1, 4))
        assert r.canonical == cf.canonical(r.text)
    assert cf.with_canonical(df.limit(0)).count() == 0


def test_marks_move_to_the_token_before(spark):
    rows = [("s", 0, "caf", False), ("s", 1, "e", True), ("s", 1, "e", True), ("s", 2, ACUTE + "s", True), ("s", 3, ACUTE + "x", False), ("t", 0, ACUTE + "y", True), ("t", 1, None, True)]
    df = spark.createDataFrame(rows, "source_id string, pos int, text string, joins_left boolean")
    got = {(r.source_id, r.pos): r.text for r in cf.canonical_words(df).collect()}
    assert got == {("s", 0): "caf", ("s", 1): "é", ("s", 2): "s", ("s", 3): ACUTE + "x", ("t", 0): ACUTE + "y", ("t", 1): None}


def test_marks_move_across_blocks(spark, monkeypatch):
    rows = [("s", i, ("e" if i % 2 == 0 else ACUTE + "s"), i % 2 == 1) for i in range(60)]
    rows += [("n", None, ACUTE + "s", True), (None, 3, ACUTE + "s", True), (None, 2, "e", False)]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:7]], "source_id string, pos int, text string, joins_left boolean, block int")
    want = sorted(map(str, [("s", i, "é" if i % 2 == 0 else "s") for i in range(60)] + [("n", None, ACUTE + "s"), (None, 3, ACUTE + "s"), (None, 2, "e")]))
    for size in (4_096, 3, 1):
        monkeypatch.setattr(cf, "BLOCK", size)
        assert sorted(str((r.source_id, r.pos, r.text)) for r in cf.canonical_words(df).collect()) == want

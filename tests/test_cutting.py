import math
import random

import pytest
from models import clips as clips_model
from models import paragraphs as paragraphs_model

from tidewords.operators import blocks, cutting

SEG = "source_id string, pos int, text string, start_s double, end_s double, landed_at timestamp"
WORD = "source_id string, pos int, text string, start_s double, end_s double, confidence double, joins_left boolean"
VOCAB = "so now the a river went home. slowly, and then we saw it! Mr. 13 people don't know why? um okay but first".split()


def _lines(rng, n):
    rows, t = [], 0
    for _ in range(n):
        text = " ".join(rng.choice(VOCAB) for _ in range(rng.choice([0, 1, 3, 6, 9, 12, 150])))
        end = t + rng.randrange(0, 4000)
        rows.append((text, t, end))
        t = max(0, end + rng.choice([-1500, -300, 0, 200, 700, 2500, 5000]))
    return rows


def test_paragraphs_equal_the_model(spark):
    rng = random.Random(4)
    cases = {f"s{i}": _lines(rng, rng.choice([1, 2, 5, 20, 60])) for i in range(60)}
    rows = [(s, p, t, a / 1000, b / 1000, None) for s, ls in cases.items() for p, (t, a, b) in enumerate(ls)]
    got = {}
    for r in cutting.paragraphs(spark.createDataFrame(rows + rows[:20], SEG)).orderBy("source_id", "para_no").collect():
        got.setdefault(r.source_id, []).append((r.text, r.start_ms, r.end_ms))
    for s, ls in cases.items():
        assert got.get(s, []) == paragraphs_model(ls), s
        assert " ".join(t for t, _, _ in got.get(s, [])).split() == " ".join(t for t, _, _ in ls).split()


def _word_rows(rng, n):
    rows, t = [], 0
    for _ in range(n):
        a, b = t, t + rng.choice([50, 300, 700, 20000 if rng.random() < 0.05 else 400])
        if rng.random() < 0.04:
            a = None
        if rng.random() < 0.04:
            b = None
        if rng.random() < 0.04 and a is not None and b is not None:
            a, b = b, a
        rows.append((rng.choice([*VOCAB, " "]), a, b, rng.random() < 0.1))
        t += rng.choice([300, 400, 900, 3500])
    return rows


def test_clips_equal_the_model(spark):
    rng = random.Random(20260614)
    cases = {f"s{i}": _word_rows(rng, rng.choice([1, 2, 8, 25, 90])) for i in range(80)}
    sec = lambda x: math.nan if x is None else x / 1000
    rows = [(s, p, t, sec(a), sec(b), 1.0, j) for s, ws in cases.items() for p, (t, a, b, j) in enumerate(ws)]
    got = {}
    for r in cutting.clips(spark.createDataFrame(rows + rows[:20], WORD)).orderBy("source_id", "clip_no").collect():
        got.setdefault(r.source_id, []).append((r.text, r.start_ms, r.end_ms, r.oversized))
    for s, ws in cases.items():
        assert got.get(s, []) == clips_model(ws), s


def test_empty_tables(spark):
    assert cutting.paragraphs(spark.createDataFrame([], SEG)).count() == 0
    assert cutting.clips(spark.createDataFrame([], WORD)).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_repeated_and_null_rows(spark, order):
    rows = [("a", 0, "one two", 0.0, 1.0, None), ("a", 0, "one two", 0.0, 1.0, None), (None, 1, "x", 0.0, 1.0, None), ("a", 1, None, None, None, None)][::order]
    got = cutting.paragraphs(spark.createDataFrame(rows, SEG)).collect()
    assert [(r.source_id, r.text) for r in got] == [("a", "one two")]


def test_long_runs_stream_through(spark, monkeypatch):
    """Runs of which only parts are held are cut as whole ones are."""
    rng = random.Random(21)
    words, lines = [], []
    for src, pauses in (("one", 0.0), ("two", 0.01), ("three", 0.1)):
        t = u = 0.0
        for i in range(1_500):
            d = rng.choice([0.0, 0.1, 0.3, 0.5, 20.0 if rng.random() < 0.01 else 0.2])
            words.append((src, i, rng.choice(["so", "word", "end.", "part,", "the", "", "7"]), t, t + d, 1.0, rng.random() < 0.1))
            t += d + (3.0 if rng.random() < pauses else rng.choice([0.0, 0.05, 0.3]))
            k = rng.choice([0, 1, 3, 8, 8, 8, 30])
            lines.append((src, i, " ".join(rng.choice(["so", "word", "end.", "part,"]) for _ in range(k)), u, u + 2.0, None))
            u += 2.0 + (3.0 if rng.random() < pauses else 0.0)
    w = spark.createDataFrame(words, "source_id string, pos int, text string, start_s double, end_s double, confidence double, joins_left boolean")
    s = spark.createDataFrame(lines, "source_id string, pos int, text string, start_s double, end_s double, landed_at timestamp")
    key = lambda r: (r[0], r[1])
    want = [sorted(map(tuple, f(df).collect()), key=key) for f, df in ((cutting.clips, w), (cutting.paragraphs, s))]
    monkeypatch.setattr(blocks, "HOLD", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        got = [sorted(map(tuple, f(df).collect()), key=key) for f, df in ((cutting.clips, w), (cutting.paragraphs, s))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert len(want[0]) > 200 and len(want[1]) > 60


def test_lookup_equals_a_join(spark):
    rows = spark.createDataFrame([(k, i) for i in range(90) for k in ("a", "b", None)], "k string, i int")
    table = spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")
    for how in ("left", "inner"):
        assert sorted(map(str, blocks.lookup(rows, table, ["k"], ["i"], how).collect())) == sorted(map(str, rows.join(table, "k", how).collect()))

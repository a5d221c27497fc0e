import random

from pyspark.sql import functions as F

from tidewords.operators import intervals

ROW = "source_id string, start_s double, end_s double, key string, t bigint, d int, block bigint"


def _model(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _df(spark, rows):
    return intervals.spans(spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], ROW), F.col("source_id"))


def test_periods_and_gaps_equal_the_model(spark):
    rng = random.Random(1)
    rows = []
    for s in range(30):
        t = 0
        for _ in range(rng.randint(1, 60)):
            t = max(0, t + rng.choice([-5000, -10, 0, 1, 1999, 2000, 2001, 9000, 700_000]))
            rows.append((f"s{s}", t / 1000, (t + rng.choice([0, 1, 500, 4000, 30_000])) / 1000))
    rows += rows[:40]
    rng.shuffle(rows)
    by = {}
    for s, a, b in rows:
        by.setdefault(s, []).append((round(a * 1000), round(b * 1000)))
    df = _df(spark, rows)
    want = {s: _model(v) for s, v in by.items()}
    for block in (1_000, 60_000, 10**9):  # the block's length changes nothing
        got = {(r.key, r.start_ms, r.end_ms) for r in intervals.periods(df, block_ms=block).collect()}
        assert got == {(s, *p) for s, v in want.items() for p in v}
        gaps = {tuple(r) for r in intervals.gaps(df, least_ms=2000, most_ms=600_000, block_ms=block).collect()}
        assert gaps == {(s, x[1], y[0]) for s, v in want.items() for x, y in zip(v, v[1:], strict=False) if 2000 <= y[0] - x[1] <= 600_000}


def test_bad_rows_count_for_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", None, 1.0), ("a", nan, 1.0), ("a", 0.0, inf), ("a", 5.0, 4.0), (None, 0.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 10.0, 10.0), ("a", 20.0, 21.0)]
    got = [tuple(r) for r in intervals.gaps(_df(spark, rows)).orderBy("gap_start_ms").collect()]
    assert got == [("a", 3000, 10_000), ("a", 10_000, 20_000)]  # a span of no length parts a gap
    assert intervals.gaps(_df(spark, [])).count() == 0 and intervals.periods(_df(spark, [])).count() == 0

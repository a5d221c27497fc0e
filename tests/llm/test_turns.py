import random

import numpy as np
import pytest

from tidewords.llm import turns
from tidewords.llm.people import person

SEG = "source_id string, pos int, text string, start_s double, end_s double, landed_at timestamp, speaker string, rank int"
TURN = "source_id string, speaker string, start_s double, end_s double"


def _run(spark, segs, tns, **kw):
    df = spark.createDataFrame([(s, p, t, a, b, None, "clash", 5) for s, p, t, a, b in segs], SEG)
    return turns.with_turns(df, spark.createDataFrame(tns, TURN), **kw)


def _opens(spark, segs, tns):
    df = spark.createDataFrame([(s, p, t, a, b, None, "clash", 5) for s, p, t, a, b in segs], SEG)
    got = {tuple(r) for r in turns.openings(df, spark.createDataFrame(tns, TURN)).collect()}
    assert got == {(r.source_id, r.pos) for r in _run(spark, segs, tns).where("opens").collect()}
    return got


def test_names():
    assert {person(x) for x in (" brda ashabell:", "Ashabell, Brda", "BRDA ASHABELL", "brda_ashabell", "Brda Ashabell", "Ｂrda  Ashabell")} == {"brda ashabell"}
    assert {person(x) for x in ("SPEAKER_00", "spk0", "Speaker 0", "SPEAKER 00 ")} == {"#0"}
    assert [person(x) for x in (None, "", "Host", "unknown", "Guest")] == [None] * 5


def test_labels_hold_and_new_forms_open_nothing(spark):
    segs = [
        ("a", 0, "hello there", 0.0, 1.0),
        ("a", 1, "Brda Ashabell: first words", 1.0, 2.0),
        ("a", 2, "go on", 2.0, 3.0),
        ("a", 3, "[music]", 3.0, 3.5),
        ("a", 4, "ASHABELL: still me", 4.0, 5.0),
        ("a", 5, "[00:01:02] >> Jaria: (laughs)", 5.0, 6.0),  # the label stands on a segment that isn't spoken
        ("a", 6, "um, uh", 6.0, 7.0),
        ("a", 7, "Note: now another speaks", 7.0, 8.0),
        ("a", 9, "J. Ravdiholm: again", 9.5, 10.0),
        ("a", 8, "(they did, twice)", 9.0, 9.4),
        ("a", 10, "B. Ashabell: back", 11.0, 12.0),
        ("a", 10, "B. Ashabell: back", 11.0, 12.0),
        ("a", 11, None, 12.0, 13.0),
        ("a", 12, "", 13.0, 14.0),
        (None, 1, "x", 0.0, 1.0),
    ]
    tns = [("a", "Brda Ashabell", 0.0, 1.0), ("a", "Ravdiholm, Jaria", 5.0, 6.0), ("a", None, 0.0, 9.0)]
    got = sorted((r.pos, r.opens, r.speaker, r.text) for r in _run(spark, segs, tns).collect())
    assert [p for p, o, *_ in got if o] == [0, 1, 7, 10]
    assert {p: s for p, _, s, _ in got}[4] == "brda ashabell" and {p: s for p, _, s, _ in got}[8] == "jaria ravdiholm"
    assert {p: t for p, *_, t in got}[8] == "(they did, twice)" and 3 not in {p for p, *_ in got} and 6 not in {p for p, *_ in got}
    no = turns.numbered(_run(spark, segs, tns)).orderBy("pos").collect()
    assert max(r.turn_no for r in no) == 4


def test_sources_without_labels(spark):
    segs = [("a", i, f"line {i}", float(i), i + 1.0) for i in range(6)] + [("b", 0, "one", 0.0, 1.0), ("b", 1, "two", 700.0, 701.0), ("c", 0, "x", None, None)]
    tns = [("a", "spk0", 0.0, 2.6), ("a", "SPEAKER_00", 0.0, 2.6), ("a", "spk1", 2.6, 4.0), ("a", "Speaker 0", 4.0, 6.0), ("a", "spk1", 9.0, 8.0), ("a", "spk1", float("nan"), 9.0)]
    got = _opens(spark, segs, tns)
    assert got == {("a", 0), ("a", 3), ("a", 4), ("b", 0), ("c", 0)}


def test_full_labels_that_no_turn_knows(spark):
    said = {
        "a": ["Anna Smith: hello", "more of it", "Bob Jones: yes", "Note: well"],  # one each
        "b": ["before", "Anna Smith: hello", "Anna Smith: again"],
        "c": ["Breaking News: it rains", "and pours"],
        "d": ["Anna: which one", "Anna Smith: me", "Anna Jones: or me"],
        "e": ["SPEAKER_01: hi", "Anna Smith: hello"],
        "f": ["Host: hi", "Anna Smith: hello"],
        "g": ["ASHABELL: hi", "Anna Smith: hello"],
    }
    segs = [(s, i, t, float(i), i + 1.0) for s, lines in said.items() for i, t in enumerate(lines)]
    tns = [("d", "Anna Smith", 0.0, 1.0), ("d", "Anna Jones", 1.0, 2.0), ("g", "Brda Ashabell", 0.0, 1.0)]
    got = {s: [] for s in said}
    for r in sorted(_run(spark, segs, tns).collect(), key=lambda r: (r.source_id, r.pos)):
        got[r.source_id].append((r.speaker, r.opens, r.text))
    anna = ("anna smith", True, "hello")
    assert got["a"] == [anna, ("anna smith", False, "more of it"), ("bob jones", True, "yes"), ("bob jones", False, "Note: well")]
    assert got["b"] == [(None, True, "before"), anna, ("anna smith", False, "again")]
    assert got["c"] == [(None, True, "Breaking News: it rains"), (None, False, "and pours")]
    assert got["d"] == [("anna", True, "which one"), ("anna smith", True, "me"), ("anna jones", True, "or me")]
    assert [got[s][1] for s in "efg"] == [anna] * 3


def test_blocks_hand_on_labels(spark):
    segs = [("a", i, ("Brda: " if i % 40 == 0 else "") + "talk", i * 30.0, i * 30.0 + 5) for i in range(100)]
    assert _opens(spark, segs, [("a", "Brda Ashabell", 0.0, 1.0)]) == {("a", 0)}
    # the label at a block's end stands on a segment that isn't spoken; the next block's first one has another
    segs = [("a", 0, "Brda: talk", 1.0, 2.0), ("a", 1, "Jaria:", 590.0, 591.0), ("a", 2, "more", 1300.0, 1301.0), ("a", 3, "Brda: talk", 1302.0, 1303.0), ("a", 4, "talk", 3000.0, 3001.0)]
    assert _opens(spark, segs, [("a", "Brda Ashabell", 0.0, 1.0), ("a", "Jaria Ravdiholm", 5.0, 6.0)]) == {("a", 0), ("a", 2), ("a", 3)}
    # turns and segments that reach over blocks
    segs = [("a", 0, "talk", 590.0, 640.0), ("a", 1, "talk", 700.0, 701.0), ("a", 2, "talk", 1190.0, 1900.0)]
    tns = [("a", "one", 580.0, 601.0), ("a", "two", 601.0, 650.0), ("a", "two", 640.0, 1300.0), ("a", "three", 1300.0, 2000.0)]
    assert _opens(spark, segs, tns) == {("a", 0), ("a", 2)}


def test_missing_starts_hang_on_their_neighbours(spark):
    tns = [("a", "Brda Ashabell", 0.0, 1.0), ("a", "Jaria Ravdiholm", 5.0, 6.0)]
    segs = [
        ("a", 0, "Brda: one", 10.0, 11.0),
        ("a", 1, "two", None, None),  # after 0, though 3 and 4 start earlier
        ("a", 2, "Jaria:", None, None),  # names the speaker of 3
        ("a", 3, "three", 5.0, 6.0),
        ("a", 4, "four", 7.0, 8.0),
        ("a", 5, "five", float("nan"), None),
        ("a", 6, "Brda: six", 7.0, 7.5),
    ]
    got = _run(spark, segs, tns).orderBy("block", "rank").collect()
    assert [(r.pos, r.speaker) for r in got] == [(3, "jaria ravdiholm"), (4, "jaria ravdiholm"), (5, "jaria ravdiholm"), (6, "brda ashabell"), (0, "brda ashabell"), (1, "brda ashabell")]
    plain = sorted(range(7), key=lambda i: (segs[i][3] if segs[i][3] == segs[i][3] and segs[i][3] is not None else 1e18, i))
    assert [p for p in plain if p != 2] != [r.pos for r in got]
    df = spark.createDataFrame([(s, p, t, a, b, None, "clash", 5) for s, p, t, a, b in segs], SEG)
    assert [tuple(r) for r in turns.conflicts(df).collect()] == [("a", 5, 1)]


def test_undated_segments_at_the_ends_of_blocks(spark, monkeypatch):
    n, size = 60, 7
    rng = random.Random(2)
    segs = [("a", i, "Brda: x" if rng.random() < 0.2 else "Jaria:" if rng.random() < 0.2 else "talk", None if rng.random() < 0.6 else float(rng.randint(0, 3) * 700 + i), None) for i in range(n)]
    tns = [("a", "Brda Ashabell", 0.0, 1.0), ("a", "Jaria Ravdiholm", 5.0, 6.0)]
    whole = [(r.pos, r.opens) for r in _run(spark, segs, tns).orderBy("block", "rank").collect()]
    monkeypatch.setattr(turns, "BLOCK_POS", size)
    assert [(r.pos, r.opens) for r in _run(spark, segs, tns).orderBy("block", "rank").collect()] == whole
    assert _opens(spark, segs, tns) == {("a", p) for p, o in whole if o}


def _hung_model(start, cue):
    """Which time each row hangs on: by edges, the lightest of each cycle dropped."""
    n, out = len(start), list(start)
    i = 0
    while i < n:
        if start[i] is not None:
            i += 1
            continue
        j = i
        while j < n and start[j] is None:
            j += 1
        a, b = (start[i - 1] if i else None), (start[j] if j < n else None)
        k = j
        while k > i and cue[k - 1]:
            k -= 1
        for x in range(i, j):
            out[x] = (b if b is not None else a) if x >= k else (a if a is not None else b)
        i = j
    return out


def test_conflicts_of_random_rows():
    rng = random.Random(7)
    for _ in range(500):
        n = rng.randint(1, 30)
        start = [None if rng.random() < 0.4 else float(rng.randint(0, 6)) for _ in range(n)]
        cue = [rng.random() < 0.4 for _ in range(n)]
        hang, holds, waits = turns.hung(np.array([np.nan if s is None else s for s in start]), np.array(cue), np.zeros(n))
        want = _hung_model(start, cue)
        for i in range(n):
            if waits[i] == 0:
                assert hang[i] == want[i]
            else:
                assert start[i] is None
        ends = [i for i in range(n) if want[i] is not None]
        if len(ends) == n:
            order = turns.topological(np.array(want), np.arange(n), np.where(holds, np.arange(n) - 1, -1))
            place = {int(x): k for k, x in enumerate(order)}
            assert sorted(place) == list(range(n))
            assert all(place[i] < place[j] for i in range(n) for j in range(n) if want[i] < want[j])
            assert all(place[i - 1] < place[i] for i in range(1, n) if holds[i] and not waits[i] and not waits[i - 1])


def test_topological_order_by_edges_alone():
    nan = np.nan
    # a row without time goes after the one before it; an edge back to an earlier moment is dropped, not followed
    order = turns.topological(np.array([10.0, nan, 5.0, 7.0, nan]), np.array([0, 1, 2, 3, 4]), np.array([-1, 0, 1, 2, 3]))
    assert order.tolist() == [2, 3, 4, 0, 1]
    # a tie in which dialogue runs against positions
    assert turns.topological(np.array([1.0, 1.0, 2.0]), np.array([4, 3, 9]), np.array([-1, 4, -1])).tolist() == [0, 1, 2]
    assert turns.topological(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_blocks_that_are_worked_off_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    segs = [("a", i, rng.choice(["Brda: x", "Jaria: y", "talk", "[music]"]), float(rng.randint(0, 500)), 501.0) for i in range(400)] + [("b", i, "talk", float(i), i + 2.0) for i in range(300)]
    tns = [("a", "Brda Ashabell", 0.0, 1.0), ("a", "Jaria Ravdiholm", 5.0, 6.0)] + [("b", f"spk{i % 3}", i * 7.0, i * 7.0 + 9) for i in range(40)]
    want = [tuple(r) for r in _run(spark, segs, tns).orderBy("source_id", "block", "rank").select("source_id", "pos", "speaker", "opens").collect()]
    monkeypatch.setattr(turns, "HOLD", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = [tuple(r) for r in _run(spark, segs, tns).orderBy("source_id", "block", "rank").select("source_id", "pos", "speaker", "opens").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


@pytest.mark.parametrize(("inner", "sound"), [("door slams", True), ("phone ringing", True), ("MUSIC", True), ("people chatting loudly", True), ("DOOR SLAMS", True), ("", True), ("they did twice", False), ("about forty of them", False), ("the second one", False), ("for all your work", False), ("Brda Ashabell", False), ("James", False), ("as always", False)])
def test_annotations(inner, sound):
    assert turns.annotation(inner) is sound


def test_empty_tables(spark):
    assert _run(spark, [], []).count() == 0
    assert _opens(spark, [], []) == set()

import random

import pytest
from pyspark.sql import functions as F

from tidewords.errors import SourceError
from tidewords.functions import exact, scripts, urls
from tidewords.functions import text as tx
from tidewords.operators import blocks, filters, merge, sections, speakers, verify

WORDS = "array<struct<text:string,start_s:double,end_s:double,confidence:double>>"


def _col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_blocks_equal_plain_windows(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.randrange(9), "x") for k in "ab" for p in sorted(rng.sample(range(1000), 120))] + [("c", 5, 1, "x")]
    df = spark.createDataFrame(rows, "k string, p bigint, v int, extra string")
    got = blocks.neighbours(df, ["k"], "p", ["v"], size=64)
    got = blocks.running(got, ["k"], "p", F.col("v"), "total", size=64)
    got = blocks.running(got, ["k"], "p", F.col("v"), "top", size=64, highest=True)
    got = {(r.k, r.p): (r.prev and r.prev.v, r.next and r.next.v, r.total, r.top) for r in got.collect()}
    for k in "abc":
        own = [(p, v) for kk, p, v, _ in rows if kk == k]
        for i, (p, _) in enumerate(own):
            assert got[k, p] == (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None, sum(v for _, v in own[: i + 1]), max(v for _, v in own[: i + 1]))


def test_time_and_duration(spark):
    inf, nan = float("inf"), float("nan")
    assert _col(spark, [0.0, 59.9, 3661.0, 360000.0, -1.0, nan, inf, None], tx.format_timestamp, "double") == ["00:00:00", "00:00:59", "01:01:01", "100:00:00", "00:00:00", "00:00:00", "00:00:00", None]
    assert _col(spark, ["90", "1:30", "1:00:05", "", "x", "-5", None, "1:x"], tx.duration_seconds) == [90.0, 90.0, 3605.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_text_functions(spark):
    assert _col(spark, ["  a  b\n", "", None], tx.collapse) == ["a b", "", None]
    assert _col(spark, ["a b  c", " ", None], tx.word_count) == [3, 0, 0]
    assert _col(spark, ["Done.", "Done.”", "done", "да？", "so,"], tx.ends_sentence_mark) == [True, True, False, True, False]
    assert _col(spark, ["see Dr.", "(etc.)", "the U.S.", "end.", "at 3.14"], tx.ends_abbreviation) == [True, True, True, False, False]
    assert _col(spark, ["[Music]", "(they did, twice)", "[ ]", "[♪♪]", "[soft music plays] x", "[ominous Music, plays]"], tx.is_noise_cue) == [True, False, True, True, False, True]
    assert _col(spark, ["A Tale: of Two!", "বাংলা", "??", "x" * 200], tx.slug)[0::2] == ["a-tale-of-two", "episode"]
    safe = _col(spark, ["dQw4w9WgXcQ", "اردو", "a b/c"], tx.safe_id)
    assert safe[0] == "dQw4w9WgXcQ" and safe[1].startswith("clip-") and len(safe[1]) == 13 and safe[2] == "a-b-c"
    assert _col(spark, ["x" * 80, "x" * 81], tx.preview) == ["x" * 80, "x" * 77 + "..."]


def test_urls(spark):
    hosts, short, vid = ["video.example"], ["short.example"], "AAAAAAAAAA_"
    good = [f"https://www.video.example/watch?v={vid}&t=4", f"http://m.video.example/shorts/{vid}", f"https://short.example/{vid}"]
    bad = [f"https://evil.example/#short.example/{vid}", f"https://video.example.evil/watch?v={vid}", f"https://video.example/watch?v={vid}x", "not a url", None, "", f"ftp://video.example/watch?v={vid}"]
    assert _col(spark, good + bad, lambda c: urls.video_id(c, hosts, short)) == [vid] * 3 + [None] * 7
    lists = ["https://video.example/playlist?list=PL_1", "https://video.example/@me.too/videos", "https://video.example/channel/UC1", "https://video.example/@me/about", f"https://video.example/watch?v={vid}&list=PL_1"]
    assert _col(spark, lists, lambda c: urls.batch(c, hosts)) == ["PL_1", "@me.too", "UC1", None, None]


def test_scripts(spark):
    got = _col(spark, ["hello", "привет ok", "123", None, "××a"], scripts.dominant)
    assert [g and (g.script, g.n, g.letters) for g in got] == [("latin", 5, 5), ("cyrillic", 6, 8), None, None, ("latin", 1, 1)]
    assert _col(spark, ["en-GB", "pt_BR", "uz", None, ""], scripts.target) == ["latin", "latin", None, None, None]
    assert _col(spark, ["English", "en_GB", "und", "unknown", None], scripts.normalized_code) == ["en", "en", None, None, None]


def test_exact(spark):
    assert exact.heard("ＨẞLLO, wörld!") == "hssllo wörld"
    assert exact.ratio("", "!") == 1.0 and exact.ratio("abc", "abc.") == 1.0 and exact.ratio("abc", "xyz") == 0.0
    df = spark.createDataFrame([(0.125,), (2.675,), (None,)], "v double")
    assert [r[0] for r in df.select(exact.fixed("v", F.lit(2))).collect()] == ["0.12", "2.67", None]
    assert _col(spark, ["a&nbsp;b &amp; c", None], exact.unescape) == ["a b & c", None]


def test_chapters_and_time(spark):
    p = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 10.0, 12.0), ("a", 3, 10.0, 40.0), ("b", 1, 5.0, 6.0), ("b", 2, 304.0, 305.0), ("b", 3, 305.0, 310.0), ("b", 4, 900.0, 901.0), ("b", 4, 900.0, 901.0), ("c", 1, None, None)], "source_id string, para_no int, start_s double, end_s double")
    s = spark.createDataFrame([("a", [(10.0, "two", 20.0), (5.0, "one", 10.0)]), ("b", None), ("c", [])], "source_id string, chapters array<struct<start_time:double,title:string,end_time:double>>")
    got = {(r.source_id, r.para_no): (r.chapter_no, r.title) for r in sections.chapter_of(p, s).collect()}
    assert got["a", 1] == (None, None) and got["a", 2] == (1, "two") and got["b", 1] == (None, None)
    titled = {(r.source_id, r.para_no): (r.section_no, r.section) for r in sections.sections(p, s).collect()}
    assert titled["a", 1] == (1, "[00:00:00 – 00:00:01]") and titled["a", 3] == (2, "two")
    assert [titled["b", i][0] for i in (1, 2, 3, 4)] == [1, 1, 2, 3]
    assert sections.sections(p.limit(0), s).count() == 0


def test_speakers(spark):
    clips = spark.createDataFrame([("c1", "a", 0.0, 4.0, "x"), ("c2", "a", 50.0, 70.0, "x"), ("c3", "a", 200.0, 201.0, None), ("c4", "b", None, 1.0, None), ("c1", "a", 0.0, 4.0, "x"), (None, "a", 0.0, 1.0, "x")], "id string, source_id string, start_s double, end_s double, speaker string")
    turns = spark.createDataFrame([("a", "S1", 2.0, 4.0), ("a", "S0", 0.0, 2.0), ("a", "S0", 0.0, 2.0), ("a", "S1", 40.0, 65.0), ("a", "S2", 65.0, 66.0), ("a", None, 0.0, 9.0), ("a", "S3", 9.0, 1.0)], "source_id string, speaker string, start_s double, end_s double")
    got = {r.id: (r.speaker, r.overlap_ms, r.total_ms) for r in speakers.assigned(clips, turns).collect()}
    assert got == {"c1": ("S0", 2000, 4000), "c2": ("S1", 15_000, 16_000), "c3": (None, 0, 0), "c4": (None, 0, 0)}
    assert [tuple(r) for r in speakers.dominant(turns).collect()] == [("a", "S1", 27_000)]
    why = {r.id: r.reason for r in speakers.speaker_drops(clips, turns, mode="dominant").collect()}
    assert why == {"c1": "cross_speaker", "c2": None, "c3": "no_speaker", "c4": "no_speaker"}
    with pytest.raises(ValueError):
        speakers.speaker_drops(clips, turns, mode="other")


def test_first_reason_wins(spark):
    w = [("a", 0.0, 1.0, 0.9), ("b", 1.0, 2.0, 0.9)]
    gap = [("a", 0.0, 99.0, 0.9), ("b", 5.0, 6.0, 0.9)]
    text = "this is quite a normal sentence of speech"
    rows = [("empty", " ", 0.0, 9.0, w, "en"), ("short", text, 0.0, 0.5, w, "en"), ("long", text, 0.0, 15.1, w, "en"), ("silent", text, 0.0, 6.0, gap, "en"), ("script", "привет как дела", 0.0, 2.0, w, "en"), ("slow", "hi", 0.0, 9.0, w, "en"), ("fast", text * 9, 0.0, 9.0, w, "en"), ("loop", "go " * 60, 0.0, 9.0, w, "en"), ("unsure", text, 0.0, 3.0, [("a", 0.0, 1.0, 0.1)], "en"), ("kept", text, 0.0, 3.0, w, "en"), ("nolang", "hi", 0.0, 9.0, w, None), ("null", None, None, None, None, None), ("nan", text, 0.0, 3.0, [("a", float("nan"), 1.0, None), ("b", 1.0, 2.0, 0.5)], "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"ref string, text string, start_s double, end_s double, words {WORDS}, language string, reason string")
    got = {r.ref: r.reason for r in filters.reasons(df).collect()}
    assert got == {"empty": "empty_text", "short": "duration", "long": "duration", "silent": "internal_silence", "script": "non_target_script", "slow": "char_rate", "fast": "char_rate", "loop": "compression_ratio", "unsure": "confidence", "kept": None, "nolang": None, "null": "empty_text", "nan": None}
    assert filters.reasons(df, filters.Limits(enabled=False)).where("reason is not null").count() == 0
    assert filters.drops(filters.reasons(df)).count() == 9 + 1
    with pytest.raises(ValueError):
        filters.Limits(least_s=5, most_s=1)


def test_merge(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("a-2", 3), ("a", 4), ("b", 5), (None, 6)], "base string, pos int")
    got = {r.pos: r.unique_name for r in merge.unique_names(s, "base", "pos").collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-2", 4: "a-4", 5: "b", 6: None}
    vote = lambda v: tuple(merge.language_vote(spark.createDataFrame([(x,) for x in v], "language string")).collect()[0])
    assert vote(["en", "en", None]) == ("en", "en:2") and vote(["de", "en", "en"]) == ("und", "en:2 de:1") and vote([]) == ("und", "")
    assert merge.fingerprint({"a": 1, "token": "x"}) == merge.fingerprint({"token": "y", "a": 1}) != merge.fingerprint({"a": 2})
    state = spark.createDataFrame([("a", "f", True, ["p1", "p2"]), ("b", "f", True, ["p9"]), ("c", "g", True, ["p1"]), ("d", "f", False, ["p1"]), ("e", "f", True, ["p1"])], "source_id string, fingerprint string, ok boolean, paths array<string>")
    files = spark.createDataFrame([("p1",), ("p2",)], "path string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source_id string")
    assert [r[0] for r in merge.reusable(wanted, state, files, "f").collect()] == ["a"]
    items = spark.createDataFrame([(i,) for i in range(5)], "pos int")
    pick = lambda **k: sorted(r.pos for r in merge.picked(items, "pos", **k).collect())
    assert pick(latest=True) == [0] and pick(number=3) == [2] and pick(everything=True, limit=2) == [0, 1] and pick() == []
    with pytest.raises(ValueError):
        pick(number=0)
    for bad in ({"number": 6}, {"everything": True, "limit": 0}):
        with pytest.raises(SourceError):
            pick(**bad)


def test_merge_gathers_no_source(spark, data):
    import random

    from tidewords.plans import records

    rng = random.Random(4)
    names = ["a"] * 60 + [f"a-{n}" for n in rng.sample(range(90), 40)] + [None, "b-2", "b", "b", "c-99999999999999999999", "c"]
    want, used = {}, {}
    for n in {*names} - {None}:
        used.setdefault(n.rpartition("-")[0], set()).add(n)
    for i, n in enumerate(names):
        k, free = names[: i + 1].count(n), 1
        for _ in range(k - 1):
            free += 1
            while f"{n}-{free}" in used.get(n, ()):
                free += 1
        want[i] = n if n is None or k == 1 else f"{n}-{free}"
    named = merge.unique_names(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "base string, pos int"), "base", "pos")
    assert {r.pos: r.unique_name for r in named.collect()} == want
    state = spark.createDataFrame([("a", "f", True), ("b", "f", True), ("c", "f", True)], "source_id string, fingerprint string, ok boolean")
    paths = spark.createDataFrame([("a", "p1"), ("a", None), ("b", "p1"), ("b", "p9"), ("c", None)], "source_id string, path string")
    files = spark.createDataFrame([("p1",), (None,)], "path string")
    assert sorted(r[0] for r in merge.reusable(state, state, files, "f", paths).collect()) == ["a", "c"]
    for df in (named, records.resume(spark, data)):
        assert "collect_" not in df._jdf.queryExecution().toString()


def test_verdicts(spark):
    rows = [(0.6, 0.95, 0.99, 0.0), (0.1, 0.95, 0.99, 0.0), (0.6, 0.7, 0.99, 0.0), (0.6, 0.8, 0.9, 0.2), (None, None, None, None), (0.6, 0.95, 0.5, 0.9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, gap double, acc double, script double, edges double")
    got = [(r.v.verdict, r.v.reasons) for r in df.select("i", verify.verdict(F.col("gap"), F.col("acc"), F.col("script"), F.col("edges")).alias("v")).orderBy("i").collect()]
    assert got == [("trainable", []), ("not trainable", ["pairing"]), ("not trainable", ["accuracy"]), ("marginal", ["approximate", "mixed_script", "some_edges"]), ("marginal", ["unmeasured"]), ("not trainable", ["script", "edges"])]


def test_pairing_fails_on_a_shift(spark):
    texts = ["the quick brown fox jumps", "pack my box with liquor jugs", "how vexingly daft zebras leap", "sphinx of black quartz judge", "bright vixens dozing fowl quack"]
    base = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "id string, text string, h int")
    right = verify.pairing(verify.controls(base).withColumn("heard", F.col("text"))).collect()[0]
    shifted = verify.pairing(verify.controls(base).withColumn("heard", F.col("control"))).collect()[0]
    assert right.pairing_gap > 0.25 > 0 > shifted.pairing_gap
    assert verify.pairing(verify.controls(base.limit(1)).withColumn("heard", F.col("text"))).collect()[0].pairing_gap is None

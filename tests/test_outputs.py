import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewords import errors
from tidewords.functions import scripts, urls
from tidewords.operators import filters, merge, sections, verify
from tidewords.session import put, settle, swept
from tidewords.sinks import rows as sinks
from tidewords.sources import landed


def _col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_fetch_failures(spark):
    logs = ["ERROR: Private Video", "this video has been removed", "Please CONFIRM your age", "you're not a bot", "unsupported url: x", "a\nlast line", " \n ", None]
    got = _col(spark, logs, errors.fetch_failure)
    assert [g and g.kind for g in got] == ["private", "gone", "age", "check", "url", "other", "other", None]
    assert [g.tail for g in got[5:7]] == ["last line", "no error output"] and got[4].error == "SourceError"
    for g in got[:7]:
        e = errors.of_fetch("u", g.kind, g.tail)
        assert isinstance(e, errors.TidewordsError) and type(e).__name__ == g.error and e.hint and e.message.startswith("u ")
    kinds = [c for c in vars(errors).values() if isinstance(c, type) and issubclass(c, errors.TidewordsError)]
    assert len(kinds) > 12 and errors.WriteError("m").hint == ""


def test_stems_and_suffixes(spark):
    assert _col(spark, ["https://a.example/b/My Talk.mp3?x=1", "https://A.example/", "x", "", None], urls.stem) == ["my-talkmp3", "aexample", "x", "media", "media"]
    assert _col(spark, ["a/b.MP3", "b.wav?x", ".wav", "c", None], urls.suffix) == [".mp3", ".wav", "", "", None]
    assert _col(spark, ["a/b.MP3", "b.txt", "c"], urls.is_media) == [True, False, False]


def test_language_codes_that_are_taken(spark):
    assert _col(spark, [None, " ", "EN", "en_GB", "zh-Hant", "yue"], scripts.checked_code) == [None, None, "en", "en", "zh", "yue"]
    with pytest.raises(Exception, match="did you mean ur"):
        _col(spark, ["Urdu"], scripts.checked_code)
    with pytest.raises(Exception, match="no language code: xq"):
        _col(spark, ["xq"], scripts.checked_code)
    assert _col(spark, ["Mandarin", "farsi", "polish"], scripts.normalized_code) == ["zh", "fa", "pl"] and len(scripts.NAMED) == 31


def test_listings_and_shows(spark, tmp_path):
    for raw in ([("t", [])], [("t", None)], [("t", [("", "x", "y"), None])]):
        with pytest.raises(Exception, match="nothing is listed under t"):
            landed.playlist(spark.createDataFrame(raw, landed.PLAYLIST)).collect()
    (tmp_path / "f.xml").write_text("<rss><channel><title> Show </title><item><title>x</title></item></channel></rss>")
    (tmp_path / "g.xml").write_text("<rss><channel><item><title>x</title></item></channel></rss>")
    assert [landed.show(spark, str(tmp_path / f)).first().title for f in ("f.xml", "g.xml")] == ["Show", "Podcast"]
    (tmp_path / "m.json").write_text(json.dumps({"id": "v", "uploader": "u", "duration": 4.5}, indent=1))
    r = landed.read_metadata(spark, str(tmp_path / "m.json")).first()
    assert (r.video_id, r.title, r.channel, r.duration_s, r.chapters) == ("v", "Untitled", "u", 4.5, [])


def test_index_precedence_and_cards(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(errors.SourceError):
        landed.index_scan(spark, root)
    (tmp_path / "metadata.jsonl").write_text('{"file_name": "wavs/c.wav", "transcription": "three"}\n')
    assert landed.index_scan(spark, root)[1] == "audiofolder"
    (tmp_path / "metadata.csv").write_text("b|one|two\n\n  \nlone\n")
    df, kind = landed.index_scan(spark, root)
    assert kind == "ljspeech" and sorted((r.id, r.text) for r in df.collect()) == [("b", "two"), ("lone", "")]
    (tmp_path / "manifest.jsonl").write_text('{"audio_filepath": "wavs/a.wav", "duration": 1.5, "text": "one"}\n')
    df, kind = landed.index_scan(spark, root + "/")
    assert kind == "manifest" and [tuple(r) for r in df.collect()] == [("a", "wavs/a.wav", "one", 1.5)]
    assert tuple(landed.read_card(spark, root).first()) == (None, None)
    for language, model, want in (("en", "whisper-small", ("en", "small")), ("und", "parakeet-tdt", (None, "parakeet")), ("pt-BR", "", ("pt-BR", None))):
        put(spark, f"{root}/dataset_card.md", sinks.card("My set", 3, 90.0, language, model, {"duration": 2}))
        assert tuple(landed.read_card(spark, root).first()) == want


def test_slices(spark):
    kept = [(f"r{i}", "a", i, "t" * 90, 9) for i in range(1, 21)] + [(f"b{i}", "b", i, None, 9) for i in range(1, 6)]
    k = spark.createDataFrame(kept, "ref string, source_id string, seg bigint, text string, clip_id int")
    s = [(f"r{i}", "broken pipe" if i <= 3 else None, 0.01 if i == 4 else None if i == 5 else 2.0, 0.006 if i == 6 else None) for i in range(1, 20)]
    s += [(f"b{i}", "x" if i > 1 else None, 1.0, 0.0) for i in range(1, 6)]
    sl = spark.createDataFrame(s, "ref string, error string, written_s double, clipped double")
    clips, drops, lost = filters.sliced(k.drop("clip_id"), sl, clipping=True)
    assert [tuple(r) for r in lost.collect()] == [("b", 4, 5)]  # four of five, more than three
    got = {r.clip: (r["filter"], r.value, r.threshold) for r in drops.collect()}
    assert got == {"r1": ("slice_failed", "broken pipe", "cut"), "r2": ("slice_failed", "broken pipe", "cut"), "r3": ("slice_failed", "broken pipe", "cut"), "r20": ("slice_failed", "not cut", "cut"), "r4": ("empty_slice", "0.00s", ">0s"), "r5": ("empty_slice", "0.00s", ">0s"), "a_0001": ("clipping", "0.60%", "<=0.5%")}
    assert sorted(r.clip_id for r in clips.collect()) == [f"a_{i:04}" for i in range(2, 15)]
    assert all(x.count() == 0 for x in filters.sliced(k.drop("clip_id").limit(0), sl.limit(0)))


def test_outcomes_and_ids(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "source_id string")
    tried = spark.createDataFrame([("a", None), ("a", None), ("b", "gone"), ("c", None)], "source_id string, error string")
    out = merge.outcome(one("a", "a", "b"), one("a", "c"), tried)
    assert {r.source_id: tuple(r)[1:] for r in out.collect()} == {"a": (2, 1, True, None), "b": (1, 0, False, "gone"), "c": (0, 1, False, "no clips")}
    assert tuple(merge.succeeded(out).first()) == (1, 2, 3, 2)
    assert sorted(r[0] for r in merge.all_ids(one("a", None), one("b", "a")).collect()) == ["a", "b"]
    assert [merge.clamped_limit(x) for x in (None, 0, "7", 99, -3, "x", 1)] == [5, 5, 7, 25, 1, 5, 1]


def test_checks_of_nothing_and_of_everything(spark):
    m = "id string, audio_path string, text string, duration_s double"
    f = "path string, actual_s double, channels int, width int, rate int"
    none = verify.checks(spark.createDataFrame([], m), spark.createDataFrame([], f)).orderBy("place").collect()
    assert [(c.check, c.ok, c.bad) for c in none] == [(n, True, 0) for n in verify.CHECKS if n not in ("durations", "index agrees")]
    rows = [("a", "wavs/a_0001.wav", "x", 1.0), ("a", "wavs/a_0001.wav", "x", 1.0), ("b", None, None, None), ("c", "wavs/c_0001.wav", "y\x01", 9.0), ("d", "wavs/d.wav", "z", None)]
    files = [("wavs/a_0001.wav", 1.04, 1, 2, 16_000), ("wavs/a_0001.wav", 1.04, 1, 2, 16_000), ("wavs/c_0001.wav", 1.0, 2, 2, 8_000), ("wavs/d.wav", None, None, None, None), ("wavs/e_0001.wav", 1.0, 1, 2, 16_000), ("notes.wav", 1.0, 1, 2, 16_000)]
    lines = spark.createDataFrame([("a|x|x",), ("c|y|other",), ("bad",), (" ",)], "line string")
    got = verify.checks(spark.createDataFrame(rows, m), spark.createDataFrame(files, f), lines).orderBy("place").collect()
    assert [(c.bad, c.of, c.example) for c in got] == [(1, 5, "b"), (1, 5, "a"), (2, 5, "b"), (3, 4, "c"), (1, 3, "c"), (1, None, "wavs/e_0001.wav"), (2, None, None)]
    said = verify.sentences({"pairing_gap": 0.5, "pairing_mean": 0.8, "script_share": 0.9, "language": "el", "hot_edges": 0.2}, [c.asDict() for c in got])
    assert said[0] == "Broken: audio present fails for 1 of 5, such as b." and said[5].startswith("Untidy: no orphans") and len(said) == 10
    assert verify.sentences({"pairing_gap": 0.5, "pairing_mean": 0.95}, []) == []
    md, js = sinks.report({"verdict": "marginal", "clips": 5}, [c.asDict() for c in got], said, [{"clip": "a", "own": 0.9, "control": None, "heard": "x|y"}])
    assert md.count("| failed |") == 5 and "| a | 0.900 | n/a | x y |" in md and json.loads(js)["reasons"] == said


def test_hot_share(spark):
    df = spark.createDataFrame([("a", 0.6), ("a", 0.5), ("a", None), ("a", float("nan")), ("b", None)], "k string, edge_ratio double")
    assert {r.k: (r.measured, r.hot_edges) for r in verify.hot_share(df, ["k"]).collect()} == {"a": (2, 0.5), "b": (0, None)}


def test_formats_indexes_and_speakers(spark, tmp_path):
    c = spark.createDataFrame([("a_0001", "wavs/a_0001.wav", "one | two", 1.23456, "Ada B."), ("a_0002", "wavs/a_0002.wav", "zwei", 1.0, None), ("a_0003", "wavs/a_0003.wav", "x", 1.0, "!!")], "id string, audio_path string, text string, duration_s double, speaker string")
    for bad in ([], ["jsonl", "xml"]):
        with pytest.raises(errors.DatasetError):
            sinks.write_indices(c, str(tmp_path), bad)
    assert sinks.checked_formats(["jsonl", "hf"]) == [] and len(sinks.write_indices(c, str(tmp_path / "i"), ["hf", "ljspeech", "jsonl", "hf"])) == 1
    assert [spark.read.text(str(tmp_path / "i" / n)).count() for n in ("manifest.jsonl", "metadata.csv", "metadata.jsonl")] == [3, 3, 3]
    sinks.write_by_speaker(c, str(tmp_path / "s"), ["ljspeech"])
    assert {p.name for p in (tmp_path / "s").glob("speaker*")} == {"speaker_slug=Ada-B", "speaker_slug=unknown"}
    assert spark.read.text(str(tmp_path / "s_ljspeech" / "speaker_slug=Ada-B")).first().value == "a_0001|one two|one two"
    assert sinks.zipped(str(tmp_path / "s"), str(tmp_path / "s.zip")) == 2
    assert all(n.endswith(".txt") for n in zipfile.ZipFile(tmp_path / "s.zip").namelist())


def test_cards(spark):
    sources = [{"source_id": "a", "clips": 3, "dropped": 1, "ok": True, "error": None}, {"source_id": "b", "clips": 0, "dropped": 0, "ok": False, "error": "gone"}]
    text = sinks.card('My "set"', 1_000, 90.0, "und", "", {"duration": 2}, sources=sources, oversized=4)
    assert 'pretty_name: "My \\"set\\""' in text and "1K<n<10K" in text and "Merged from 1 sources, 1 left out." in text and "- left out: b, gone" in text and "4 of them over" in text
    n = [1, 999, 1_000, 99_999, 999_999, 1_000_000]
    assert [sinks.size_name(x) for x in n] == _col(spark, n, sinks.size_category, "int")


def test_sidecars(spark):
    s = spark.createDataFrame([("a", 'T "x"', None, None, 61.0, "captions", None, None), ("b", None, "u", "c", None, None, "en", None)], "source_id string, title string, source string, channel string, duration_s double, method string, language string, ingested_at timestamp")
    c = spark.createDataFrame([("a", 2, 1.5, 2.0, "S", "zwei ü\n"), ("a", 1, 0.0, None, None, None), ("z", 1, 0.0, 1.0, "S", "x")], "source_id string, pos int, start_s double, end_s double, section string, text string")
    by = {}
    for r in sinks.sidecar(s, c).orderBy("source_id", "line_no").collect():
        by.setdefault(r.source_id, []).append(r.line)
    got = {k: json.loads("\n".join(v)) for k, v in by.items()}
    assert set(got) == {"a", "b"} and got["b"]["chunks"] == [] and got["b"]["title"] == "Untitled" and got["a"]["language"] == "und" and got["a"]["duration"] == "00:01:01"
    assert got["a"]["chunks"] == [{"start_s": 0.0, "section": "", "text": ""}, {"start_s": 1.5, "end_s": 2.0, "section": "S", "text": "zwei ü\n"}]
    assert sinks.sidecar(s.limit(0), c).count() == 0


def test_windows(spark):
    df = spark.createDataFrame([("a", 250.0), ("b", 120.0), ("c", 0.0), ("d", None), ("e", float("nan")), (None, 5.0)], "source_id string, duration_s double")
    assert sorted(tuple(r) for r in sections.windows(df).collect()) == [("a", 0, 0.0, 120.0), ("a", 1, 120.0, 240.0), ("a", 2, 240.0, 250.0), ("b", 0, 0.0, 120.0)]


def test_settled_tables_are_swept(spark):
    df = settle(spark.range(5), "sweepable")
    assert df.count() == 5 and swept(spark, ("sweepable",)) == 1 and swept(spark, ("sweepable",)) == 0

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewords.functions import exact
from tidewords.operators import filters
from tidewords.sinks import rows as sinks
from tidewords.sources import landed

CLIP = "id string, source_id string, audio_path string, text string, start_s double, end_s double, duration_s double, oversized boolean, speaker string"


def _clips(spark):
    return spark.createDataFrame([("a_0001", "a", "wavs/a_0001.wav", "one | two\nthree", 0.0, 1.0, 1.23456, False, "S 1"), ("a_0002", "a", "wavs/a_0002.wav", "zwei ü", 1.0, 2.0, 1.0, False, None)], CLIP)


def test_metadata_defaults(spark):
    raw = spark.createDataFrame([("v1", None, "", "up", None, None, "u", None, None, [(None, None, None), (5.0, "x", None)])], landed.METADATA)
    r = landed.metadata(raw).collect()[0]
    assert (r.title, r.channel, r.duration_s) == ("Untitled", "up", 0.0)
    assert [tuple(c) for c in r.chapters] == [(0.0, "Untitled", 0.0), (5.0, "x", 5.0)]
    with pytest.raises(Exception, match="without an id"):
        landed.metadata(raw.withColumn("id", F.lit(None).cast("string"))).collect()


def test_playlist_and_feed(spark, tmp_path):
    raw = spark.createDataFrame([("t", [("a", None, None), None, ("", "x", "y"), ("b", "B", "u")])], landed.PLAYLIST)
    assert [(r.video_id, r.title, r.url) for r in landed.playlist(raw).collect()] == [("a", "a", "https://video.example/watch?v=a"), ("b", "B", "u")]
    xml = '<rss xmlns:itunes="x"><channel><item><title>One</title><guid>g</guid><itunes:duration>1:02</itunes:duration><enclosure url="p.jpg" type="image/jpeg"/><enclosure url="a.mp3" type="audio/mpeg"/></item><item><link>l</link><enclosure url="v.mp4" type="video/mp4"/></item></channel></rss>'
    (tmp_path / "f.xml").write_text(xml)
    got = sorted(tuple(r) for r in landed.feed(spark, str(tmp_path / "f.xml")).collect())
    assert got == [("One", "a.mp3", 62.0, "g"), ("Untitled episode", "v.mp4", 0.0, "l")]


def test_tracks(spark):
    rows = [("a", 0, "en", True), ("a", 1, "en-GB", False), ("b", 0, "de", True), ("b", 1, "fr", False), ("c", 0, "english", True), ("c", 1, "en-x", True), ("d", 0, None, True)]
    df = spark.createDataFrame(rows, "source_id string, pos int, language_code string, is_generated boolean")
    got = {r.source_id: (r.language_code, r.is_generated) for r in landed.track_choice(df, F.lit("en")).collect()}
    assert got == {"a": ("en-GB", False), "b": ("fr", False), "c": ("en-x", True), "d": (None, True)}


def test_words_of_recognizers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("s", 0, " qo'shig", 1.0, 2.0, 1.5), ("s", 1, "'i.", nan, inf, nan), ("s", 2, None, 0.0, 0.0, 0.0), ("s", 3, "  ", 0.0, 0.0, 0.0), ("s", 4, " x", 3.0, None, None)]
    df = spark.createDataFrame(rows, "source_id string, pos int, word string, start double, end double, probability double")
    got = [tuple(r)[2:] for r in landed.whisper_words(df).orderBy("pos").collect()]
    assert got == [("qo'shig", 1.0, 2.0, 1.0, False), ("'i.", 0.0, 0.0, 1.0, True), ("x", 3.0, 3.0, 1.0, False)]
    tokens = spark.createDataFrame([("s", 0, "he", 0.0, 0.1, 0.5), ("s", 1, "llo", 0.1, 0.2, 0.5), ("s", 2, " you", 0.3, 0.4, 1.0)], "source_id string, pos bigint, tok string, start_s double, end_s double, confidence double")
    got = [(r.text, r.start_s, r.end_s, round(r.confidence, 6)) for r in landed.token_words(tokens, F.col("tok").startswith(" ") | (F.col("pos") == 0), F.col("tok")).orderBy("word_no").collect()]
    assert got == [("hello", 0.0, 0.2, 0.5), ("you", 0.3, 0.4, 1.0)]


def test_snippets(spark):
    df = spark.createDataFrame([("s", 0, " a&amp;b \n c", 1.0, None), ("s", 1, "[Music]", 2.0, 1.0), ("s", 2, "", 3.0, 1.0), ("s", 3, "(they did, twice)", 4.0, 0.5)], "source_id string, pos int, text string, start double, duration double")
    assert [(r.text, r.start_s, r.end_s) for r in landed.snippets(df).orderBy("pos").collect()] == [("a&b c", 1.0, 1.0), ("(they did, twice)", 4.0, 4.5)]


def test_index_round_trips(spark, tmp_path):
    clips = _clips(spark)
    lines = [r.line for r in sinks.ljspeech(clips).collect()]
    assert lines == ["a_0001|one two three|one two three", "a_0002|zwei ü|zwei ü"]
    m = [json.loads(r.line) for r in sinks.manifest(clips).collect()]
    assert m[0] == {"audio_filepath": "wavs/a_0001.wav", "duration": 1.235, "text": "one | two\nthree", "offset": 0.0, "speaker": "S 1"} and "speaker" not in m[1]
    for kind, name, df in (("manifest", "manifest.jsonl", sinks.manifest(clips)), ("audiofolder", "metadata.jsonl", sinks.audiofolder(clips)), ("ljspeech", "metadata.csv", sinks.ljspeech(clips))):
        sinks.write_lines(df, str(tmp_path / name))
        got = {r.id: r.text for r in landed.index_rows(spark, str(tmp_path), kind).collect()}
        assert set(got) == {"a_0001", "a_0002"} and got["a_0002"] == "zwei ü"
    sinks.write_by_speaker(clips, str(tmp_path / "by"))
    assert [p.name for p in (tmp_path / "by").iterdir() if p.is_dir()] == ["speaker_slug=S-1"]
    with pytest.raises(ValueError):
        landed.index_rows(spark, str(tmp_path), "other")


def test_markdown(spark):
    src = spark.createDataFrame([("a", 'T "q"\x01', "u", None, 61.0, "en", "captions", None)], "source_id string, title string, source string, channel string, duration_s double, language string, method string, ingested_at timestamp")
    ch = spark.createDataFrame([("a", 0, 0.0, 5.0, "Intro", "word " * 40), ("a", 1, 5.0, 9.0, "Intro", "x")], "source_id string, pos int, start_s double, end_s double, section string, text string")
    got = [r.line for r in sinks.markdown(src, ch).orderBy("line_no").collect()]
    assert got[0].startswith('---\ntitle: "T \\"q\\"\\x01"\nsource: "u"\nchannel: ""\nduration: "00:01:01"') and got[1] == "## Intro"
    assert got[2].startswith("**[00:00:00]** word") and max(map(len, got[2].split("\n"))) <= 80 and got[3] == "**[00:00:05]** x"
    assert "| duration | 3 |" in sinks.card("d", 5, 90.0, "en", "m", {"duration": 3})


def _wav(samples, rate=16_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_audio(spark):
    tone = (np.sin(np.arange(24_000) / 10) * 9000).astype(np.int16)
    soft = tone.copy()
    soft[:1600] = soft[-1600:] = 0
    files = spark.createDataFrame([("a", _wav(tone)), ("b", b"no wav"), ("c", _wav(tone, channels=2)), ("d", None)], "path string, content binary")
    got = {r.path: (r.channels, r.width, r.rate, r.actual_s) for r in landed.wav_info(files).collect()}
    assert got == {"a": (1, 2, 16_000, 1.5), "b": (None,) * 4, "c": (2, 2, 16_000, 0.75), "d": (None,) * 4}
    df = spark.createDataFrame([(1, (tone / 32768).tolist()), (2, (soft / 32768).tolist()), (3, [0.0] * 24_000), (4, [0.1] * 10), (5, None)], "i int, s array<double>")
    ratio = {r.i: r.e for r in df.select("i", exact.edge_ratio("s", F.lit(16_000)).alias("e")).collect()}
    assert ratio[1] > 0.9 and ratio[2] == 0.0 and ratio[3] is None and ratio[4] is None and ratio[5] is None
    full = spark.createDataFrame([([32767.0, -32768.0, 0.0, 1.0],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in full.select(filters.clipped_share(F.col("s"), 32767)).collect()] == [0.5, None, None]


def test_one_failure_stops_no_other(spark):
    def recognize(path):
        if path == "bad":
            raise RuntimeError("broken file")
        return [{"text": "hi", "start_s": 0.0}]

    got = {r.path: (r.text, r.error) for r in landed.recognized(spark.createDataFrame([("ok",), ("bad",)], "path string"), recognize, "text string, start_s double").collect()}
    assert got == {"ok": ("hi", None), "bad": (None, "broken file")}

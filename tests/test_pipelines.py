import json

import pytest
from pyspark.sql import functions as F

from tidewords.__main__ import main
from tidewords.plans import pipelines
from tidewords.session import read


def test_dataset(spark, data):
    words, sources, turns = (read(spark, data, t) for t in ("words", "sources", "turns"))
    clips, drops = pipelines.dataset(words, sources, turns, pipelines.DatasetConfig(speaker_mode="tag"))
    rows, lost = clips.collect(), drops.collect()
    assert len({r.id for r in rows}) == len(rows) > 0
    assert all(1.0 <= r.duration_s <= 15.0 and r.speaker and r.cut_start_ms <= r.start_s * 1000 + 1e-6 for r in rows)
    assert {r["filter"] for r in lost} <= {"empty_text", "duration", "internal_silence", "non_target_script", "char_rate", "compression_ratio", "confidence", "no_speaker", "cross_speaker"}
    with pytest.raises(ValueError):
        pipelines.DatasetConfig(least_s=5, most_s=1)
    for bad in ({"speaker_mode": "all"}, {"least_purity": 1.5}):
        with pytest.raises(ValueError):
            pipelines.DatasetConfig(**bad)


def test_verification(spark):
    clips = spark.createDataFrame([("a1", "a", "w/a1", "hello there"), ("a2", "a", "w/a2", "good day"), ("b1", "b", "w/b1", "привет"), ("b1", "b", "w/b1", "")], "id string, source_id string, audio_path string, text string")
    files = spark.createDataFrame([("w/a1", 1.0), ("w/a2", 1.0)], "path string, actual_s double")
    sources = spark.createDataFrame([("a", "en"), ("b", "en")], "source_id string, language string")
    heard = clips.selectExpr("id", "text as heard").where("source_id = 'a'")
    got = {r.source_id: (r.verdict, r.reasons) for r in pipelines.verification(clips, files, sources, heard).collect()}
    assert got == {"a": ("trainable", []), "b": ("not trainable", ["structure", "script"])}
    got = {r.source_id: r.verdict for r in pipelines.verification(clips, files, sources).collect()}
    assert got["a"] == "marginal"


def test_verification_measures_the_files(spark):
    names = ["fine", "off", "hot", "some", "spare", "stereo"]
    clips = spark.createDataFrame([(f"{s}_{i:04}", s, f"wavs/{s}_{i:04}.wav", "hello there", 2.0) for s in names for i in range(4)], "id string, source_id string, audio_path string, text string, duration_s double")
    rows = [(f"wavs/{s}_{i:04}.wav", 2.06 if s == "off" else 2.04, 2 if (s, i) == ("stereo", 0) else 1, 2, 16_000) for s in names for i in range(4)]
    rows += [("wavs/spare_0009.wav", 1.0, 1, 2, 16_000), ("wavs/gone_0001.wav", 1.0, 1, 2, 16_000), ("wavs/notes.wav", None, None, None, None)]
    shape = "path string, actual_s double, channels int, width int, rate int"
    files = spark.createDataFrame(rows, shape)
    sources = spark.createDataFrame([(s, "en") for s in [*names, "gone"]], "source_id string, language string")
    edges = spark.createDataFrame([(r[0], 0.9 if "hot" in r[0] or "some_0000" in r[0] else float("nan") if "fine_0000" in r[0] else 0.1) for r in rows], "path string, edge_ratio double")
    heard = clips.selectExpr("id", "text as heard").union(spark.createDataFrame([("x", "x")], "id string, heard string"))
    verdicts = lambda files, **more: {r.source_id: (r.verdict, [x for x in r.reasons if x not in ("pairing", "unmeasured")]) for r in pipelines.verification(clips, files, sources, **more).collect()}
    got = verdicts(files, edges=edges)
    assert got == {"fine": ("marginal", []), "off": ("not trainable", ["structure"]), "hot": ("not trainable", ["edges"]), "some": ("marginal", ["some_edges"]), "spare": ("marginal", ["tidy"]), "gone": ("marginal", ["tidy"]), "stereo": ("not trainable", ["structure"])}
    # all texts are alike, so pairing has no gap; without edges none are hot
    assert verdicts(files, heard=heard)["hot"] == ("not trainable", []) and verdicts(files)["hot"] == ("marginal", [])
    assert verdicts(spark.createDataFrame([*rows[1:], (*rows[0][:4], 8_000)], shape))["fine"] == ("not trainable", ["structure"])
    lines = clips.selectExpr("concat_ws('|', id, text, text) as line")
    assert verdicts(files, lines=lines)["fine"] == ("marginal", [])
    for bad in ("one|two", "fine_0001|hello|goodbye"):
        assert verdicts(files, lines=lines.union(spark.createDataFrame([(bad,)], "line string")))["fine"] == ("marginal", ["tidy"])


def test_verify_reads_the_audio(spark, tmp_path):
    import wave

    import numpy as np

    tone = (np.sin(np.arange(24_000) * 220 * 2 * np.pi / 16_000) * 9_000).astype(np.int16)
    soft = tone.copy()
    soft[:1_600] = soft[-1_600:] = 0
    (tmp_path / "wavs").mkdir()
    for name, x in (("a_0001", soft), ("b_0001", np.concatenate([soft[:8_000], soft[-8_000:]])), ("c_0001", tone), ("a b_0001", soft)):
        with wave.open(str(tmp_path / "wavs" / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16_000)
            w.writeframes(x.tobytes())
    names = ["a", "b", "c", "d", "a b"]
    spark.createDataFrame([(f"{s}_0001", s, f"wavs/{s}_0001.wav", "hello there", 1.5) for s in names], "id string, source_id string, audio_path string, text string, duration_s double").write.parquet(str(tmp_path / "clips.parquet"))
    spark.createDataFrame([(s, "en") for s in names], "source_id string, language string").write.parquet(str(tmp_path / "sources.parquet"))
    assert main(["verify", str(tmp_path), str(tmp_path / "report")]) == 2
    rows = {r.source_id: r for r in spark.read.parquet(str(tmp_path / "report")).collect()}
    assert {s: r.reasons for s, r in rows.items()} == {"a": ["unmeasured"], "a b": ["unmeasured"], "b": ["structure", "unmeasured"], "c": ["edges", "unmeasured"], "d": ["structure", "unmeasured"]}
    assert (rows["b"].off, rows["d"].missing, rows["a"].malformed) == (1, 1, None)
    (tmp_path / "metadata.csv").write_text("a_0001|hello there\n")
    main(["verify", str(tmp_path), str(tmp_path / "report")])
    assert {r.malformed for r in spark.read.parquet(str(tmp_path / "report")).collect()} == {1}


def _wav(path, x, rate=16_000):
    import wave

    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(x.tobytes())


def _tone(seconds):
    import numpy as np

    x = (np.sin(np.arange(int(16_000 * seconds)) * 220 * 2 * np.pi / 16_000) * 9_000).astype(np.int16)
    x[:1_600] = x[-1_600:] = 0
    return x


def test_command_line(spark, data, tmp_path):
    assert main(["transcripts", data, str(tmp_path / "md"), "--json"]) == 0
    names = sorted(p.name for p in (tmp_path / "md").iterdir() if p.suffix == ".md")
    assert len(names) == read(spark, data, "sources").select("source_id").distinct().count()
    assert (tmp_path / "md" / names[0]).read_text().startswith("---\ntitle: ")
    for name in names:
        got = json.loads((tmp_path / "md" / name.replace(".md", ".json")).read_text())
        assert list(got) == ["title", "source", "channel", "duration", "ingested", "method", "language", "chunks"]
        assert all(set(c) <= {"start_s", "end_s", "section", "text"} for c in got["chunks"])
    assert sum(len(json.loads((tmp_path / "md" / n.replace(".md", ".json")).read_text())["chunks"]) for n in names) > 10


def test_dataset_is_built_resumed_and_verified(spark, data, tmp_path):
    out = tmp_path / "ds"
    args = ["dataset", data, str(out), "--language", "en", "--format", "jsonl", "--format", "ljspeech"]
    assert main(args) in (0, 1)
    lines = [json.loads(r.value) for r in spark.read.text(str(out / "manifest.jsonl")).collect()]
    assert lines and set(lines[0]) == {"audio_filepath", "duration", "text", "offset"}
    drops = [json.loads(r.value) for r in spark.read.text(str(out / "dropped.jsonl")).collect()]
    assert drops and set(drops[0]) == {"clip", "filter", "value", "threshold", "text"}
    card = (out / "dataset_card.md").read_text()
    assert "language:\n- \"en\"" in card and f"{len(lines)} clips" in card
    builds = len(list((out / "clips").glob("build=*")))
    good = spark.read.parquet(str(out / "state")).where("ok").count()
    main(args)  # what went well is taken over, only failed sources are tried again
    assert spark.read.parquet(str(out / "state")).where("ok").count() == good
    assert len(list((out / "clips").glob("build=*"))) == builds + 1
    assert sorted(r.value for r in spark.read.text(str(out / "manifest.jsonl")).collect()) == sorted(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in lines)
    # the dataset's own audio, then a deleted file
    (out / "wavs").mkdir()
    for x in lines:
        _wav(out / x["audio_filepath"], _tone(x["duration"]))
    assert main(["verify", str(out), str(out)]) == 1
    v = json.loads((out / "verification.json").read_text())
    assert v["verdict"] == "marginal" and v["clips"] == len(lines) and v["language"] == "en" and all(c["ok"] for c in v["checks"])
    assert [c["check"] for c in v["checks"]] == ["audio present", "ids unique", "texts whole", "audio format", "durations", "no orphans", "index agrees"]
    (out / lines[0]["audio_filepath"]).unlink()
    _wav(out / "wavs" / "spare_0001.wav", _tone(1.0))
    assert main(["verify", str(out), str(out)]) == 2
    v = json.loads((out / "verification.json").read_text())
    assert {c["check"] for c in v["checks"] if not c["ok"]} == {"audio present", "no orphans"}
    md = (out / "verification.md").read_text()
    assert md.startswith("# Verification: not trainable") and "Broken: audio present fails for 1 of" in md and "Untidy: no orphans fails for 1, such as" in md
    assert main(["verify", str(tmp_path), str(tmp_path)]) == 3  # no index


def test_folder_with_pairing(spark, tmp_path):
    (tmp_path / "wavs").mkdir()
    said = ["the quick fox", "a lazy dog sleeps", "jumping over hills", "seven bright stars"]
    for i, t in enumerate(said):
        _wav(tmp_path / "wavs" / f"a_{i:04}.wav", _tone(1.5))
    (tmp_path / "metadata.csv").write_text("".join(f"a_{i:04}|{t}|{t}\n" for i, t in enumerate(said)))
    heard = spark.createDataFrame([(f"a_{i:04}", t.upper() + "!") for i, t in enumerate(said)], "id string, heard string")
    v, checks, reasons, pairs = pipelines.verify_folder(spark, str(tmp_path), heard, language="en")
    assert v["verdict"] == "trainable" and v["pairing_mean"] == 1.0 and reasons == [] and len(pairs) == 4 and v["index"] == "ljspeech"
    assert [c["check"] for c in checks] == ["audio present", "ids unique", "texts whole", "audio format", "no orphans"]
    texts = dict(zip([f"a_{i:04}" for i in range(4)], said, strict=True))

    def recognize(path):
        name = path.rsplit("/", 1)[-1][:-4]
        if name == "a_0003":
            raise OSError("no sound")
        return [{"text": w} for w in texts[name].split()]

    again = {r.id: (r.heard, r.error) for r in pipelines.heard_again(pipelines.landed.index_rows(spark, str(tmp_path), "ljspeech"), str(tmp_path), recognize).collect()}
    assert again == {i: (t, None) if i != "a_0003" else (None, "no sound") for i, t in texts.items()}
    v, _, _, pairs = pipelines.verify_folder(spark, str(tmp_path), recognize=recognize, language="en")
    assert v["verdict"] == "trainable" and len(pairs) == 3
    wrong = heard.withColumn("heard", F.concat(F.lit("zz "), "id"))
    v, _, reasons, _ = pipelines.verify_folder(spark, str(tmp_path), wrong, language="en")
    assert v["verdict"] == "not trainable" and "don't belong together" in reasons[0]


def test_advice_clamping_and_words(spark):
    s = spark.createDataFrame([("a", "uz", "small", 16_000), ("b", "uz-Latn", "me/uz", 44_100), ("c", "en", "tiny", None), ("d", None, None, 0)], "source_id string, language string, model string, rate int")
    got = {r.source_id: r.advice for r in pipelines.advice(s).collect()}
    assert got == {"a": ["low_resource", "upsampled"], "b": [], "c": ["small_model"], "d": []}
    assert pipelines.advice(s, formats=("hf", "ljspeech")).where("array_contains(advice, 'formats')").count() == 4
    c = spark.createDataFrame([(0, 900, 1_000), (900, 1_200, 1_000), (1_000, 1_100, 1_000), (5, 9, None), (5, 9, 0)], "start_ms bigint, end_ms bigint, m bigint")
    assert sorted((r.start_ms, r.end_ms) for r in pipelines.clamped(c, "m").collect()) == [(0, 900), (5, 9), (5, 9), (900, 1_000)]
    words = spark.createDataFrame([("a", "x"), ("b", None)], "source_id string, text string")
    assert sorted(r[0] for r in pipelines.wordless(s, words).collect()) == ["b", "c", "d"]

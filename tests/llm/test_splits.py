import random

import pytest
from pyspark.sql import functions as F

from tidewords.llm import splits

CLIP = "id string, source_id string, speaker string, split string, root string"
SRC = "source_id string, video_id string, source string"


def _tables(spark, clips, sources):
    return spark.createDataFrame([(*c, "clash", "clash") for c in clips], CLIP), spark.createDataFrame(sources, SRC)


def _model(clips, sources):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for _, s, p in clips:
        if s:
            find(s)
            if p:
                up[find(s)] = find("p:" + p.lower())
    for s, v, _ in sources:
        find(s)
        if v:
            up[find(s)] = find("v:" + v)
    names = [x for x in up if x[:2] not in ("p:", "v:")]
    return {(a, b) for a in names for b in names if a < b and find(a) == find(b)}


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    for n, people in ((40, 60), (60, 25), (25, 200)):
        clips = [(f"c{i}", f"s{rng.randrange(n):03}", f"Nam{rng.randrange(people)} Ex") for i in range(n * 2)]
        # a hot person holds a third of the sources, and a long chain hangs together link by link
        clips += [(f"h{i}", f"s{i:03}", "Hot One") for i in range(n // 3)]
        clips += [(f"l{i}{e}", f"z{i + e:03}", f"Link{i} Q") for i in range(30) for e in (0, 1)]
        clips += [("n1", "s001", None), ("n2", "s002", "Host"), ("n3", None, "Hot One"), ("n4", "s003", "SPEAKER_00"), ("n5", "s004", "SPEAKER_00")]
        sources = [(f"s{i:03}", rng.choice([None, f"v{i // 2}", f"u{i}"]), None) for i in range(n)] + [("s000", None, None)]
        c, s = _tables(spark, clips, sources)
        got = {tuple(r) for r in splits.together(splits.components(c, s)).collect()}
        want = _model([x for x in clips if x[2] not in ("Host", "SPEAKER_00")], sources)
        assert got == want


def test_forest_spans(spark):
    clips = [(f"l{i}{e}", f"z{i + e:03}", f"Link{i} Q") for i in range(20) for e in (0, 1)]
    c, s = _tables(spark, clips, [])
    labels, tree = splits.forest(splits.edges(splits.ties(c, s)), c.select("source_id").withColumnRenamed("source_id", "vertex").distinct())
    assert tree.distinct().count() == 20 and labels.select("root").distinct().count() == 1


def test_video_ids(spark):
    rows = [("a", "AAAAAAAAAAA", "x"), ("b", "", "https://video.example/watch?v=AAAAAAAAAAA&t=4"), ("c", None, "https://short.example/AAAAAAAAAAA"), ("d", "aAAAAAAAAAA", None), ("e", " ", "https://video.example/about"), ("e", " ", None)]
    got = dict(spark.createDataFrame(rows, SRC).select("source_id", splits.video_key(F.col("video_id"), F.col("source"))).collect())
    assert got == {"a": "AAAAAAAAAAA", "b": "AAAAAAAAAAA", "c": "AAAAAAAAAAA", "d": "aAAAAAAAAAA", "e": None}


def test_splits_keep_components_and_shares(spark):
    clips = [(f"c{i}", f"s{i // 3:04}", f"P{i // 9} Q") for i in range(3000)] + [("x", None, None)]
    clips += clips[:5]
    c, s = _tables(spark, clips, [])
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = {r.id: r.split for r in splits.dealt(splits.components(c, s), c, plan).collect()}
    assert len(got) == 3001
    by = {}
    for i in range(3000):
        by.setdefault(i // 9, set()).add(got[f"c{i}"])
    assert all(len(v) == 1 for v in by.values())
    share = sum(v == "train" for v in got.values()) / len(got)
    assert abs(share - 0.8) < 0.004


def _dealt(spark, sizes, plan):
    clips = [(f"c{k}_{i}", f"s{k:05}", None) for k, n in enumerate(sizes) for i in range(n)]
    c, s = _tables(spark, clips, [])
    out = splits.dealt(splits.components(c, s), c, spark.createDataFrame(plan, "split string, share double, id string"))
    return {r.split: r.share for r in splits.shares(out).collect()}, out.count() == len(clips)


def test_shares_are_of_clips(spark, monkeypatch):
    rng = random.Random(1)
    plan = [("train", 0.8, "x"), ("validation", 0.1, "x"), ("test", 0.1, "x"), ("none", 0.0, "x"), (None, 0.5, "x"), ("nan", float("nan"), "x"), ("null", None, "x")]
    for large in (4096, 400):  # all components dealt one by one, and small ones along the line
        monkeypatch.setattr(splits, "LARGE", large)
        for sizes in ([300, 200, 100, 60, 40] + [rng.choice((1, 2, 3, 5, 8)) for _ in range(900)], [1] * 1000, [7] * 200):
            got, whole = _dealt(spark, sizes, plan)
            assert whole and set(got) == {"train", "validation", "test"}
            assert abs(got["train"] - 0.8) < 0.01 and abs(got["validation"] - 0.1) < 0.01


def test_plans_of_many_splits(spark):
    got, whole = _dealt(spark, [1] * 1500, [(f"fold{i}", 1.0, "x") for i in range(150)])
    assert whole and len(got) == 150 and max(got.values()) < 0.012
    with pytest.raises(ValueError):
        _dealt(spark, [1], [("train", None, "x")])


def test_pairs_of_large_components(spark, monkeypatch):
    labels = spark.createDataFrame([(f"v{i:03}", "r") for i in range(90)] + [("w1", "q"), ("w2", "q"), ("u", "u")], "vertex string, root string")
    monkeypatch.setattr(splits, "SALT", 7)
    got = [tuple(r) for r in splits.together(labels).collect()]
    assert len(got) == len(set(got)) == 90 * 89 // 2 + 1 and all(a < b for a, b in got)


def test_forest_is_persisted_by_name(spark, tmp_path):
    clips = [(f"l{i}{e}", f"z{i + e:03}", f"Link{i} Q") for i in range(20) for e in (0, 1)]
    c, s = _tables(spark, clips, [("lone", None, None)])
    for _ in range(2):  # over what is there
        splits.persist(*splits.grown(c, s), f"file://{tmp_path}")
    members, tree = (spark.read.parquet(f"file://{tmp_path}/{x}") for x in ("membership", "forest"))
    assert (members.count(), members.select("root").distinct().count(), tree.count()) == (22, 2, 20)


def test_empty_tables(spark):
    c, s = _tables(spark, [], [])
    assert splits.components(c, s).count() == 0
    assert splits.dealt(splits.components(c, s), c, spark.createDataFrame([("train", 1.0)], "split string, share double")).count() == 0

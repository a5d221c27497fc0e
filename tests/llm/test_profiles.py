import random

import numpy as np
import pandas as pd
import pytest

from tidewords.llm import language, level, profiles, repetition
from tidewords.llm.tokens import Tokens, word_form

D = "/root/testdata/sf0.001"


def _samples():
    ls, lv = pd.read_parquet(f"{D}/lang_samples.parquet"), pd.read_parquet(f"{D}/level_samples.parquet")
    return list(zip(ls.lang, ls.text, strict=True)) + [("en", t) for t in lv.text], list(zip(lv.level.tolist(), lv.text, strict=True))


@pytest.fixture(scope="module")
def held_out():
    s, lv = _samples()
    return language.fit([x for i, x in enumerate(s) if i % 4]), [x for i, x in enumerate(s) if i % 4 == 0], level.fit([x for i, x in enumerate(lv) if i % 4]), [x for i, x in enumerate(lv) if i % 4 == 0]


def _decode(model, texts):
    t = Tokens(score=model.scores, ends=language.ends_sentence)
    rows, lens = t.encode(texts)
    return language.decode(model, t.column("score"), t.column("ends"), rows, lens), lens


def test_languages_of_held_out_words(held_out):
    model, rest, *_ = held_out
    (mark, sure), lens = _decode(model, [t for _, t in rest])
    gold = np.repeat([model.langs.index(x) for x, _ in rest], lens)
    assert (mark == gold).mean() > 0.98
    assert sure.min() > 0.0 and sure.max() <= 1.0001


def test_mixed_texts_are_parted(held_out):
    model, rest, *_ = held_out
    by = {}
    for x, t in rest:
        by.setdefault(x, t)
    a, b = by["de"], by["it"]
    (mark, _), _ = _decode(model, [f"{a} {b} {a}"])
    gold = [model.langs.index(x) for x, t in (("de", a), ("it", b), ("de", a)) for _ in t.split()]
    assert (mark == gold).mean() > 0.95


def test_chunks_change_nothing(held_out, monkeypatch):
    model, rest, *_ = held_out
    rng = random.Random(4)
    words = [w for _, t in rest for w in t.split()]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 0, 159, 160, 161, 320, 2_000)] + [" ".join(t for _, t in rest[:12]), "12 " * 700, "xq " * 321]
    (whole, sure), _ = _decode(model, texts)
    monkeypatch.setattr(language, "CHUNK", 3)
    (small, sure_small), _ = _decode(model, texts)
    monkeypatch.setattr(language, "CHUNK", 10_000)
    (one, sure_one), _ = _decode(model, texts)
    assert np.abs(sure - sure_one).max() < 1e-5 and np.abs(sure_small - sure_one).max() < 1e-5
    assert (whole == one)[sure_one > 0.5001].all() and (small == one)[sure_one > 0.5001].all()


def test_languages_are_those_of_the_samples():
    model = language.fit([("aa", "kilo mepa rosu tavi."), ("bb", "wyx qzor ghaj brrt.")] * 5, sequences=40, rounds=20)
    assert model.langs == ("aa", "bb")
    (mark, _), _ = _decode(model, ["kilo rosu", "brrt wyx"])
    assert mark.tolist() == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        language.fit([("aa", " ")])


def test_levels_of_held_out_texts(held_out):
    *_, model, rest = held_out
    t = Tokens(ends=language.ends_sentence, **model.columns())
    rows, lens = t.encode([x for _, x in rest])
    by = level.levels(model, t.column("shape")[rows], t.column("ends")[rows], t.column("form")[rows], np.zeros(len(rows), bool), lens)
    assert (np.array(model.levels)[by.argmax(1)] == [x for x, _ in rest]).mean() > 0.95


@pytest.mark.parametrize(("label", "code"), [(None, None), ("", None), ("und", None), ("unknown", None), ("EN", "en"), ("en_GB", "en"), ("pt-BR", "pt"), ("German", "de"), ("rus", "ru"), ("es-419", "es"), ("xq", "xq")])
def test_labels(label, code):
    assert language.label_code(label) == code


def _share(text):
    w = [f for t in text.split() if (f := word_form(t))]
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        if g in seen:
            hit[i : i + 5] = [True] * 5
        seen.add(g)
    return len(w), sum(hit)


@pytest.fixture(scope="module")
def field():
    return repetition.fit([t for _, t in _samples()[0]])


def _measure(field, texts):
    t = Tokens(**repetition.columns())
    rows, lens = t.encode(texts)
    return repetition.measure(field, t.column("form")[rows], t.column("ends")[rows], t.column("points")[rows], lens)


def test_repetition_equals_brute_force(field):
    rng = random.Random(3)
    texts = ["", "a b c", "go " * 30, "Go, go! [00:12] GO go? go. go go go go go"]
    for _ in range(300):
        loop = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        words = [str(rng.randrange(10_000)) for _ in range(rng.randint(0, 60))] + loop * rng.randint(0, 12)
        if rng.random() < 0.5:
            rng.shuffle(words)
        texts.append(" ".join(w + rng.choice(("", "", "", ".")) for w in words))
    words, again, boiler = _measure(field, texts)
    want = [_share(x) for x in texts]
    assert [(int(a), int(b)) for a, b, c in zip(words, again, boiler, strict=True) if c > 0] == [w for w, c in zip(want, boiler, strict=True) if c > 0]
    # the field's labels lose no record that reaches the limit
    found = repetition.repetitive(words, again, boiler)
    assert found.tolist() == [n >= 10 and 2 * k >= n for n, k in want]


def test_phrases_said_twice(field):
    """All phrases of 5 to 60 words, with and without points, said twice; texts of half repeated words in any mixture."""
    texts = [" ".join([f"w{i}" + "." * (i % d == d - 1) for i in range(n)] * 2) for n in range(5, 61) for d in (1, 3, 7, 99)]
    assert repetition.repetitive(*_measure(field, texts)).all()
    rng = np.random.default_rng(3)
    texts = ["one two three four five six one two three four five six"]
    for _ in range(3_000):
        size = int(rng.integers(5, 60))
        text = list(range(size))
        while len(text) < 2 * size:
            a, k = int(rng.integers(0, size - 4)), int(rng.integers(5, 9))
            at = int(rng.integers(size // 2, len(text) + 1))
            text[at:at] = text[a : a + k]
        texts.append(" ".join(f"w{i}" + "." * int(rng.integers(0, 9) == 0) for i in text))
    words, again, boiler = _measure(field, texts)
    want = np.array([_share(t)[1] for t in texts])
    assert (repetition.repetitive(words, again, boiler) == (2 * want >= words)).all() and 100 < (2 * want >= words).sum()


def test_sure_lines_count_as_boilerplate(field):
    assert field.shortfall() < 1e-9 and field.trans.shape == (2, 2)
    assert repetition.fit([]).shortfall() < 1e-9  # without samples, words are made up


def test_content_share_of_held_out_texts():
    s = [t for _, t in _samples()[0]]
    field = repetition.fit([t for i, t in enumerate(s) if i % 4])
    made = repetition._planted([t for i, t in enumerate(s) if i % 4 == 0], 300, random.Random(9))
    *_, boiler = _measure(field, [" ".join(w) for w, _ in made])
    planted = np.array([np.mean(f) for _, f in made])
    assert np.abs(boiler - planted).mean() < 0.08
    assert (repetition.retained(boiler) == (planted < 0.5))[np.abs(planted - 0.5) > 0.1].mean() > 0.97


def test_rows_of_every_kind(spark):
    s, lv = _samples()
    lang, grade, field = language.fit(s), level.fit(lv), repetition.fit([t for _, t in s])
    rows = [(1, None, None), (2, "", "en"), (3, "  \n ", "en"), (4, lv[0][1], "de"), (4, lv[0][1], "de"), (5, "kite " * 60_000, "und")]
    df = spark.createDataFrame([(*r, 7, 8.0) for r in rows], "doc_id int, text string, lang string, key int, t double")
    got = profiles.profiled(df, ["doc_id", "key", "t"], lang=lang, grade=grade, repeats=field, label="lang", stretches=True).orderBy("doc_id").collect()
    assert [r.words for r in got] == [0, 0, 0, *[len(lv[0][1].split())] * 2, 60_000]
    assert [r.repetitive for r in got] == [False] * 5 + [True]
    assert [r.code for r in got] == [None, "en", "en", "de", "de", None]
    assert got[0].stretches == [] and got[3].stretches[0].lang == "en" and sum(x.size for x in got[3].stretches) == got[3].words
    assert sum(got[0].langs) == 0 and got[3].langs[lang.langs.index("en")] > 0
    assert profiles.profiled(df.limit(0), ["doc_id"], lang=lang).count() == 0


def test_samples_past_the_bound_leave_out_no_label(spark, monkeypatch):
    got = []
    monkeypatch.setattr(language, "fit", got.append)
    monkeypatch.setattr(level, "fit", got.append)
    many = spark.range(2_500).selectExpr("'de' as lang", "concat('a', id) as text", "1 as level")
    few = spark.createDataFrame([("uk", "b", 5), ("uk", "c", 5), (None, "d", None), ("uk", None, 5)], "lang string, text string, level int")
    profiles.language_model(many.unionByName(few), few.select("text"))
    assert len(got[0]) == language.MOST_SAMPLES + 3 and got[0][1_998:] == [("uk", "b"), ("uk", "c"), ("en", "b"), ("en", "c"), ("en", "d")]
    monkeypatch.setattr(level, "MOST_SAMPLES", 100)
    profiles.level_model(many.unionByName(few))
    assert len(got[1]) == 100 and got[1][98:] == [(5, "b"), (5, "c")]
    # under the bound all rows come, in order
    profiles.language_model(few)
    assert got[2] == [("uk", "b"), ("uk", "c")]
    monkeypatch.undo()
    de, uk = [("de", f"Ein ganz gewöhnlicher Satz Nummer {i}.") for i in range(2_100)], [("uk", "Це звичайне речення про погоду.")] * 20
    model = language.fit(de + uk, sequences=40, rounds=10)
    (mark, _), _ = _decode(model, [uk[0][1]])
    assert (mark == model.langs.index("uk")).all()

import random

import numpy as np

from tidewords.llm import leakage
from tidewords.llm.tokens import Tokens


def _item(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def _damage(rng, words, every):
    out = []
    for i, w in enumerate(words):
        if every and i % every == every - 1:
            if rng.random() < 0.5:
                out.append("zz" + w[::-1])
        else:
            out.append(w.upper() + rng.choice(["", ",", "!"]))
        if rng.random() < 0.1:
            out.append(rng.choice(["um,", "uh", "[00:12]", "hmm..."]))
    return out


def _search(items, texts):
    return set(leakage.search(leakage.Index(items), Tokens(), texts))


def test_planted_passages():
    rng = random.Random(6)
    items = [(i, _item(rng, rng.randint(40, 90))) for i in range(60)]
    filler = [_item(rng, 200) for _ in range(200)]
    texts, want = [], set()
    for k in range(200):
        i = rng.randrange(60)
        words = items[i][1].split()
        n = rng.choice([8, 12, 15, 24, 30, 40])
        a = rng.randrange(len(words) - n + 1)
        f = filler[k].split()
        at = rng.randrange(len(f))
        texts.append(" ".join(f[:at] + _damage(rng, words[a : a + n], rng.choice([0, 0, 8, 10])) + f[at:]))
        if n >= 24:
            want.add((k, i))
    assert _search(items, texts) == want


def test_exact_length():
    rng = random.Random(1)
    words = _item(rng, 60).split()
    item = [(7, " ".join(words))]
    frame = lambda w: f"{_item(rng, 30)} {' '.join(w)} {_item(rng, 30)}"
    assert _search(item, [frame(words[10:30]), frame(words[10:29]), frame(words[:20]), frame(words[40:])]) == {(0, 7), (2, 7), (3, 7)}


def test_passage_off_the_first_diagonal_of_its_band():
    # a chance q-gram before the passage, 18 words off its diagonal but in its band, begins the best stretch
    rng = random.Random(2)
    short = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    chance, passage, long = ["klmn", "opqr"], short(20), ["".join(rng.choice("stuvwx") for _ in range(30)) for _ in range(3)]
    item = [(7, " ".join([*chance, *passage, *long, *short(10)]))]
    for ahead in range(30):  # bands begin anywhere
        text = lambda words: " ".join([*short(ahead), *chance, *short(18), *words, *short(30)])  # noqa: E731, B023
        assert _search(item, [text(passage), text(passage[:16])]) == {(0, 7)}
        # of two places in the text with the same q-grams the later holds the passage
        assert _search(item, [" ".join([*short(ahead), *passage[:6], *short(12), *passage, *short(30)])]) == {(0, 7)}


def test_longest():
    f = lambda s: leakage.longest(np.array([c == "x" for c in s]))
    assert f("x" * 20) == 20 and f("xxxxxxxxx.xxxxxxxxxx") == 20 and f("xxx.xxx.xxx.xxx") < 12 and f("...") == 0 and f("") == 0


def test_rows_of_every_kind(spark):
    rng = random.Random(5)
    item = _item(rng, 30)
    docs = [(1, f"so {item} end"), (2, None), (3, ""), (4, f"x {item}"), (4, f"x {item}"), (5, _item(rng, 100_000) + " " + item)]
    d = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(1, item, 1), (1, item, 1), (2, "too short", 2), (3, None, 3), (None, item, 4)], "item_id long, text string, doc_id int")
    assert sorted(map(tuple, leakage.leaks(d, i).collect())) == [(1, 1), (4, 1), (5, 1)]
    assert leakage.leaks(d, i.limit(0)).count() == 0 and leakage.leaks(d.limit(0), i).count() == 0


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    items = [(k, _item(rng, 30)) for k in range(9)]
    d = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK", 2)
    assert _rows(leakage.leaks(d, i)) == [(k, k) for k in range(9)]
    monkeypatch.setattr(leakage, "CACHE", 1)  # the blocks pass one by one
    assert _rows(leakage.leaks(d, i)) == [(k, k) for k in range(9)]
    ids = i.selectExpr("concat('i', item_id) as item_id", "text")
    assert _rows(leakage.leaks(d, ids)) == [(k, f"i{k}") for k in range(9)]


def test_many_items_read_the_documents_once(spark):
    rng = random.Random(3)
    items = [(k, _item(rng, 24)) for k in range(20_000)]
    d = spark.createDataFrame([(k, f"so {items[k][1]} it goes") for k in range(0, 20_000, 400)] + [(-1, _item(rng, 500))], "doc_id long, text string")
    got = leakage.leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert _rows(got) == [(k, k) for k in range(0, 20_000, 400)]


def test_items_of_short_words():
    """The q-gram bound of such items is nothing, so they are found by words."""
    rng = random.Random(12)
    item = " ".join(rng.choice("abcdefghij") for _ in range(40))
    index = leakage.Index([(1, item), (2, _item(rng, 40))])
    assert index.bound[0] <= leakage.FEW < index.bound[1] and len(index.runs)
    words = item.split()
    other = [rng.choice("klmnopqrst") for _ in range(60)]
    changed = [*words[5:11], "zz", *words[12:18], "yy", "y", *words[19:25], *words[26:32]]
    texts = [" ".join([*other, *words[5:27], *other]), " ".join([*other, *words[5:22], *other]), " ".join([*other, *changed, *other]), item, " ".join(other), None]
    assert _search([(1, item), (2, _item(rng, 40))], texts) == {(0, 1), (2, 1), (3, 1)}


def test_other_rules():
    rng = random.Random(4)
    item = _item(rng, 50)
    text = f"{_item(rng, 30)} {' '.join(item.split()[3:14])} {_item(rng, 30)}"
    short = leakage.Rules(least=10, errors=0.1)
    assert _search([(1, item)], [text]) == set()
    assert leakage.search(leakage.Index([(1, item)], short), Tokens(), [text]) == [(0, 1)]
    assert (short.changed, leakage.Rules().changed, leakage.Rules().room, leakage.Rules().run) == (1, 3, 12, 3)

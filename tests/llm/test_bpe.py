import random

import pytest
from tokenizers import Tokenizer

from tidewords.llm import bpe

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
TEXTS = ["", " ", "a", "it's  don't\n\n x \t y　z a\x85b  ", "<|endoftext|> we'll I'D  'S", "\U0001f3f4‍☠️ ñ ½ Ⅳ 12٣ _a_b", "aaa aaaa aaaaa", "\x1c x\x1f", "привет, κόσμε!", "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    rng = random.Random(2)
    alphabet = "abc \n\t'.,!1éж中\U0001f600 ​\x1c"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    e = bpe.Encoder(bpe.Merges(PATH))
    ids, ends = e.encode(texts)
    at = 0
    for text, end in zip(texts, ends, strict=True):
        assert ids[at:end].tolist() == library(text), ascii(text)[:80]
        at = end


def test_rows_of_every_kind(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(98, None), (0, "")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, ids int")
    got = bpe.encoded(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    assert all(r.ids == library(want[r.doc_id] or "") for r in got)
    assert bpe.encoded(df.limit(0), ["doc_id"]).count() == 0


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST", 3)
    e = bpe.Encoder(bpe.Merges(PATH))
    for t in TEXTS[:9]:
        assert e.encode([t])[0].tolist() == library(t)

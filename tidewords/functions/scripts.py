"""Scripts of letters and languages, as columns."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidewords.functions.text import strip

# Code point ranges of the scripts told apart, and languages by script.
RANGES = {
    "latin": "41-5a 61-7a c0-24f 1e00-1eff", "greek": "370-3ff", "cyrillic": "400-4ff", "hebrew": "590-5ff", "arabic": "600-6ff",
    "devanagari": "900-97f", "bengali": "980-9ff", "gurmukhi": "a00-a7f", "gujarati": "a80-aff", "tamil": "b80-bff", "telugu": "c00-c7f",
    "kannada": "c80-cff", "malayalam": "d00-d7f", "sinhala": "d80-dff", "thai": "e00-e7f", "lao": "e80-eff", "myanmar": "1000-109f",
    "georgian": "10a0-10ff 1c90-1cbf", "ethiopic": "1200-137f", "khmer": "1780-17ff", "armenian": "530-58f",
    "cjk": "3040-30ff 3400-4dbf 4e00-9fff ac00-d7a3",
}
LANGUAGES = {
    "latin": "en es fr de it pt nl sv no da fi pl cs ro tr id vi sw af ca hr hu sk sl lt lv et is ms tl sq cy",
    "cyrillic": "ru uk bg sr", "greek": "el", "hebrew": "he iw", "arabic": "ar fa ur ps sd", "devanagari": "hi mr ne sa", "bengali": "bn as",
    "gurmukhi": "pa", "gujarati": "gu", "tamil": "ta", "telugu": "te", "kannada": "kn", "malayalam": "ml", "sinhala": "si", "thai": "th",
    "lao": "lo", "myanmar": "my", "khmer": "km", "ethiopic": "am", "georgian": "ka", "armenian": "hy", "cjk": "zh ja ko",
}
# Scripts without spaces, languages by engine and quality, codes a recognizer takes, names people write instead.
UNSPACED = ("cjk", "thai", "lao", "myanmar", "khmer")
LARGE_MODEL = "am az ba be bn bo br cy fo gl gu ha haw hi hy jw ka kk km kn la lb ln lo mg mi mk ml mn mr mt my ne nn oc pa ps sa sd si sn so sq su sw ta te tg tk tl tt uk ur uz yi yo yue"
FAST_ENGINE = "de en it ru"
UNUSABLE = "am as bn bo gu ka km ln lo mg ml mn my pa ps sd si sn so su te tg tk uz yo"
NAMED = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "russian": "ru",
    "ukrainian": "uk", "greek": "el", "turkish": "tr", "urdu": "ur", "arabic": "ar", "hindi": "hi", "chinese": "zh", "mandarin": "zh", "japanese": "ja",
    "korean": "ko", "persian": "fa", "farsi": "fa", "punjabi": "pa", "bengali": "bn", "uzbek": "uz", "pashto": "ps", "sindhi": "sd", "tamil": "ta",
    "telugu": "te", "indonesian": "id", "vietnamese": "vi", "thai": "th", "polish": "pl",
}
CODES = "af am ar as az ba be bg bn bo br bs ca cs cy da de el en es et eu fa fi fo fr gl gu ha haw he hi hr ht hu hy id is it ja jw ka kk km kn ko la lb ln lo lt lv mg mi mk ml mn mr ms mt my ne nl nn no oc pa pl ps pt ro ru sa sd si sk sl sn so sq sr su sv sw ta te tg th tk tl tr tt uk ur uz vi yi yo yue zh"


@cache
def _letters() -> np.ndarray:
    """Of each code point 0 if it is no letter, else the number of its script in the order of RANGES, from 1, or one more for others."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[[n for n in range(sys.maxunicode + 1) if chr(n).isalpha()]] = len(RANGES) + 1
    for k, ranges in enumerate(RANGES.values()):
        for r in ranges.split():
            a, b = (int(x, 16) for x in r.split("-"))
            own = out[a : b + 1]
            own[own > 0] = k + 1
    return out


def letter_counts(texts: list[str]) -> np.ndarray:
    """Letters of each text by script in the order of RANGES, then of all others: one pass over the characters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = len(RANGES) + 2
    cell = np.repeat(np.arange(len(texts)), [len(t) for t in texts]) * kinds + _letters()[codes]
    return np.bincount(cell, minlength=len(texts) * kinds).reshape(len(texts), kinds)[:, 1:]


@F.pandas_udf(StructType([StructField("script", StringType()), StructField("n", IntegerType()), StructField("letters", IntegerType())]))
def _dominant(text: pd.Series) -> pd.DataFrame:
    n = letter_counts(text.fillna("").tolist())
    top, letters = n.argmax(1), n.sum(1)
    names = np.array([*RANGES, "other"], object)[top]
    some = letters > 0
    whole = lambda x: pd.Series(np.where(some, x, 0), dtype="Int32").mask(~some)
    return pd.DataFrame({"script": np.where(some, names, None), "n": whole(n[np.arange(len(n)), top]), "letters": whole(letters)})


def dominant(text: Column) -> Column:
    """Struct of the commonest ``script`` of a text's letters, its count ``n`` and ``letters`` in all; null without
    letters. Of equals the first in the order of RANGES, which no rule here can tell from another: a tie has no majority."""
    d = _dominant(text)
    return F.when(d["letters"].isNotNull(), d)


def base_code(language: Column) -> Column:
    """The language of a code without region, in lower case."""
    return F.split_part(F.lower(F.replace(strip(language), F.lit("_"), F.lit("-"))), F.lit("-"), F.lit(1))


def target(language: Column) -> Column:
    """The script a language is written in; null where it is unknown or written in several."""
    pairs = [F.lit(x) for script, codes in LANGUAGES.items() for c in codes.split() for x in (c, script)]
    return F.try_element_at(F.create_map(*pairs), base_code(language))


def normalized_code(language: Column) -> Column:
    """Two-letter code of a label: region dropped, English names known; null for blank labels and for what is no code."""
    base = base_code(language)
    named = F.try_element_at(F.create_map(*[F.lit(x) for p in NAMED.items() for x in p]), F.lower(strip(language)))
    return F.coalesce(named, F.when(base.rlike("^[a-z]{2}$"), base))


def engine(language: Column, *, fast: bool) -> Column:
    """Struct ``engine, model, usable``: what would transcribe a language, and whether the result is worth having."""
    base = base_code(language)
    quick = base.isin(*FAST_ENGINE.split()) if fast else F.lit(False)
    large = F.coalesce(base.isin(*LARGE_MODEL.split()), F.lit(False))
    name = F.when(F.coalesce(quick, F.lit(False)), "fast").otherwise("whisper")
    model = F.when(F.coalesce(quick, F.lit(False)), "fast").when(large, "large-v3").otherwise("small")
    return F.struct(name.alias("engine"), model.alias("model"), (~F.coalesce(base.isin(*UNUSABLE.split()), F.lit(False))).alias("usable"))


def checked_code(language: Column) -> Column:
    """The code a recognizer takes, without a region it doesn't know; null for null and blank labels. Anything else is an error
    that names the code of a language's English name."""
    code = F.replace(F.lower(strip(language)), F.lit("_"), F.lit("-"))
    base = F.split_part(code, F.lit("-"), F.lit(1))
    known = CODES.split()
    guess = F.try_element_at(F.create_map(*[F.lit(x) for p in NAMED.items() for x in p]), code)
    wrong = F.raise_error(F.concat(F.lit("no language code: "), language, F.coalesce(F.concat(F.lit("; did you mean "), guess, F.lit("?")), F.lit("")))).cast("string")
    return F.when(language.isNull() | (code == ""), F.lit(None)).when(code.isin(*known), code).when(base.isin(*known), base).otherwise(wrong)


def is_code(language: Column) -> Column:
    """Whether :func:`checked_code` takes a label."""
    code = F.replace(F.lower(strip(language)), F.lit("_"), F.lit("-"))
    return language.isNull() | (code == "") | code.isin(*CODES.split()) | F.split_part(code, F.lit("-"), F.lit(1)).isin(*CODES.split())

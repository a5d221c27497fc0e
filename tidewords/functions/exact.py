"""Functions Spark has no built-in for, as Arrow-batched UDFs. Null for null."""

from __future__ import annotations

import difflib
import html
import textwrap
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities resolved."""
    return text.map(html.unescape, na_action="ignore")


def heard(text: str) -> str:
    """What of a text can be heard: one form of characters and case, no punctuation and symbols, single spaces."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(c for c in folded if unicodedata.category(c)[0] not in "PS").split())


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    """:func:`heard` of a column."""
    return text.map(heard, na_action="ignore")


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two texts as heard; two empty ones are alike."""
    a, b = heard(a), heard(b)
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`ratio` of two columns."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Bytes of the text by bytes after zlib; zero for the empty text."""
    def one(t: str) -> float:
        raw = t.encode()
        return len(raw) / len(zlib.compress(raw)) if raw else 0.0

    return text.map(one, na_action="ignore").astype("float64")


@F.pandas_udf(StringType())
def fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    """A number with so many digits, half to even on its exact binary value, as Python prints it."""
    return pd.Series([None if v is None or v != v else f"{v:.{int(d)}f}" for v, d in zip(x, digits, strict=True)], dtype="object")


@F.pandas_udf(StringType())
def wrapped(text: pd.Series) -> pd.Series:
    """Text in lines of 80 columns; long words and hyphens are never broken."""
    return text.map(lambda t: textwrap.fill(t, 80, break_long_words=False, break_on_hyphens=False), na_action="ignore")


def loud_edges(x: np.ndarray, rate: int) -> float | None:
    """Loudness of the louder edge of 25 ms by that of the body; None for short and silent ones."""
    edge = int(rate * 25 / 1000)
    rms = lambda y: float(np.sqrt(np.mean(y * y))) if len(y) else 0.0
    if not edge or len(x) < 4 * edge or (body := rms(x[edge:-edge])) < 1e-3:
        return None
    return max(rms(x[:edge]), rms(x[-edge:])) / body


@F.pandas_udf(DoubleType())
def edge_ratio(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """:func:`loud_edges` of a column of samples."""
    return pd.Series([None if s is None else loud_edges(np.asarray(s, np.float32), r) for s, r in zip(samples, rate, strict=True)], dtype="float64")

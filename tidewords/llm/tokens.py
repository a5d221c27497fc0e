"""Tokens of many texts as arrays: each distinct token is looked at once, the texts become numbers.

Texts are parted by white space. A :class:`Tokens` object gives every distinct token a row, and
derived columns (normal form, language scores, length ...) are computed for new rows only. It lives
as long as its Python worker; past ``MOST`` rows it starts afresh, which changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tidewords.llm.charforms import canonical

MOST = 400_000
#: Tokens that are worked on at a time; a text is never cut.
AT_ONCE = 300_000

_TIME = re.compile(r"[\W_]*\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\W_]*")
_PUNCT = re.compile(r"[\W_]+")


class _Ids(dict):
    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def word_form(token: str) -> str:
    """A token without case, punctuation, odd characters; empty for printed times and mere punctuation."""
    if _TIME.fullmatch(token):
        return ""
    if not token.isascii():
        token = canonical(token)
    return _PUNCT.sub("", token).casefold()


class Tokens:
    """Rows of distinct tokens with columns that grow along."""

    def __init__(self, **columns: Callable[[list[str]], np.ndarray]):
        self._make = {"form": self._form_ids} | columns
        self._fresh()

    def _fresh(self) -> None:
        self.ids = _Ids()
        self.forms = _Ids()
        self._done: dict[str, list] = {k: [0, None] for k in self._make}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token rows of all texts in one array, and the number of tokens of each."""
        if len(self.ids) > MOST:
            self._fresh()
        lists = [t.split() if t else [] for t in texts]
        get = self.ids.__getitem__
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.empty(int(lens.sum()), np.int64)
        at = 0
        for words in lists:
            flat[at : at + len(words)] = list(map(get, words))
            at += len(words)
        return flat, lens

    def column(self, name: str) -> np.ndarray:
        """The column's values by token row."""
        done, have = self._done[name]
        if done < len(self.ids) or have is None:
            new = self._make[name](list(self.ids)[done:])
            have = new if have is None else np.concatenate([have, new])
            self._done[name] = [len(self.ids), have]
        return have

    def _form_ids(self, tokens: list[str]) -> np.ndarray:
        """Ids of the word forms; -1 for none."""
        forms = self.forms
        return np.fromiter((forms[f] if (f := word_form(t)) else -1 for t in tokens), np.int64, len(tokens))


def portions(texts: list[str | None], at_once: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``at_once`` tokens, six characters counted as one."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) // 6 + 1 if t else 1
        if size >= at_once:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


_HELD: dict[str, Tokens] = {}


def held(key: str, columns: Callable[[], dict[str, Callable]]) -> Tokens:
    """This worker's token table under ``key``; made at first use, and alone: another key takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Tokens(**columns())
    return _HELD[key]


def per_row(keep: list[str], text: str, names: list[str], work: Callable[[list[str | None], pa.RecordBatch], list[pa.Array]]):
    """For mapInArrow: ``keep`` columns of each row and what ``work`` makes of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in portions(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *work(texts[a:b], part)], [*keep, *names])

    return run

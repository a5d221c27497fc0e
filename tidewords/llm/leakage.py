"""Evaluation texts that stand, fully or partly and often altered, in a corpus.

Method: q-gram lemma filtering and verification by banded alignment. Texts are reduced to word forms
(no case, punctuation, odd characters, printed times, hesitations) joined by single spaces. A passage
of ``least`` words of an item that stands in a document with at most ``changed`` words changed or
missing and ``inserted`` insertions (:class:`Rules`) shares at least

    (q-grams inside) - sum over the changed words that most q-grams touch - inserted * (Q - 1)

character q-grams with it, on diagonals no farther apart than what those edits can shift. Longer
passages may have more changes, but gain more q-grams than those cost. Q-grams that occur at more
than ``common`` places of the items are left out of the count and of the bound alike; they are
counted only for items whose bound would fall under ``weak`` without them. Shared
q-grams are counted in diagonal bands that overlap by half, so that such a set lies wholly in one,
and there in stretches of the item as long as a passage. In bands of which a stretch reaches the item's
bound the same is counted around each word diagonal that has q-grams, with room for what the edits shift,
and wherever it reaches the bound again the texts are aligned word by word inside that room.
Items of such short words that the bound is no more than ``FEW`` are found by words in its stead: of a passage
so many match that somewhere ``Rules.run`` of them follow one another; wherever they do in a text, it is aligned.

Scale. Items are indexed by executors in blocks of about ``BLOCK`` items, which lie in the shared folder; the driver
holds none. Documents are read once, whole, where they lie, for any number of blocks: a worker keeps blocks up to
``CACHE`` bytes, and with more of them holds ``AHEAD`` characters of texts while the blocks pass. There is no
shuffle of documents and there are no pairs of documents.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewords.llm.tokens import Tokens, held, portions, word_form
from tidewords.session import shared_dir

Q = 8


@dataclass(frozen=True)
class Rules:
    """What counts as a passage: ``least`` words of an item of which a share of at most ``errors`` is changed or missing,
    never more than ``gap`` in a row, with at most ``inserted`` words put in; and which q-grams are too common to count."""

    least: int = 20
    errors: float = 0.17
    gap: int = 2
    inserted: int = 2
    common: int = 12
    weak: int = 12

    @property
    def changed(self) -> int:
        return int(self.errors * self.least)

    @property
    def room(self) -> int:
        """Word diagonals on each side of the one aligned at; edits shift by changed + 3 * inserted words at most, and the one
        aligned at is up to NEAR from those of the q-grams."""
        return self.changed + 3 * self.inserted + NEAR + 1

    @property
    def run(self) -> int:
        return max(1, math.ceil((self.least - self.changed) / (self.changed + self.inserted + 1)))


#: Tokens of texts that are searched at a time: their arrays stay in the cache.
AT_ONCE = 50_000
NEAR = 2
#: A bound no higher than this filters nothing.
FEW = 4
#: Items in a block and their characters, about; bytes of blocks that a worker keeps; characters it holds while blocks pass.
BLOCK, BLOCK_CHARS = 2_000, 8_000_000
CACHE, AHEAD = 256_000_000, 16_000_000
BITS = 22

# Word forms of hesitations.
HESITATIONS = frozenset("um umm uh uhm uhh hm hmm hmmm er erm eh ehm äh ähm öh euh mm mmm ээ эм ааа εμ".split())

_ROLL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return [f for t in (text or "").split() if (f := word_form(t)) and f not in HESITATIONS]


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q = 8 characters from each position on."""
    c = chars.astype(np.uint64)
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        two = c[:-1] * _ROLL + c[1:]
        p2 = _ROLL * _ROLL
        four = two[:-2] * p2 + two[2:]
        code = four[:-4] * (p2 * p2) + four[4:]
        code ^= code >> np.uint64(31)
        code *= np.uint64(0xD6E8FEB86659FD93)
    return code


def _chars(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return np.frombuffer("".join(w + " " for w in words).encode("utf-32-le"), np.uint32), size


def _bound(size: np.ndarray, used: np.ndarray, rules: Rules) -> int:
    """The fewest q-grams that any passage of the least words still shares after the edits. size: characters of each
    word with its space; used: of each position whether its q-gram counts."""
    end = np.cumsum(size)
    start = end - size
    total = np.concatenate([[0], np.cumsum(used)])
    upto = lambda p: total[np.clip(p, 0, len(used))]
    touched = upto(end) - upto(start - Q + 1)  # starts that reach into the word or its space
    least = []
    for a in range(len(size) - rules.least + 1):
        b = a + rules.least
        inside = upto(end[b - 1] - 1 - Q + 1) - upto(start[a])
        lost = np.sort(touched[a:b])[len(touched[a:b]) - rules.changed :].sum()
        least.append(int(inside - lost - rules.inserted * (Q - 1)))
    return min(least)


def _word_codes(words: list[str]) -> np.ndarray:
    """A 64-bit code of each word, the same in every process."""
    return np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words), np.uint64, len(words))


def _runs(codes: np.ndarray, n: int) -> np.ndarray:
    """A code of the ``n`` words from each one on."""
    k = max(0, len(codes) - n + 1)
    out = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ codes[i : i + k]) * _ROLL
    return out


class Index:
    """The q-grams of a block of items, their bounds and their words."""

    def __init__(self, items: list[tuple[int, str]], rules: Rules | None = None):
        self.rules = rules = rules or Rules()
        kept = [(i, w) for i, t in items if len(w := words_of(t)) >= rules.least]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        laid = [_chars(w) for w in self.words]
        codes = [grams(c) for c, _ in laid]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c)) for c in codes)])
        _, back, times = np.unique(code, return_inverse=True, return_counts=True)
        used = times[back] <= rules.common
        first = np.cumsum([0, *(len(c) for c in codes)])
        weak = np.zeros(len(code), bool)
        for n, (_, size) in enumerate(laid):
            if _bound(size, used[first[n] : first[n + 1]], rules) < rules.weak:
                weak[first[n] : first[n + 1]] = True
        used |= np.isin(code, code[weak])
        self.bound = np.array([_bound(size, used[first[n] : first[n + 1]], rules) for n, (_, size) in enumerate(laid)], np.int64)
        self.reach = np.array([int(np.convolve(size, np.ones(rules.least, np.int64), "valid").max()) for _, size in laid], np.int64)
        self.ends = [np.cumsum(size) for _, size in laid]
        longest_words = max((int(np.sort(size)[len(size) - rules.changed :].sum()) for _, size in laid), default=0)
        self.half = longest_words + rules.inserted * 20  # what the edits may shift the diagonal by; half a band
        by_words = self.bound <= FEW
        used &= ~by_words[item]
        code, item, pos = code[used], item[used], pos[used]
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.start = np.append(first, len(code))
        self.item, self.pos = item[order], pos[order]
        runs = [(n, _runs(_word_codes(w), rules.run)) for n, w in enumerate(self.words) if by_words[n]]
        run = np.concatenate([np.zeros(0, np.uint64), *(r for _, r in runs)])
        order = np.argsort(run, kind="stable")
        self.runs, first = np.unique(run[order], return_index=True)
        self.run_start = np.append(first, len(run))
        self.run_item = np.repeat([n for n, _ in runs] or [0], [len(r) for _, r in runs] or [0]).astype(np.int64)[order]
        self.run_pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(r)) for _, r in runs)])[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.codes >> np.uint64(64 - BITS)).astype(np.int64)] = True


def aligned(item: list[str], text: list[str], lean: int, half: int) -> np.ndarray:
    """Which of the item's words the best alignment matches. Of text only positions within ``half`` words of
    the diagonal ``lean`` (text position less item position) are looked at."""
    n = len(item)
    width = 2 * half + 1
    score = [[0] * (width + 2) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = score[i], score[i + 1]
        w = item[i]
        for k in range(width - 1, -1, -1):
            j = i + lean - half + k
            best = max(row[k + 1], below[k - 1] if k else 0)  # leave out the text's word, or the item's
            if 0 <= j < len(text) and text[j] == w:
                best = max(best, below[k] + 1)
            row[k] = best
    hit = np.zeros(n, bool)
    i, k = 0, 0
    k = max(range(width), key=lambda x: score[0][x])
    while i < n and 0 <= k < width:
        j = i + lean - half + k
        if 0 <= j < len(text) and text[j] == item[i] and score[i][k] == score[i + 1][k] + 1:
            hit[i] = True
            i += 1
        elif score[i][k] == score[i][k + 1]:
            k += 1
        else:
            i, k = i + 1, k - 1
    return hit


def present(item: list[str], text: list[str], lean: int, half: int) -> np.ndarray:
    """Which of the item's words stand anywhere in their part of the band: no alignment matches more."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(text):
        places.setdefault(w, []).append(j)
    return np.fromiter((any(abs(j - i - lean) <= half for j in places.get(w, ())) for i, w in enumerate(item)), bool, len(item))


def longest(hit: np.ndarray, rules: Rules = Rules()) -> int:
    """Words of the longest passage that begins and ends with a match and has few enough misses."""
    at = np.flatnonzero(hit).tolist()
    best = 0
    for a in range(len(at)):
        for b in range(a, len(at)):
            if b > a and at[b] - at[b - 1] > rules.gap + 1:
                break
            size = at[b] - at[a] + 1
            if size > best and size - (b - a + 1) <= rules.errors * size:
                best = size
    return int(best)


def _leans(lean: np.ndarray, spot: np.ndarray, reach: int, bound: int, room: int) -> Iterator[int]:
    """The word diagonals to align at: those around which q-grams in a stretch of the item reach the bound. Any q-gram's
    diagonal is within NEAR of one that is tried. spot: places in the item, ascending."""
    step = 2 * NEAR + 1
    for at in np.unique(lean // step).tolist():
        mid = at * step + NEAR
        s = np.unique(spot[np.abs(lean - mid) <= room])
        if len(s) >= bound and (s[bound - 1 :] - s[: len(s) - bound + 1] < reach).any():
            yield mid


class _Forms:
    """Characters of the word forms of a token table."""

    def __init__(self, table: Tokens):
        self.table, self.forms = table, None
        self.names: list[str] = []

    def update(self) -> None:
        if self.forms is not self.table.forms:
            self.forms, self.names = self.table.forms, []
            self.chars, self.size, self.word, self.code = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)
        if len(self.names) < len(self.forms):
            new = list(itertools.islice(self.forms, len(self.names), None))
            chars, size = _chars(new)
            self.names += new
            self.chars, self.size = np.concatenate([self.chars, chars]), np.concatenate([self.size, size])
            self.word = np.concatenate([self.word, np.fromiter((w not in HESITATIONS for w in new), bool, len(new))])
            self.code = np.concatenate([self.code, _word_codes(new)])
        self.start = np.cumsum(self.size) - self.size


_FORMS: dict[int, _Forms] = {}


class _Laid:
    """Texts made ready to be searched for the items of any block."""

    def __init__(self, table: Tokens, texts: list[str | None]):
        rows, lens = table.encode(texts)
        form = table.column("form")[rows]
        if id(table) not in _FORMS:
            _FORMS.clear()
            _FORMS[id(table)] = _Forms(table)
        self.forms = forms = _FORMS[id(table)]
        forms.update()
        doc = np.repeat(np.arange(len(lens)), lens)
        keep = form >= 0
        keep[keep] = forms.word[form[keep]]
        self.form, self.doc = form[keep], doc[keep]
        self.size = forms.size[self.form]
        self.names = forms.names
        ends = np.cumsum(self.size)
        total = int(ends[-1]) if len(ends) else 0
        chars = forms.chars[np.arange(total) - np.repeat(ends - self.size, self.size) + np.repeat(forms.start[self.form], self.size)]
        self.code = grams(chars)
        self.word_at = np.repeat(np.arange(len(self.form)), self.size)
        self.doc_start = np.searchsorted(self.doc, np.arange(len(lens)))
        self.doc_end = np.searchsorted(self.doc, np.arange(len(lens)), side="right")

    def holds(self, index: Index, text: int, item: int, lean: int) -> bool:
        """Whether the text holds a passage of the item around the word diagonal ``lean``."""
        rules, words = index.rules, index.words[item]
        low = max(0, lean - rules.room)
        base = self.doc_start[text]
        region = [self.names[f] for f in self.form[base + low : min(self.doc_end[text], base + max(0, lean + len(words) + rules.room))]]
        return longest(present(words, region, lean - low, rules.room), rules) >= rules.least and longest(aligned(words, region, lean - low, rules.room), rules) >= rules.least


def _by_words(index: Index, laid: _Laid) -> Iterator[tuple[int, int]]:
    """Pairs of text number and item number of the items whose q-grams filter nothing."""
    n = index.rules.run
    if not len(index.runs) or len(laid.form) < n:
        return
    code = _runs(laid.forms.code[laid.form], n)
    slot = np.minimum(np.searchsorted(index.runs, code), len(index.runs) - 1)
    near = np.flatnonzero((index.runs[slot] == code) & (laid.doc[: len(code)] == laid.doc[n - 1 :]))
    slot = slot[near]
    many = index.run_start[slot + 1] - index.run_start[slot]
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.run_start[slot], many)
    text = laid.doc[np.repeat(near, many)]
    lean = np.repeat(near, many) - laid.doc_start[text] - index.run_pos[at]
    step = 2 * NEAR + 1
    tries = np.unique(np.stack([text, index.run_item[at], lean // step], 1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
    done: set[tuple[int, int]] = set()
    for t, i, k in tries.tolist():
        if (t, i) not in done and laid.holds(index, t, i, k * step + NEAR):
            done.add((t, i))
            yield t, i


def search(index: Index, table: Tokens, texts: list[str | None]) -> list[tuple[int, int]]:
    """Pairs of text number and item id of the passages in ``texts``."""
    return matched(index, _Laid(table, texts)) if index.ids else []


def matched(index: Index, laid: _Laid) -> list[tuple[int, int]]:
    """:func:`search` of texts made ready."""
    return list(dict.fromkeys([*_by_grams(index, laid), *((t, index.ids[i]) for t, i in _by_words(index, laid))]))


def _by_grams(index: Index, laid: _Laid) -> list[tuple[int, int]]:
    form, doc, code, word_at, doc_start = laid.form, laid.doc, laid.code, laid.word_at, laid.doc_start
    if not len(form) or not len(index.codes):
        return []
    near = np.flatnonzero(index.seen[(code >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(near):
        return []
    slot = np.minimum(np.searchsorted(index.codes, code[near]), len(index.codes) - 1)
    same = index.codes[slot] == code[near]
    near, slot = near[same], slot[same]
    word_first, word_last = word_at[near], word_at[near + Q - 1]
    one_text = doc[word_first] == doc[word_last]  # not across two documents
    near, slot, word_first = near[one_text], slot[one_text], word_first[one_text]
    many = index.start[slot + 1] - index.start[slot]
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.start[slot], many)
    item, spot, where = index.item[at], index.pos[at], np.repeat(near, many)
    text = doc[np.repeat(word_first, many)]
    # pairs that share too few q-grams wherever they lie are done with
    pair = text * len(index.ids) + item
    ordered = np.sort(pair)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    share = np.diff(np.append(first, len(ordered)))
    some = ordered[first]
    some = some[share >= index.bound[some % len(index.ids)]]
    if not len(some):
        return []
    held_by = np.minimum(np.searchsorted(some, pair), len(some) - 1)
    on = some[held_by] == pair
    item, spot, where, text, pair = item[on], spot[on], where[on], text[on], held_by[on]
    # band k spans the cells k and k + 1 of the diagonals
    cell = (where - spot + int(spot.max())) // index.half + 1
    wide = int(spot.max()) + 1
    key = (pair * (int(cell.max()) + 1) + cell) * wide + spot
    key = np.concatenate([key, key - wide])
    hits = np.argsort(key, kind="stable")
    key = key[hits]
    hits %= len(item)
    once = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # a place of the item counts once in a band
    band, at = key[once] // wide, hits[once]
    new = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    # the most q-grams in any stretch of the item as long as its longest passage of LEAST words
    place = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(at)))) * (1 << 32) + spot[at]
    inside = np.searchsorted(place, place + index.reach[item[at]]) - np.arange(len(at))
    enough = np.flatnonzero(np.maximum.reduceat(inside, new) >= index.bound[item[at[new]]])
    begins = once[new]
    stops = np.append(begins[1:], len(hits))
    found: dict[tuple[int, int], None] = {}
    tried: set[tuple[tuple[int, int], int]] = set()
    for k in enough:
        own = hits[begins[k] : stops[k]]
        n = int(item[own[0]])
        pair = (int(text[own[0]]), index.ids[n])
        if pair in found:
            continue
        base = doc_start[pair[0]]
        lean = word_at[where[own]] - base - np.searchsorted(index.ends[n], spot[own], side="right")
        for lean_w in _leans(lean, spot[own], int(index.reach[n]), int(index.bound[n]), index.rules.room):
            if (pair, lean_w) in tried:
                continue
            tried.add((pair, lean_w))
            if laid.holds(index, pair[0], n, lean_w):
                found[pair] = None
                break
    return list(found)


def _indexed(items: DataFrame, item_id: str, text: str, rules: Rules) -> tuple[str, list[int]]:
    """The folder of the items' blocks, built by executors, and the size of each in bytes. Items fall to blocks by hash."""
    spark = items.sparkSession
    rows = items.where(f"`{item_id}` is not null and `{text}` is not null").select(F.col(item_id).alias("id"), F.col(text).alias("t")).distinct()
    count, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    n = max(1, math.ceil(count / BLOCK), math.ceil(chars / BLOCK_CHARS))

    def build(group: pa.Table) -> pa.Table:
        own = sorted(zip(group.column("id").to_pylist(), group.column("t").to_pylist(), strict=True))
        blob = pickle.dumps(Index(own, rules))
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "size": pa.array([len(blob)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    at = f"{shared_dir(spark)}/tidewords-items-{uuid.uuid4().hex[:12]}"
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(n)).cast("int"))
    keyed.groupBy("block").applyInArrow(build, "block int, size bigint, blob binary").write.partitionBy("block").parquet(at)
    sizes = {r.block: r.size for r in spark.read.schema("size bigint, blob binary, block int").parquet(at).select("block", "size").collect()} if count else {}
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "/", whole).replace("s3a://", "s3://"), [sizes.get(k, 0) for k in range(n)]


_LOADED: OrderedDict[tuple[str, int], tuple[Index, int]] = OrderedDict()


def _block(folder: str, k: int) -> Index:
    """A block of items out of the folder; this worker keeps the last ones, up to CACHE bytes."""
    if (folder, k) not in _LOADED:
        from pyarrow import fs
        from pyarrow import parquet as pq

        system, path = fs.FileSystem.from_uri(folder)
        files = [f for f in system.get_file_info(fs.FileSelector(f"{path}/block={k}")) if f.path.endswith(".parquet")]
        blob = next(b for f in files for b in pq.ParquetFile(f.path, filesystem=system).read(["blob"]).column("blob").to_pylist())
        while _LOADED and sum(n for _, n in _LOADED.values()) + len(blob) > CACHE:
            _LOADED.popitem(last=False)
        _LOADED[folder, k] = (pickle.loads(blob), len(blob))
    _LOADED.move_to_end((folder, k))
    return _LOADED[folder, k][0]


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """``doc_id, item_id`` of every document and every item of which it holds a passage after ``rules``.

    Null and empty texts hold nothing, items of fewer words are held by nothing, repeated rows and
    repeated passages come out once, empty tables give no rows, other columns are ignored.
    """
    kind = items.schema[item_id].dataType
    schema = f"`{doc_id}` {documents.schema[doc_id].dataType.simpleString()}, `{item_id}` {kind.simpleString()}"
    folder, sizes = _indexed(items, item_id, text, rules or Rules())
    blocks = [k for k, n in enumerate(sizes) if n]
    ahead = AHEAD if sum(sizes) > CACHE else 0

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def found(held_back: list[tuple[pa.Array, list[str | None]]]) -> Iterator[pa.RecordBatch]:
        table = held("leakage", dict)
        parts = [(ids, a, texts[a:b]) for ids, texts in held_back for a, b in portions(texts, AT_ONCE)]
        for group in [blocks] if not ahead else [[k] for k in blocks]:  # blocks that don't all fit pass one by one
            for ids, a, own in parts:
                laid = _Laid(table, own)
                for k in group:
                    if hits := matched(_block(folder, k), laid):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + t for t, _ in hits])), pa.array([i for _, i in hits], arrow)], [doc_id, item_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, size = [], 0
        for batch in batches:
            texts = batch.column(text).to_pylist()
            held_back.append((batch.column(doc_id), texts))
            size += sum(len(t) for t in texts if t)
            if size >= ahead:
                yield from found(held_back)
                held_back, size = [], 0
        yield from found(held_back)

    return documents.select(doc_id, text).mapInArrow(run, schema).distinct()

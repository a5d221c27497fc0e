"""Oversized items cut into pieces within a limit, at natural boundaries, with an overlap.

Method: structure-tree packing. A text is parsed into a tree: sections under headings, blocks and list items nested as they
are, lines, sentences, clauses, words; timed words into pauses, sentences, short pauses and clauses, words. Only subtrees
that are too large are gone down into; on the way up sibling subtrees are merged as long as they fit. A heading or a bullet
stays with what follows it. What is packed is at most the limit less the overlap; every piece but the first then also takes
the overlap, exactly, from the end of the piece before: words of a text, milliseconds of a timed item.

Spark measures the items and sends only those over the limit to Python, row by row; no shuffle.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds without a word that part speech like the end of a sentence, or of a clause.
PAUSE, SHORT_PAUSE = 600, 250
#: Depths of boundaries: headings have 1 to 6, items of lists ITEM and what they are nested.
BLOCK, ITEM, LINE, SENTENCE, CLAUSE, WORD, GLUED = 7, 8, 16, 17, 18, 19, 20

_SENTENCE = re.compile(r"[.!?…。][\"'”’)\]]*$")
_CLAUSE = re.compile(r"[,;:—–][\"'”’)\]]*$")
_MARK = re.compile(r"(?:[-*+•]|\d{1,3}[.)])$")
_HEADING = re.compile(r"#{1,6}$")
_TAG = re.compile(r"<(/?)(h[1-6]|p|div|section|article|blockquote|pre|table|tr|ul|ol|li|hr)\b[^>]*>?", re.IGNORECASE)


@dataclass
class Node:
    """Leaves ``a`` to ``b`` of a tree; ``loose`` nodes are parts of running text, whose pieces may join those beside them."""

    a: int
    b: int
    loose: bool
    children: list[Node] = field(default_factory=list)


def tree(depth: list[int]) -> Node:
    """The tree of leaves whose boundaries have these depths. depth[i]: of the boundary before leaf i; depth[0] counts for nothing."""
    n = len(depth)
    levels = sorted({d for d in depth[1:]})

    def node(a: int, b: int, k: int) -> Node:
        while k < len(levels) and b - a > 1:
            at = [a, *(i for i in places[levels[k]][bisect.bisect_right(places[levels[k]], a) : bisect.bisect_left(places[levels[k]], b)]), b]
            if len(at) > 2:
                return Node(a, b, levels[k] >= LINE, [node(x, y, k + 1) for x, y in zip(at, at[1:], strict=False)])
            k += 1
        return Node(a, b, True)

    places: dict[int, list[int]] = {d: [] for d in levels}
    for i in range(1, n):
        places[depth[i]].append(i)
    return node(0, n, 0)


def pack(top: Node, size: Callable[[int, int], float], most: float) -> list[tuple[int, int]]:
    """Ranges of leaves of at most ``most``; a single leaf is never divided."""
    if not top.children or size(top.a, top.b) <= most:
        return [(top.a, top.b)]
    out: list[tuple[int, int]] = []
    joins = False  # whether the last range may take in what follows
    for child in top.children:
        fits = size(child.a, child.b) <= most
        for a, b in [(child.a, child.b)] if fits else pack(child, size, most):
            if out and joins and (fits or top.loose) and size(out[-1][0], b) <= most:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            joins = fits or top.loose
    return out


def _ending(before: str) -> int:
    return SENTENCE if _SENTENCE.search(before) else CLAUSE if _CLAUSE.search(before) else WORD


def depths(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Where each word stands, and the depth of the boundary before it."""
    spans: list[tuple[int, int]] = []
    out: list[int] = []
    indents: list[int] = []  # of the list items that are open
    lists, hold, last = 0, "", 0  # hold: what the next word stays with, a heading's line or tags, or the word before
    for m in re.finditer(r"\S+", text):
        w, gap = m[0], text[last : m.start()]
        opens = not spans or "\n" in gap
        indent = len(gap.rsplit("\n", 1)[-1].expandtabs(4)) if opens else 0
        blank = gap.count("\n") > 1
        if blank and not indent:
            indents = []
        held = hold != ""
        if hold == "word" or hold == "line" and opens:
            hold = ""
        depth = BLOCK if blank else LINE if opens else _ending(text[slice(*spans[-1])])
        if opens and _HEADING.fullmatch(w):
            depth, hold, indents = len(w), "line", []
        elif (opens or w == "•") and _MARK.fullmatch(w):
            while indents and indents[-1] >= indent:
                indents.pop()
            indents.append(indent)
            depth, hold = min(ITEM + len(indents) - 1, LINE - 1), hold or "word"
        for tag in _TAG.finditer(w):
            closes, name = tag[1] == "/", tag[2].lower()
            if name in ("ul", "ol"):
                lists = max(0, lists - 1 if closes else lists + 1)
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                hold = "word" if closes else "tag"
            if not closes:
                own = int(name[1]) if hold == "tag" and name[1:].isdigit() else min(ITEM + max(0, lists - 1), LINE - 1) if name in ("li", "ul", "ol") else BLOCK
                depth = min(depth, own)
        spans.append(m.span())
        out.append(GLUED if held else depth)
        last = m.end()
    return spans, out


def cut_text(text: str, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """First word, words and text of each piece; one piece if the text is within the limit."""
    spans, depth = depths(text)
    if len(spans) <= most:
        return [(0, len(spans), text.strip())]
    out = []
    for a, b in pack(tree(depth), lambda x, y: y - x, most - overlap):
        a = max(0, a - overlap) if a else 0
        out.append((a, b - a, text[spans[a][0] : spans[b - 1][1]]))
    return out


def usable(w: dict | None) -> bool:
    return bool(w) and w["start_s"] is not None and w["end_s"] is not None and math.isfinite(w["start_s"]) and math.isfinite(w["end_s"]) and w["end_s"] >= w["start_s"]


def _ms(seconds: float | None) -> int | None:
    return round(seconds * 1000) if seconds is not None and math.isfinite(seconds) else None


def cut_timed(text: str | None, start: float | None, end: float | None, words: list[dict] | None, most: float, overlap: float) -> list[tuple[float, float, str]]:
    """Start, end and text of each piece of a timed item, in whole milliseconds.

    The pieces cover the item from its start to its end (where one is unknown, from the first usable word or to the last);
    each begins ``overlap`` before the one before it ends. Cuts lie amid pauses, else between words; a word, or a
    silence, that is longer than a piece may be is cut by time. A piece's text are the words that begin in it. Words without
    usable times keep their place beside the word before. Without any usable word the text is spread evenly.
    """
    room, lap = round(most * 1000) - round(overlap * 1000), round(overlap * 1000)
    heard: list[list] = []  # start, end, text
    lead = ""
    for w in words or ():
        said = ((w or {}).get("text") or "").strip()
        if usable(w):
            heard.append([_ms(w["start_s"]), _ms(w["end_s"]), f"{lead} {said}".strip()])
            lead = ""
        elif said and heard:
            heard[-1][2] = f"{heard[-1][2]} {said}".strip()
        elif said:
            lead = f"{lead} {said}".strip()
    heard.sort(key=lambda x: (x[0], x[1]))
    own = _ms(start) is not None and _ms(end) is not None
    first = _ms(start) if own else heard[0][0] if heard else None
    stop = _ms(end) if own else max(x[1] for x in heard) if heard else None
    if first is None or stop < first:
        return []
    if not heard:
        said = (text or "").split() or [""]
        heard = [[first + (stop - first) * i // len(said), first + (stop - first) * (i + 1) // len(said), w] for i, w in enumerate(said)]
    edges, depth, reach = [first], [0], heard[0][1]
    for (_, _, before), (a, b, _) in zip(heard, heard[1:], strict=False):
        gap = a - reach
        by_text = _ending(before)
        edges.append(min(stop, max(edges[-1], (a + reach) // 2 if gap > 0 else a)))
        depth.append(LINE if gap >= PAUSE else min(by_text, CLAUSE) if gap >= SHORT_PAUSE else by_text)
        reach = max(reach, b)
    fine, deep = [], []  # no leaf is longer than a piece may be
    for a, b, d in zip(edges, [*edges[1:], stop], depth, strict=True):
        parts = max(1, -(-(b - a) // room))
        fine += [a + (b - a) * k // parts for k in range(parts)]
        deep += [d, *[GLUED] * (parts - 1)]
    fine.append(stop)
    begins = [x[0] for x in heard]
    out = []
    for a, b in pack(tree(deep), lambda x, y: fine[y] - fine[x], room):
        lo, hi = fine[a] - lap if a else fine[0], fine[b]
        i = bisect.bisect_left(begins, lo) if a else 0
        j = bisect.bisect_left(begins, hi) if b < len(fine) - 1 else len(begins)
        out.append((lo / 1000, hi / 1000, " ".join(x[2] for x in heard[i:j] if x[2])))
    return out


def words_in(text: Column) -> Column:
    """Number of words parted by white space of any kind; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def duration_ms(start: Column, end: Column, words: Column) -> Column:
    """Whole milliseconds from start to end; where one is null or not finite, of the usable words; else null."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    held = F.filter(words, lambda w: good(w["start_s"]) & good(w["end_s"]) & (w["end_s"] >= w["start_s"]))
    first, last = F.array_min(F.transform(held, lambda w: w["start_s"])), F.array_max(F.transform(held, lambda w: w["end_s"]))
    own = good(start) & good(end)
    return F.round((F.when(own, end).otherwise(last) - F.when(own, start).otherwise(first)) * 1000).cast("long")


_PIECE = "piece_no int, size double, start_s double, end_s double, text string"


def _emit(df: DataFrame, keep: list[str], cut: Callable[[dict], list[tuple[float, float | None, float | None, str]]]) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), _PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], [[] for _ in range(5)]
            for i, row in enumerate(batch.to_pylist()):
                for n, piece in enumerate(cut(row)):
                    at.append(i)
                    for col, v in zip(cols, (n, *piece), strict=True):
                        col.append(v)
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*keep, "piece_no", "size", "start_s", "end_s", "text"])

    return df.mapInArrow(run, schema)


def text_pieces(df: DataFrame, keep: list[str], most: int, overlap: int, text: str = "text") -> DataFrame:
    """Pieces of the texts of more than ``most`` words: ``keep`` columns, piece_no, size in words, null times, text.

    Texts within the limit, null and empty ones have no rows; repeated rows are cut alike.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be less than the limit")
    over = df.where(words_in(F.col(text)) > most).select(*dict.fromkeys([*keep, text]))
    return _emit(over, keep, lambda r: [(float(n), None, None, t) for _, n, t in cut_text(r[text], most, overlap)])


def timed_pieces(df: DataFrame, keep: list[str], most: float, overlap: float) -> DataFrame:
    """Pieces of the items longer than ``most`` seconds: ``keep`` columns, piece_no, size in seconds, start_s, end_s, text.

    df: text, start_s, end_s, words. The flag ``oversized`` is not asked. Items within the limit, and those
    of which no time is known, have no rows.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be less than the limit")
    over = df.where(duration_ms(F.col("start_s"), F.col("end_s"), F.col("words")) > round(most * 1000))
    over = over.select(*dict.fromkeys([*keep, "text", "start_s", "end_s", "words"]))
    return _emit(over, keep, lambda r: [(b - a, a, b, t) for a, b, t in cut_timed(r["text"], r["start_s"], r["end_s"], r["words"], most, overlap)])

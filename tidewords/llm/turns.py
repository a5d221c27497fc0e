"""Speech transcripts as clean speaker turns in order.

Method: precedence constraints. Between two segments of a source stand timing edges (the one that starts earlier comes
first), cue edges (a segment that only names the next speaker comes before the one after it) and dialogue edges (lines
follow one another by position). Timing is heaviest, then cues, then dialogue. Edges that contradict one another close
a cycle; of each cycle the lightest edge goes, of equal ones the last, and is counted. What is left is ordered
topologically, free segments by time and position. A segment without a start hangs on its edges alone: it follows the
dated segment before it, cues go with the one after them. Then labels, printed times, sound annotations and hesitations
are taken off, labels are brought to one name per speaker, and each segment gets the speaker who holds the word.

Scale. No task gets a whole source. Three passes of Python, each over bounded blocks out of a sorted shuffle:

1. texts are parsed where they lie; from there on a segment is a few numbers and its label;
2. blocks of positions: repeated rows, dialogue and cue edges, conflicts, and the time each undated segment hangs on;
3. blocks of time, each with the turns that reach into it: topological order, overlaps, who speaks, where it changes.

What a block inherits, the last label and the last speaker before it, comes from one row per block. A block that holds
more than ``HOLD`` rows is worked off in pieces: cut anywhere in time order, no edge leads back.
Labels meet the names of their source by (source, written form).
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.llm.charforms import canonical
from tidewords.llm.people import NOBODY, person, person_of
from tidewords.operators import blocks
from tidewords.session import settle

#: Seconds in a block of segments and in a bucket of the overlap join.
BLOCK_S, BUCKET_S = 600, 60
#: Positions in a block, and rows of one block that are held at most.
BLOCK_POS, HOLD = 4_096, 50_000

# Words of sound annotations, words that none of them has, and hesitations.
SOUNDS = frozenset("music applause laughs laughter laughing chuckles chuckling sighs sighing coughs coughing noise static beep inaudible crosstalk silence cheering cheers clapping indistinct unintelligible gasps whispers sniffs crying background foreign playing bell rings ringing".split())
FUNCTION = frozenset("i you he she it we they me him her us them my your his its our their mine yours this that these those who what which a an the and or but so if as at by for from in into of off on out over to up with about after before than then not no yes is are was were be been am do does did has have had will would can could should may might must there here always perhaps sometimes often yesterday".split())
HESITATIONS = frozenset("um umm uh uhm hm hmm hmmm er erm eh mm mmm ээ эм äh ähm euh".split())

_TIME = re.compile(r"[\[(]?(?<![\d:])\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?![\d:])[\])]?")
_SOUND = re.compile(r"\[([^\[\]]*)\]|\(([^()]*)\)|\*([^*]+)\*|<([^<>]+)>|[♪♫🎵🎶]+")
_LABEL = re.compile(r"(?:>>+|[-–—])?\s*(?:\[([^\[\]]{1,60})\]|\(([^()]{1,60})\)|([^\s:\[\](){}][^:\[\](){}]{0,59}?)\s?:(?=\s|$)|((?:speaker|spk)[ _]?\d+)\s[-–—](?=\s|$))", re.IGNORECASE)
_NAME = re.compile(r"[^\W\d_][\w'’-]*\.?(?:\s[^\W\d_][\w'’-]*)*")
_WORD = re.compile(r"\w+")
_SPECIAL = re.compile(r"[\[(*<:♪♫🎵🎶]|\d\s[-–—]")
_GAPS = re.compile(r"\s+")


def annotation(inner: str) -> bool:
    """Whether bracketed words describe a sound: one of SOUNDS, or a few plain words with a verb's ending and no word that
    speech is held together by, as in "door slams"; a capital is a name's unless all letters are."""
    words = _WORD.findall(inner)
    low = [w.casefold() for w in words]
    if not low or any(w in SOUNDS for w in low):
        return True
    plain = not any(w[0].isupper() for w in words) or inner.isupper() and len(words) > 1
    return plain and len(words) <= 4 and not any(w in FUNCTION for w in low) and any(len(w) > 4 and w.endswith(("ing", "s")) for w in low)


def _no_sound(m: re.Match) -> str:
    inner = next((g for g in m.groups()[:2] if g is not None), None)
    # starred and angled words, and notes, are always annotations
    return " " if inner is None or annotation(inner) else m[0]


def _words(text: str) -> Iterator[str]:
    """The words of a text that are no hesitations and not mere punctuation."""
    for w in text.split():
        if len(w) > 5 and w.isalnum() or (f := "".join(_WORD.findall(w)).casefold()) and f not in HESITATIONS:
            yield w


def spoken(text: str, brief: bool = False) -> str:
    """What is said: without sound annotations, printed times and hesitations; empty if nothing is left. If ``brief`` its first word."""
    words = _words(_SOUND.sub(_no_sound, _TIME.sub(" ", text)) if _SPECIAL.search(text) else text)
    return next(words, "") if brief else " ".join(words)


def parse(text: str | None, brief: bool = False) -> tuple[str | None, str, str]:
    """The written form of the label at the head of a segment, if there may be one; what is said if it is a
    label; what is said if it isn't, in both only the first word if ``brief``. Forms: ``#n`` of a numbered speaker, else words in
    lower case."""
    if not text:
        return None, "", ""
    text = _GAPS.sub(" ", canonical(html.unescape(text) if "&" in text else text)).strip()
    if not _SPECIAL.search(text):  # no label, time or annotation can be
        whole = spoken(text, brief)
        return None, whole, whole
    body = text
    while m := _TIME.match(body):
        body = body[m.end() :].strip()
    whole = spoken(body, brief)
    m = _LABEL.match(body)
    if not m:
        return None, whole, whole
    said = next(g for g in m.groups() if g is not None).strip()
    who = person(said)
    rest = spoken(body[m.end() :], brief)
    if who and who[0] == "#":
        return who, rest, rest
    if who in NOBODY or who is None:
        return ("?" + said.casefold(), rest, whole) if m[1] is None and m[2] is None else (None, whole, whole)
    if not _NAME.fullmatch(said) or len(said.split()) > 4 or not all(w[0].isupper() for w in said.split()) or any(w in SOUNDS for w in who.split()):
        return None, whole, whole
    return " ".join(who.replace(".", " ").split()), rest, whole


def _forms(people: DataFrame) -> DataFrame:
    """``source_id, form, speaker``: the ways to write each named person of a source. One that may mean several of them
    is a speaker of its own, by that form."""
    words = F.split("speaker", " ")
    first, last = words[0], F.element_at(words, -1)
    forms = F.explode(F.array_distinct(F.array(F.col("speaker"), first, last, F.concat_ws(" ", F.left(first, F.lit(1)), last), F.concat_ws(" ", last, first))))
    out = people.where("not startswith(speaker, '#')").select("source_id", "speaker", forms.alias("form"))
    return out.groupBy("source_id", "form").agg(F.min("speaker").alias("speaker"), F.max("speaker").alias("other")).select("source_id", "form", F.when(F.col("speaker") == F.col("other"), F.col("speaker")).otherwise(F.col("form")).alias("speaker"))


def _overlapping(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """``source_id, pos, block, heard``: the person whose turns, overlaps among themselves counted once, cover most of a segment."""
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET_S), F.floor(F.col(b) / BUCKET_S)))
    finite = "start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s) and abs(start_s) < 1e9 and abs(end_s) < 1e9 and end_s > start_s"
    seg = segments.where(finite).select("source_id", "pos", "block", F.col("start_s").alias("a"), F.col("end_s").alias("b"), buckets("start_s", "end_s").alias("bucket"))
    said = turns.where(finite).select("source_id", "speaker", "start_s", "end_s").distinct()
    said = said.select("source_id", "speaker", F.col("start_s").alias("c"), F.col("end_s").alias("d"), buckets("start_s", "end_s").alias("bucket"))
    low = F.greatest("a", "c", F.col("bucket") * BUCKET_S)
    high = F.least("b", "d", (F.col("bucket") + 1) * BUCKET_S)
    both = seg.join(said, ["source_id", "bucket"]).select("source_id", "pos", "block", "bucket", "speaker", low.alias("low"), high.alias("high")).where("high > low")
    # length of the union: in order of start, what lies past the farthest end so far
    run = Window.partitionBy("source_id", "pos", "bucket", "speaker").orderBy("low", "high")
    far = F.max("high").over(run.rowsBetween(Window.unboundedPreceding, -1))
    new = both.select("source_id", "pos", "block", "speaker", F.greatest(F.lit(0.0), F.col("high") - F.greatest("low", F.coalesce(far, "low"))).alias("s"))
    total = new.groupBy("source_id", "pos", "block", "speaker").agg(F.round(F.sum("s"), 6).alias("s"))
    return total.where("s > 0").groupBy("source_id", "pos", "block").agg(F.min(F.struct((-F.col("s")).alias("s"), "speaker"))["speaker"].alias("heard"))


def _flags(text: str | None) -> tuple[str | None, bool, bool]:
    form, rest, whole = parse(text, brief=True)
    return form, bool(rest), bool(whole)


def _parsed(df: DataFrame, text: bool) -> DataFrame:
    """Slim rows of segments: what is said is a flag unless ``text``."""
    said = pa.string() if text else pa.bool_()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not text:  # of plain lines a first word tells all
                plain = [t is not None and t.isascii() and "&" not in t and not _SPECIAL.search(t) for t in texts]
                parsed = [(None, True, True) if p and next(_words(t), None) else (None, False, False) if p else _flags(t) for p, t in zip(plain, texts, strict=True)]
            else:
                parsed = map(parse, texts)
            form, rest, whole = zip(*parsed, strict=True) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(form, pa.string()), pa.array(list(rest), said), pa.array(list(whole), said)], [*kept, "form", "rest", "whole"])

    kept = ["source_id", "part", "pos", "start_s", "end_s", "landed_at"]
    cols = df.select("source_id", F.floor(F.col("pos") / BLOCK_POS).alias("part"), F.col("pos").cast("bigint"), F.col("start_s").cast("double"), F.col("end_s").cast("double"), "landed_at", "text")
    kind = "string" if text else "boolean"
    return cols.mapInArrow(run, f"source_id string, part bigint, pos bigint, start_s double, end_s double, landed_at {df.schema['landed_at'].dataType.simpleString()}, form string, rest {kind}, whole {kind}")


def _groups(keys: list[str], work: Callable[[pa.Table, bool], Iterator[pa.RecordBatch]], slim: Callable[[pa.Table], pa.Table] | None = None):
    """For mapInArrow over rows sorted by ``keys``: ``work(table, whole)`` gets whole groups, many at a time, or, with whole
    false, a part of one that is larger than HOLD and goes on. slim: what to make of rows before they are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None or not held.num_rows else pa.concat_tables([held, table])
            if slim:
                table = slim(table)
            codes = [table.column(k) for k in keys]
            n = cut = table.num_rows
            ends = [c[n - 1].as_py() for c in codes] if n else []
            while cut and all(c[cut - 1].as_py() == e for c, e in zip(codes, ends, strict=True)):
                cut = _step_back(codes, ends, cut)
            if cut:
                yield from work(table.slice(0, cut), True)
            held = table.slice(cut)
            if held.num_rows > HOLD:
                yield from work(held.slice(0, held.num_rows - 1), False)  # the last row tells whether the group goes on
                held = held.slice(held.num_rows - 1)
        if held is not None and held.num_rows:
            yield from work(held, True)

    return run


def _step_back(codes: list[pa.ChunkedArray], ends: list, cut: int) -> int:
    """Where the group that ends at ``cut`` begins, at least one row back: by halves, as rows are sorted."""
    low, high = 0, cut - 1
    while low < high:
        mid = (low + high) // 2
        if all(c[mid].as_py() == e for c, e in zip(codes, ends, strict=True)):
            high = mid
        else:
            low = mid + 1
    return low


def _code(col: pa.ChunkedArray) -> np.ndarray:
    """Numbers of a string column's values; equal for equal ones."""
    enc = col.combine_chunks().dictionary_encode()
    enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
    return enc.indices.to_numpy(zero_copy_only=False)


def _latest(table: pa.Table) -> pa.Table:
    """Of rows sorted by source, position and landing the last of each position."""
    if table.num_rows < 2:
        return table
    src, pos = _code(table.column("source_id")), table.column("pos").to_numpy()
    last = np.append((src[1:] != src[:-1]) | (pos[1:] != pos[:-1]), True)
    return table if last.all() else table.filter(pa.array(last))


def hung(start: np.ndarray, cue: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Conflicts resolved among rows in order of position: the time each row hangs on, whether the edge from the row before
    holds, and what an undated row still waits for (1 a dated row before its group, 2 one after it).

    start: NaN for undated rows; cue: rows that only name a speaker; group: ascending numbers of blocks. Between dated
    rows a < b an undated run closes a cycle if b is the earlier one. Its lightest edges are dialogue edges, so the
    last of them goes, which is the one before the cues that lead to b. The run's head follows a, these cues go with b.
    """
    n = len(start)
    at = np.arange(n)
    dated = start == start
    opens = np.append(True, group[1:] != group[:-1]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(opens, at, 0)) if n else at
    closes = np.append(opens[1:], True) if n else opens
    last = np.minimum.accumulate(np.where(closes, at, n)[::-1])[::-1] if n else at
    before = np.maximum.accumulate(np.where(dated, at, -1)) if n else at
    after = np.minimum.accumulate(np.where(dated, at, n)[::-1])[::-1] if n else at
    firm = np.minimum.accumulate(np.where(dated | ~cue, at, n)[::-1])[::-1] if n else at  # the next row that is no undated cue
    has_a, has_b = before >= first, after <= last
    to_b = ~dated & cue & ((firm > last) | has_b & (firm == after))  # only cues up to b; past the block's end b is not known yet
    hang = start.copy()
    free = ~dated
    use_b = free & has_b & (to_b | ~has_a)
    use_a = free & ~use_b & has_a
    hang[use_b] = start[after[use_b]]
    hang[use_a] = start[before[use_a]]
    waits = np.where(free & to_b & ~has_b, 2, np.where(free & ~has_a & ~use_b, 1, 0))
    waits[free & ~to_b & ~has_a & has_b] = 1  # hangs on b for now; a dated row before the block goes first
    holds = ~opens
    late = np.flatnonzero(holds[1:] & (hang[:-1] > hang[1:])) + 1
    holds[late] = False
    return hang, holds, waits


def _placed(rows: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    src, part = _code(rows.column("source_id")), rows.column("part").to_numpy()
    group = np.cumsum(np.append(True, (src[1:] != src[:-1]) | (part[1:] != part[:-1])))
    start = np.array(rows.column("start_s").to_numpy(zero_copy_only=False), np.float64)
    start[~(np.abs(start) < 1e9)] = np.nan
    named = rows.column("form").is_valid().to_numpy(zero_copy_only=False)
    said = rows.column("rest")
    said = said.to_numpy(zero_copy_only=False).astype(bool)
    hang, holds, waits = hung(start, named & ~said, group)
    pos = rows.column("pos").to_numpy()
    back = np.where(holds, pos - np.append(0, pos[:-1]), 0)  # how far back the row is whose edge holds; small, as times of dated rows are left out
    hang[start == start] = np.nan
    out = {c: rows.column(c).combine_chunks() for c in ("source_id", "part", "pos")}
    out |= {"start_s": pa.array(start, pa.float64(), mask=np.isnan(start))}
    out |= {c: rows.column(c).combine_chunks() for c in ("end_s", "form", "rest", "whole")}
    out |= {"hang_s": pa.array(hang, pa.float64(), mask=np.isnan(hang)), "back": pa.array(back, pa.int64()), "waits": pa.array(waits, pa.int32())}
    yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _segments(segments: DataFrame, text: bool) -> DataFrame:
    """One row per (source, position), the one that landed last, with its constraints by position. Written, as it is read
    several times."""
    keys = ["source_id", "part", "pos"]
    rows = _parsed(segments.where("source_id is not null and pos is not null"), text)
    rows = rows.repartition("source_id", "part").sortWithinPartitions(*keys, "landed_at", "start_s", "end_s", "form", "rest", "whole")
    kind = rows.schema["rest"].dataType.simpleString()
    schema = f"source_id string, part bigint, pos bigint, start_s double, end_s double, form string, rest {kind}, whole {kind}, hang_s double, back bigint, waits int"
    rows = settle(rows.mapInArrow(_groups(["source_id", "part"], _placed, _latest), schema), "segments")
    waiting = rows.where("waits > 0")
    if waiting.isEmpty():
        return rows.drop("waits")
    # what undated rows at the ends of blocks hang on comes from one row per block
    edge = rows.where("start_s is not null").groupBy("source_id", "part").agg(F.min_by("start_s", "pos").alias("one"), F.min("pos").alias("at"), F.max_by("start_s", "pos").alias("two"))
    edge = waiting.select("source_id", "part").distinct().join(edge, ["source_id", "part"], "full")
    over = Window.partitionBy("source_id").orderBy("part")
    edge = edge.select("source_id", "part", F.last("two", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("a"), F.first("one", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("b"))
    late = waiting.join(edge, ["source_id", "part"], "left")
    hang = F.when(F.col("waits") == 2, F.coalesce("b", "hang_s", "a")).otherwise(F.coalesce("a", "hang_s", "b"))
    late = late.withColumn("hang_s", hang).select(*rows.columns)
    return settle(rows.where("waits = 0").unionByName(late), "hung").drop("waits")


def topological(hang: np.ndarray, pos: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Order of rows: their numbers one after another. Edges: timing, between neighbours in time; and from the row at position
    ``prior`` (negative for none), which holds unless it would close a cycle with timing. Free rows come by time, then position;
    rows of no time (NaN) hang on their edges alone and come last else."""
    n = len(hang)
    late = np.where(hang == hang, hang, np.inf)
    by_time = np.lexsort((pos, late))
    place = np.empty(n, np.int64)
    place[by_time] = np.arange(n)
    by_pos = np.argsort(pos, kind="stable")
    at = np.minimum(np.searchsorted(pos[by_pos], prior), max(n - 1, 0))
    tail = np.flatnonzero((prior >= 0) & (pos[by_pos[at]] == prior)) if n else by_time
    head = by_pos[at[tail]]
    if (place[head] < place[tail]).all():
        return by_time  # it meets all edges, so it is the first topological order
    after: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n
    level = np.unique(late, return_inverse=True)[1]
    dated = np.isfinite(late)
    gates = int(level.max()) + 1  # between two moments stands a gate that all rows of the first open
    after += [[] for _ in range(gates)]
    waits += [0] * gates
    reach = np.where(dated, level, -1)  # the latest moment a row comes after by its edges
    when = late.copy()

    def edge(a: int, b: int) -> None:
        after[a].append(b)
        waits[b] += 1

    for i in np.flatnonzero(dated).tolist():
        edge(i, n + int(level[i]))
        if level[i]:
            edge(n + int(level[i]) - 1, i)
    for k in np.argsort(pos[tail], kind="stable").tolist():
        h, t = int(head[k]), int(tail[k])
        if dated[t] and reach[h] > level[t]:
            continue  # a cycle with timing
        edge(h, t)
        if not dated[t]:
            reach[t], when[t] = reach[h], when[h]
    first = np.full(gates, np.inf)
    np.minimum.at(first, level, late)
    key = [(float(when[i]), int(pos[i]), i) for i in range(n)] + [(float(first[g]), 1 << 62, n + g) for g in range(gates)]
    free = [key[i] for i in range(n + gates) if not waits[i]]
    heapq.heapify(free)
    out = []
    while free:
        *_, i = heapq.heappop(free)
        if i < n:
            out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(free, key[j])
    return np.array(out, np.int64)


def merged(c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of disjoint spans that cover the same time."""
    order = np.argsort(c, kind="stable")
    c, far = c[order], np.maximum.accumulate(d[order])
    new = np.append(True, c[1:] > far[:-1])
    at = np.flatnonzero(new)
    return c[at], far[np.append(at[1:] - 1, len(c) - 1)]


def covered(c: np.ndarray, d: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Time up to each t that the disjoint spans cover."""
    at = np.searchsorted(c, t, side="right") - 1
    upto = np.concatenate([[0.0], np.cumsum(d - c)])
    return np.where(at < 0, 0.0, upto[at] + np.minimum(t, d[at]) - c[at])


def longest(spans: dict[str, tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> list[str | None]:
    """The speaker whose spans cover most of each a..b, of equals the first by name; None where nobody speaks."""
    best, who = np.zeros(len(a)), np.full(len(a), -1)
    names = sorted(spans)
    for k, name in enumerate(names):
        s = np.round(covered(*spans[name], b) - covered(*spans[name], a), 6)
        more = s > best
        best[more], who[more] = s[more], k
    return [names[k] if k >= 0 else None for k in who.tolist()]


#: How a row opens a turn: no, yes, if its speaker isn't the last one before the block, or isn't the one the block inherits.
NO, YES, FIRST, SECOND = 0, 1, 2, 3


class _Mode:
    """Who holds the word, row by row, in one of two ways: by labels, or by what is heard. A value of None is inherited."""

    def __init__(self):
        self.now: str | None = None
        self.last: tuple[str | None] | None = None

    def step(self, value: str | None, said: bool) -> int:
        if value is not None:
            self.now = value
        if not said:
            return NO
        before, self.last = self.last, (self.now,)
        if before is None:
            return FIRST
        if before[0] == self.now:
            return NO
        return SECOND if before[0] is None else YES

    def ends(self) -> int:
        return NO if self.last is None else YES if self.last[0] is None else FIRST


TURN, NOTE, SEGMENT = 0, 1, 2
_OUT = "source_id string, block bigint, row boolean, rank bigint, opens_l int, by_label string, opens_b int, by_ear string, said_l string, said_b string, pos bigint, start_s double, end_s double"


def _spoken(text: bool) -> Callable[[pa.Table, bool], Iterator[pa.RecordBatch]]:
    """Works off blocks of time with their rows of turns, of notes (who is heard in a segment that reaches past its block) and
    of segments. Gives a row for each segment that is said (without ``text`` only where the speaker may change) and one for each
    block (``row`` false): who holds the word at its end, and whether its last said segment inherits its speaker (YES), has
    its own (FIRST) or isn't there (NO)."""
    state: list = []  # of a block that goes on: its key, both modes, spans of its speakers, notes, rank

    def work(table: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        src, block = _code(table.column("source_id")), table.column("block").to_numpy()
        ids = table.column("source_id")
        starts = np.flatnonzero(np.append(True, (src[1:] != src[:-1]) | (block[1:] != block[:-1])))
        kind = table.column("kind").to_numpy()
        start, end, hang = (np.array(table.column(c).to_numpy(zero_copy_only=False), np.float64) for c in ("start_s", "end_s", "hang_s"))
        hang = np.where(np.isnan(start), hang, start)
        pos, back = table.column("pos").to_numpy(), table.column("back").fill_null(0).to_numpy()
        prior = np.where(back > 0, pos - back, -1)
        name, is_said = table.column("name").to_pylist(), table.column("is_said").to_pylist()
        out: list[tuple] = []
        at: list[int] = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(src)], strict=True):
            key = (ids[lo].as_py(), int(block[lo]))
            if state and state[0] == key:
                _, label, bare, spans, notes, rank = state
            else:
                label, bare, spans, notes, rank = _Mode(), _Mode(), {}, {}, 0
            low, mid = (lo + int(np.searchsorted(kind[lo:hi], k)) for k in (NOTE, SEGMENT))
            by: dict[str, list[int]] = {}
            for i in range(lo, low):
                by.setdefault(name[i], []).append(i)
            for who, own in by.items():
                old = spans.get(who, (start[:0], end[:0]))
                spans[who] = merged(np.concatenate([old[0], start[own]]), np.concatenate([old[1], end[own]]))
            notes |= {int(pos[i]): name[i] for i in range(low, mid)}
            heard: list[str | None] = [notes.get(p) for p in pos[mid:hi].tolist()] if notes else [None] * (hi - mid)
            if spans:
                inside = np.flatnonzero((end[mid:hi] > start[mid:hi]) & (np.floor(end[mid:hi] / BLOCK_S) == key[1]))
                for i, who in zip(inside.tolist(), longest(spans, start[mid + inside], end[mid + inside]), strict=True):
                    heard[i] = who
            for i in topological(hang[mid:hi], pos[mid:hi], prior[mid:hi]).tolist():
                said = is_said[mid + i]
                one = label.step(name[mid + i], said)
                two = bare.step(heard[i] if said else None, said)
                if said and (text or one or two):
                    # of a turn that opens for certain the speaker is wanted with the text only
                    out.append((*key, True, rank, one, label.now if text or one != YES else None, two, bare.now if text or two != YES else None, None, None))
                    at.append(mid + i)
                rank += 1
            state[:] = [key, label, bare, spans, notes, rank]
            if whole or hi < len(src):
                out.append((*key, False, rank, label.ends(), label.now, bare.ends(), bare.now, label.last and label.last[0], bare.last and bare.last[0]))
                at.append(lo)
        cols = list(zip(*out, strict=True)) if out else [()] * 10
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        kept, took = ["pos", "start_s", "end_s", *(["text"] if text else [])], pa.array(at, pa.int64())
        names = [c.split()[0] for c in _OUT.split(", ")] + (["text"] if text else [])
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *(_one(table.column(c)).take(took) for c in kept)], names)

    return work


def _one(col: pa.ChunkedArray) -> pa.Array:
    col = col.combine_chunks()
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _names(seg: DataFrame, heard: DataFrame) -> DataFrame:
    """``source_id, form, speaker``: who each written form of a label means, forms that mean nobody left out."""
    labels = settle(seg.where("form is not null").groupBy("source_id", "form").agg(F.count("*").alias("n")), "labels")
    is_full = "form like '% %' and not startswith(form, '?') and length(split(form, ' ')[0]) > 1"
    full = labels.where(is_full).select("source_id", F.col("form").alias("speaker"), "n")
    known = settle(heard.select("source_id", "speaker").distinct(), "known")
    turned = known.select("source_id", F.concat_ws(" ", F.expr("substring_index(speaker, ' ', -1)"), F.expr("substring_index(speaker, ' ', 1)")).alias("speaker"))
    # "Breaking News:" may be no name: words that no turn knows count only if they label several segments, if the source has
    # another label, or if its labels use either word alone
    parts = labels.where("form not like '% %'").select("source_id", "form")
    strange = full.join(known.unionByName(turned).distinct(), ["source_id", "speaker"], "left_anti")
    sure = labels.where(f"startswith(form, '#') or startswith(form, '?') or {is_full}").select("source_id", "form")
    sure = sure.unionByName(parts.join(_forms(known), ["source_id", "form"], "left_semi")).groupBy("source_id").agg(F.countDistinct("form").alias("forms"))
    words = strange.select("source_id", "speaker", F.explode(F.split("speaker", " ")).alias("form"))
    alone = words.join(parts, ["source_id", "form"], "left_semi").select("source_id", "speaker")
    strange = strange.join(sure, "source_id").where("n > 1 or forms > 1").select("source_id", "speaker").unionByName(alone).distinct()
    return _forms(known.unionByName(strange))


def _worked(segments: DataFrame, turns: DataFrame, text: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`_spoken` and, by source and block, what each block inherits."""
    seg = _segments(segments, text).drop("part")
    heard = turns.select("source_id", person_of(F.col("speaker")).alias("speaker"), F.col("start_s").cast("double"), F.col("end_s").cast("double")).where("source_id is not null and speaker is not null")
    heard = settle(heard, "heard")
    plain = seg
    # only segments with a form, a few, meet the names
    named = seg.where("form is not null").join(_names(seg, heard), ["source_id", "form"], "left").select(*seg.columns, "speaker")
    seg = named.unionByName(seg.where("form is null").withColumn("speaker", F.lit(None).cast("string")))
    label = F.when(F.col("form").startswith("#") | F.col("form").startswith("?"), F.col("form")).otherwise(F.col("speaker"))
    said = F.when(label.isNotNull(), F.col("rest")).otherwise(F.col("whole"))
    # segments of no time at all follow in blocks of positions
    block = F.coalesce(F.floor(F.coalesce("start_s", "hang_s") / BLOCK_S), F.lit(1 << 40) + F.floor(F.col("pos") / blocks.SIZE)).alias("block")
    kind = lambda n: F.lit(n).cast("tinyint").alias("kind")
    rows = seg.select("source_id", block, kind(SEGMENT), "hang_s", "pos", "start_s", "end_s", "back", label.alias("name"), (said != "" if text else said).alias("is_said"), *([said.alias("text")] if text else []))
    # a segment that reaches past its block meets turns of several; the few there are meet them beforehand
    far = plain.select("*", block).where(f"start_s is not null and end_s > start_s and not isnan(end_s) and abs(end_s) < 1e9 and floor(end_s / {BLOCK_S}) <> block")
    notes = _overlapping(far, heard).select("source_id", "block", kind(NOTE), "pos", F.col("heard").alias("name"))
    finite = "start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s) and abs(start_s) < 1e9 and abs(end_s) < 1e9 and end_s > start_s"
    spans = heard.where(finite).select("source_id", F.explode(F.sequence(F.floor(F.col("start_s") / BLOCK_S), F.floor(F.col("end_s") / BLOCK_S))).alias("block"), kind(TURN), "start_s", "end_s", F.lit(-1).cast("bigint").alias("pos"), F.col("speaker").alias("name"))
    both = rows.unionByName(notes, allowMissingColumns=True).unionByName(spans, allowMissingColumns=True)
    both = both.repartition("source_id", "block").sortWithinPartitions("source_id", "block", "kind", F.coalesce("start_s", "hang_s"), "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _groups(["source_id", "block"], _spoken(text))(batches)

    out = settle(both.mapInArrow(run, _OUT + (", text string" if text else "")), "spoken")
    ends = out.where("not row").select("source_id", "block", "opens_l", "by_label", "opens_b", "by_ear", "said_l", "said_b")
    ends = ends.withColumn("has_any", F.max(F.col("by_label").isNotNull()).over(Window.partitionBy("source_id")))
    pick = lambda a, b: F.when(F.col("has_any"), F.col(a)).otherwise(F.col(b))
    over = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # what is said before the first label belongs to a speaker of its own
    first = F.when(F.col("has_any"), "?").otherwise("")
    ends = ends.withColumn("inherited", F.coalesce(F.last(pick("by_label", "by_ear"), ignorenulls=True).over(over), first))
    code = pick("opens_l", "opens_b")
    ends = ends.withColumn("last", F.when(code == YES, F.col("inherited")).when(code == FIRST, pick("said_l", "said_b")))
    return out.where("row"), ends.select("source_id", "block", "has_any", "inherited", F.last("last", ignorenulls=True).over(over).alias("previous"))


def _opening(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with ``speaker`` and ``opens``."""
    out = rows.join(ends, ["source_id", "block"])
    code = F.when(F.col("has_any"), F.col("opens_l")).otherwise(F.col("opens_b"))
    speaker = F.coalesce(F.when(F.col("has_any"), F.col("by_label")).otherwise(F.col("by_ear")), "inherited")
    opens = F.when(code == FIRST, F.col("previous").isNull() | (F.col("previous") != speaker)).when(code == SECOND, speaker != F.col("inherited")).otherwise(code == YES)
    return out.withColumn("speaker", speaker).withColumn("opens", opens)


def openings(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """``source_id, pos`` of the segments that open a turn; arguments and rules as in :func:`with_turns`. Only segments where the
    speaker may change are shuffled a third time, and no text is."""
    pos = segments.schema["pos"].dataType
    return _opening(*_worked(segments, turns, False)).where("opens").select("source_id", F.col("pos").cast(pos))


def with_turns(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Spoken segments in order with their speakers: ``source_id, pos, block, rank, start_s, end_s, speaker, opens, text``.

    segments: source_id, pos, text, start_s, end_s, landed_at; of repeated rows the one that landed last
    counts. turns: source_id, speaker, start_s, end_s. A label holds until the next one. In a source whose
    segments carry no labels the speaker is the one whose turns overlap a segment longest, and a segment no
    turn overlaps goes on with the speaker before; where there is neither, speaker is null and the source
    has one turn. ``opens`` is true for the first spoken segment of a source and wherever the speaker changes.
    Segments without a start (null, NaN, infinite) stand between their neighbours by position, in sources without any
    start all do. Null texts are not spoken; rows without source or position are dropped.
    """
    pos = segments.schema["pos"].dataType
    out = _opening(*_worked(segments, turns, True))
    name = F.when(~F.col("speaker").isin("?", ""), F.col("speaker"))
    return out.select("source_id", F.col("pos").cast(pos), "block", "rank", "start_s", "end_s", name.alias("speaker"), "opens", "text")


def conflicts(segments: DataFrame) -> DataFrame:
    """``source_id, kept, dropped``: dialogue and cue edges of each source that hold, and those that gave way to timing."""
    seg = _segments(segments, False)
    first = F.col("back") == 0
    over = Window.partitionBy("source_id", "part").orderBy("pos")
    edge = seg.select("source_id", first.alias("cut"), (F.row_number().over(over) > 1).alias("inner"))
    return edge.groupBy("source_id").agg(F.count_if(~F.col("cut")).alias("kept"), F.count_if(F.col("cut") & F.col("inner")).alias("dropped"))


def numbered(said: DataFrame) -> DataFrame:
    """``said`` of :func:`with_turns` with ``turn_no``, from 1, summed over the blocks before and the rows in the block."""
    over = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = said.groupBy("source_id", "block").agg(F.sum(F.col("opens").cast("int")).alias("n")).select("source_id", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("start"))
    here = Window.partitionBy("source_id", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return said.join(counts, ["source_id", "block"]).withColumn("turn_no", F.col("start") + F.sum(F.col("opens").cast("int")).over(here)).drop("start")

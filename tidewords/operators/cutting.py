"""Paragraphs from caption lines and clips from words.

Both cutters have one shape: hard breaks at long pauses make runs; runs are cut to a budget at the best
boundary; a tiny rest at the end goes back into its neighbour. What a boundary is worth is a column
expression over a row and its successor, so all scoring is on the JVM; Python only goes along the numbers,
run by run (:func:`blocks.along`), and holds no more of a run than what later rows may change: a run without end streams
through one task. The ends of sources are repaired by two aggregates and one more fold over the last two pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions import text as tx
from tidewords.operators import blocks
from tidewords.session import settle

# Weights of a boundary; a second of pause is the currency.
GAP, SENTENCE, ELLIPSIS, CLAUSE = 3.0, 2.0, 1.0, 0.6
DANGLING, MARKER, WEAK_MARKER, CONTINUATION = 2.5, 0.8, 0.4, 1.0
BALANCE, TARGET, LONG_PAUSE, LEAST_PAUSE_S = 0.8, 0.45, 2.0, 0.5
REBALANCE = 2.0


def latest(df: DataFrame, keys: list[str], by: str | None) -> DataFrame:
    """One row per key: the one that landed last; without ``by`` any, as repeated rows are equal."""
    rest = [c for c in df.columns if c not in keys]
    first = ([by] if by else []) + [c for c in rest if c != by]
    return df.groupBy(*keys).agg(F.max(F.struct(*first)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


# --- what a boundary is worth -------------------------------------------------------------------


def closing(last: Column, sentence: Column, clause: Column, ellipsis: Column | None = None) -> Column:
    """Worth of the ending of a text before a boundary, in points without the pause. last: its last word, bare."""
    hanging = last.isin(*tx.DANGLING) | last.rlike(r"(n['\x{2019}]t|['\x{2019}](s|re|m|ve|ll|d))$")
    plain = F.when(last == "", 0.0).when(hanging, -DANGLING).when(last.rlike(r"\p{Nd}"), -DANGLING / 2).otherwise(0.0)
    out = F.when(sentence, SENTENCE).when(clause, CLAUSE).otherwise(plain)
    return out if ellipsis is None else F.when(ellipsis, ELLIPSIS).otherwise(out)


def opening(head: Column, ended: Column) -> Column:
    """Worth of the opening of the text after a boundary. head: its first word that is no hesitation, bare; null is worth nothing."""
    out = F.when(head.isin(*tx.STRONG_MARKERS), MARKER).when(head.isin(*tx.WEAK_MARKERS), WEAK_MARKER)
    return F.coalesce(out.when(head.isin(*tx.DANGLING) & ~ended, -CONTINUATION), F.lit(0.0))


# --- folds ----------------------------------------------------------------------------------------


def best(at: np.ndarray, worth: np.ndarray) -> int:
    """The place of highest worth; of equals the last."""
    return int(at[len(at) - 1 - int(np.argmax(worth[::-1]))])


def halve(worth: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, half: float, floor: float) -> int:
    """Where to cut one range in two: after which of its places but the last. left, right: sizes of the sides."""
    at = np.arange(len(left))
    good = (left >= least) & (right >= least)
    pool = at[good] if good.any() else at
    return best(pool, worth[pool] - REBALANCE * np.abs(left[pool] - half) / max(half, floor))


def cut_by_words(words: np.ndarray, worth: np.ndarray, least: int, most: int, whole: bool = True) -> list[int]:
    """Ends (exclusive) of the groups of one run of lines; of a run that goes on (``whole`` false) only of groups that stay."""
    total, score = np.cumsum(words), np.asarray(worth)
    target = least + TARGET * (most - least)
    ends, i, n = [], 0, len(words)
    while i < n:
        base = total[i - 1] if i else 0
        over = int(np.searchsorted(total, base + most))
        while over < n and over < i:
            over += 1
        if over >= n:
            if whole:
                ends.append(n)
            break
        at = np.arange(i, over + 1)
        size = total[at] - base
        at, size = at[(size >= least) & (size <= most)], size[(size >= least) & (size <= most)]
        cut = best(at, score[at] - BALANCE * np.abs(size - target) / target) if len(at) else over
        i = cut + 1
        ends.append(i)
    if not whole:
        return ends[:-1]  # the last one may have to take in a tail
    if len(ends) > 1:
        a = ends[-3] if len(ends) > 2 else 0
        base = total[a - 1] if a else 0
        if total[-1] - total[ends[-2] - 1] < least:
            if total[-1] - base <= most:
                del ends[-2]
            else:
                left = total[a : n - 1] - base
                ends[-2] = a + 1 + halve(score[a : n - 1], left, total[-1] - base - left, least, (total[-1] - base) / 2, 1.0)
    return ends


def cut_by_time(start: np.ndarray, end: np.ndarray, worth: np.ndarray, least: float, most: float, target: float, whole: bool = True) -> list[int]:
    """Ends (exclusive) of the clips of one run of words; sizes are extents, from the least start to the largest end. Of a run that
    goes on (``whole`` false) only of clips that stay."""
    a, b, score = np.asarray(start), np.asarray(end), np.asarray(worth)
    ends, i, n = [], 0, len(a)
    while i < n:
        size = np.zeros(0)
        stop = i
        while True:  # the extent only grows, so a stretch is looked at until it passes the limit
            stop = min(n, max(stop * 2 - i, i + 64))
            size = np.maximum.accumulate(b[i:stop]) - np.minimum.accumulate(a[i:stop])
            if stop == n or size[-1] >= most:
                break
        over = int(np.searchsorted(size, most))
        if over == len(size):
            if whole:
                ends.append(n)
            break
        if not whole and i + over == n - 1:
            break  # whether a word follows is not known yet
        at = np.arange(over + 1)
        at = at[(size[at] >= least) & (size[at] <= most) & (at + i < n - 1)]
        if len(at):
            cut = best(at, score[at + i] - BALANCE * np.abs(size[at] - target) / max(most - least, 1e-9))
        else:
            cut = max(over - 1, 0)
        i += cut + 1
        ends.append(i)
    return ends


# --- the last two pieces of a source ---------------------------------------------------------------


def _last_two(pieces: DataFrame) -> DataFrame:
    """``source_id``, the struct ``tail`` of the last piece and ``body`` of the one before it."""
    row = F.struct("first_pos", *[c for c in pieces.columns if c not in ("source_id", "first_pos")])
    tail = pieces.groupBy("source_id").agg(F.max(row).alias("tail"))
    rest = blocks.lookup(pieces, tail.select("source_id", F.col("tail.first_pos").alias("__t")), ["source_id"], ["first_pos"], "inner").where("first_pos < __t")
    return tail.join(rest.groupBy("source_id").agg(F.max(row).alias("body")), "source_id")


def _repaired(placed: DataFrame, ends: DataFrame, fn) -> DataFrame:
    """``placed`` with ``piece``, the first position of each row's piece, after the tails are repaired.

    ends: sources whose tail goes back, with ``a`` and ``t``, the first positions of the piece before it and of the tail, and
    ``whole``, whether one piece holds both. fn folds over the rows of the two and gives the cut. Rows meet it by source and
    piece, of which there are two a source.
    """
    cols = placed.columns
    ends = settle(ends.select("source_id", "a", F.explode(F.array("a", "t")).alias("piece"), "whole"), "ends")
    two = placed.join(ends.where("not whole").select("source_id", "piece"), ["source_id", "piece"], "left_semi")
    cut = blocks.fold(two, ["source_id"], ["pos"], fn, "source_id string, cut bigint")
    placed = placed.join(ends.join(cut, "source_id", "left"), ["source_id", "piece"], "left")
    piece = F.when(F.col("whole"), F.col("a")).when(F.col("cut").isNotNull(), F.when(F.col("pos") < F.col("cut"), F.col("a")).otherwise(F.col("cut"))).otherwise(F.col("piece"))
    return placed.withColumn("piece", piece.cast("bigint")).select(*cols)


def _placed(rows: DataFrame, numbers: list[str], fn) -> DataFrame:
    """``rows`` with ``piece``, the first position of the piece that ``fn``, going along ``numbers``, puts each row in."""
    return settle(blocks.along(rows, ["source_id", "run_no"], ["pos"], ["pos", *numbers], fn, "piece"), "placed")


def _first(pos: np.ndarray, ends: list[int]) -> np.ndarray:
    starts = np.array([0, *ends[:-1]], np.int64)[: len(ends)]
    return np.repeat(pos[starts], np.diff([0, *ends]))


# --- paragraphs --------------------------------------------------------------------------------


def with_gaps(segments: DataFrame) -> DataFrame:
    """Lines with ``gap_ms``, from a line's end to the next line's start, and ``pause_ms``, the same less the usual overlap.

    Rolling captions overlap all the time; where the median gap of a source is negative it is the zero of its
    pauses. Pauses are never negative; the last line of a source has nulls. Of repeated rows the one that
    landed last counts; rows without source or position are dropped, null times give null gaps.
    """
    return _gapped(segments).drop(blocks.BLOCK)


def _gapped(segments: DataFrame) -> DataFrame:
    """:func:`with_gaps` with the blocks that its rows lie in."""
    seg = segments.where("source_id is not null and pos is not null").select("source_id", F.col("pos").cast("bigint").alias("pos"), "text", F.round(F.col("start_s") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("end_s") * 1000).cast("bigint").alias("end_ms"), "landed_at")
    seg = blocks.latest(seg, ["source_id"], "pos", "landed_at").drop("landed_at")
    seg = blocks.neighbours(seg, ["source_id"], "pos", ["start_ms", "text"], keep=True).drop("prev")
    seg = seg.withColumn("gap_ms", F.col("next.start_ms") - F.col("end_ms"))
    base = seg.groupBy("source_id").agg(F.least(F.lit(0.0), F.median("gap_ms")).alias("base"))
    return blocks.lookup(seg, base, ["source_id"], ["pos"], "inner").withColumn("pause_ms", F.greatest(F.lit(0.0), F.col("gap_ms") - F.col("base"))).drop("base")


def break_scores(gapped: DataFrame) -> DataFrame:
    """``gapped`` of :func:`with_gaps` with ``n_words`` and ``score``, the worth of a break after each line."""
    raw = F.coalesce("text", F.lit(""))
    # each of these is used several times; as columns they are computed once
    df = gapped.withColumns({"__last": tx.bare(tx.last_word(raw)), "__head": tx.first_word(F.col("next.text")), "__soft": tx.ends_ellipsis(raw), "__mark": tx.ends_sentence_mark(raw), "__clause": tx.ends_clause_mark(raw)})
    df = df.withColumn("__full", F.col("__mark") & ~tx.is_abbreviation(F.col("__last")))
    worth = closing(F.col("__last"), F.col("__full"), F.col("__mark") | F.col("__clause"), F.col("__soft")) + opening(F.col("__head"), F.col("__full") & ~F.col("__soft"))
    kept = [c for c in (blocks.BLOCK,) if c in df.columns]
    return df.select("source_id", "pos", *kept, "text", "start_ms", "end_ms", "pause_ms", tx.word_count(F.col("text")).cast("bigint").alias("n_words"), (GAP * F.coalesce(F.col("pause_ms") / 1000, F.lit(0.0)) + worth).alias("score"))


def with_runs(rows: DataFrame, pause: Column) -> DataFrame:
    """Rows with ``run_no``, from 0: a new run begins after every row with ``pause``."""
    rows = rows.withColumn("__p", F.coalesce(pause, F.lit(False)).cast("bigint"))
    return blocks.running(rows, ["source_id"], "pos", F.col("__p"), "run_no").withColumn("run_no", F.col("run_no") - F.col("__p")).drop("__p")


def paragraphs(segments: DataFrame, *, pause_s: float = 2.0, least: int = 40, most: int = 120) -> DataFrame:
    """``source_id, para_no, text, start_ms, end_ms, n_words`` of readable paragraphs.

    Breaks lie at pauses of more than ``pause_s`` and else where the budget of ``least`` to ``most`` words allows
    and the score is best. All words come out once and in order; paragraphs of blank lines only vanish.
    """
    least = max(1, least)
    most, pause_ms = max(least, most), 1000 * max(pause_s, LEAST_PAUSE_S)
    rows = with_runs(break_scores(_gapped(segments)), F.col("pause_ms") > pause_ms)
    fn = lambda cols, whole: _first(cols["pos"], cut_by_words(cols["n_words"], cols["score"], least, most, whole))
    placed = _placed(rows, ["n_words", "score"], fn)
    pieces = placed.groupBy("source_id", F.col("piece").alias("first_pos")).agg(F.sum("n_words").alias("size"), F.max_by("pause_ms", "pos").alias("pause_after"))
    two = _last_two(pieces).where((F.col("tail.size") < least) & (F.coalesce("body.pause_after", F.lit(0.0)) <= LONG_PAUSE * pause_ms))
    ends = two.select("source_id", F.col("body.first_pos").alias("a"), F.col("tail.first_pos").alias("t"), (F.col("body.size") + F.col("tail.size") <= most).alias("whole"))

    def again(cols: dict[str, list]) -> dict[str, list]:
        total, score = np.cumsum(cols["n_words"]), np.asarray(cols["score"])
        if len(total) < 2:
            return {"source_id": [], "cut": []}
        left = total[:-1]
        k = halve(score[:-1], left, total[-1] - left, least, total[-1] / 2, 1.0)
        return {"source_id": cols["source_id"][:1], "cut": [cols["pos"][k + 1]]}

    placed = _repaired(placed.select("source_id", "pos", "text", "start_ms", "end_ms", "n_words", "score", "piece"), ends, again)
    said = F.when(tx.word_count(F.col("text")) > 0, F.struct("pos", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]), " ")
    out = placed.groupBy("source_id", "piece").agg(text.alias("text"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.sum("n_words").alias("n_words")).where("n_words > 0")
    return blocks.numbered(out, ["source_id"], "piece", "para_no").select("source_id", "para_no", "text", "start_ms", "end_ms", "n_words")


# --- clips ----------------------------------------------------------------------------------------


def repaired_words(words: DataFrame) -> DataFrame:
    """:func:`_repaired_words` without the blocks that its rows lie in."""
    return _repaired_words(words).drop(blocks.BLOCK)


def _repaired_words(words: DataFrame) -> DataFrame:
    """Words with spans made whole, ``start_ms, end_ms``, the pause after them and whether they end a sentence or clause.

    A start that is null, NaN, infinite or negative is 0, such an end is the start, an end before the start
    is the start. A word that the next one joins ends nothing. Repeated rows count once.
    """
    w = words.where("source_id is not null and pos is not null").select("source_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), "start_s", "end_s", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("joins_left", F.lit(False)).alias("joins_left"))
    w = blocks.latest(w, ["source_id"], "pos", None)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    start = F.greatest(F.when(finite("start_s"), F.round(F.col("start_s") * 1000)).otherwise(F.lit(0.0)), F.lit(0.0)).cast("bigint")
    w = w.withColumn("start_ms", start)
    w = w.withColumn("end_ms", F.greatest(F.when(finite("end_s"), F.round(F.col("end_s") * 1000).cast("bigint")).otherwise(F.col("start_ms")), F.col("start_ms")))
    w = blocks.neighbours(w, ["source_id"], "pos", ["start_ms", "text", "joins_left"], keep=True).drop("prev")
    w = w.withColumn("__t", tx.strip(F.col("text")))
    t = F.col("__t")
    w = w.withColumns({"__soft": tx.ends_ellipsis(t), "last": tx.bare(tx.last_word(t))})
    goes_on = F.coalesce("next.joins_left", F.lit(False))
    ellipsis = F.col("__soft")
    sentence = ~goes_on & ~ellipsis & tx.ends_sentence_mark(t) & ~tx.is_abbreviation(F.col("last"), decimals=True)
    clause = ~goes_on & (tx.ends_clause_mark(t) | ellipsis)
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("next.start_ms") - F.col("end_ms"))
    return w.withColumn("gap_ms", F.when(F.col("next").isNotNull(), gap)).withColumn("sentence", sentence).withColumn("clause", clause).withColumn("blank", t == "").drop("__t", "__soft")


def clips(words: DataFrame, *, least_s: float = 1.0, most_s: float = 15.0, pause_s: float = 2.0, target_s: float | None = None, isolate: float = 2.0) -> DataFrame:
    """``source_id, clip_no, text, start_ms, end_ms, n_words, oversized, confidence, silence_ms`` of clips of speech.

    Cuts lie at pauses of more than ``pause_s`` and else at the best boundary that leaves ``least_s`` to
    ``most_s`` seconds. A word longer than that is a clip of its own, oversized. All words come out once and
    in order; blank clips vanish. ``silence_ms`` is the longest pause inside, ``confidence`` the words' mean.
    """
    least = 1000 * (least_s if least_s > 0 else 1.0)
    most = max(1000 * most_s, least)
    pause_ms = 1000 * max(pause_s, LEAST_PAUSE_S)
    target = min(most, max(least, least + TARGET * (most - least) if target_s is None or not np.isfinite(target_s) else 1000 * target_s))
    w = _repaired_words(words)
    w = w.withColumn("head", tx.first_word(F.col("next.text")))
    worth = closing(F.col("last"), F.col("sentence"), F.col("clause")) + opening(F.col("head"), F.col("sentence"))
    plain = F.when(F.col("sentence"), SENTENCE).when(F.col("clause"), CLAUSE).otherwise(0.0)
    pause = GAP * F.coalesce(F.col("gap_ms"), F.lit(0)) / 1000
    w = with_runs(w.withColumn("score", pause + worth).withColumn("plain", pause + plain), F.col("gap_ms") > pause_ms)
    w = w.drop("next", "start_s", "end_s", "last", "head")
    fn = lambda cols, whole: _first(cols["pos"], cut_by_time(cols["start_ms"], cols["end_ms"], cols["score"], least, most, target, whole))
    placed = _placed(w, ["start_ms", "end_ms", "score"], fn)
    pieces = placed.groupBy("source_id", F.col("piece").alias("first_pos")).agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"), F.max_by("gap_ms", "pos").alias("gap_after"))
    usual = placed.where("gap_ms > 0").groupBy("source_id").agg(F.median("gap_ms").alias("usual"))
    two = _last_two(pieces).join(usual, "source_id", "left")
    scale = F.greatest(F.coalesce("usual", F.lit(0.0)), F.lit(1000 * LEAST_PAUSE_S))
    two = two.where((F.col("tail.hi") - F.col("tail.lo") < least) & (F.coalesce("body.gap_after", F.lit(0)) <= isolate * scale))
    extent = F.greatest("body.hi", "tail.hi") - F.least("body.lo", "tail.lo")
    ends = two.select("source_id", F.col("body.first_pos").alias("a"), F.col("tail.first_pos").alias("t"), (extent <= most).alias("whole"))

    def again(cols: dict[str, list]) -> dict[str, list]:
        a, b, score = (np.asarray(cols[c], float) for c in ("start_ms", "end_ms", "plain"))
        if len(a) < 2:
            return {"source_id": [], "cut": []}
        left = (np.maximum.accumulate(b) - np.minimum.accumulate(a))[:-1]
        right = (np.maximum.accumulate(b[::-1]) - np.minimum.accumulate(a[::-1]))[::-1][1:]
        k = halve(score[:-1], left, right, least, (b.max() - a.min()) / 2, 1e-6)
        return {"source_id": cols["source_id"][:1], "cut": [cols["pos"][k + 1]]}

    kept = ["source_id", "pos", "text", "joins_left", "start_ms", "end_ms", "confidence", "blank", "plain", "gap_ms"]
    placed = _repaired(placed.select(*kept, "piece"), ends, again)
    said = F.when(~F.col("blank"), F.struct("pos", "joins_left", tx.strip(F.col("text")).alias("t")))
    parts = F.array_sort(F.collect_list(said))
    text = tx.strip(F.aggregate(parts, F.lit(""), lambda acc, x: F.concat(acc, F.when(x["joins_left"] | (acc == ""), F.lit("")).otherwise(F.lit(" ")), x["t"])))
    # the gap after a piece's last word isn't inside it
    placed = placed.withColumn("inner", F.when(F.col("pos") < F.max("pos").over(Window.partitionBy("source_id", "piece")), F.col("gap_ms")))
    out = placed.groupBy("source_id", "piece").agg(text.alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), F.count_if(~F.col("blank")).alias("said"), F.avg("confidence").alias("confidence"), F.coalesce(F.max("inner"), F.lit(0)).alias("silence_ms")).where("said > 0")
    out = out.withColumn("oversized", F.col("end_ms") - F.col("start_ms") > most)
    return blocks.numbered(out, ["source_id"], "piece", "clip_no").select("source_id", "clip_no", "text", "start_ms", "end_ms", "n_words", "oversized", "confidence", "silence_ms")


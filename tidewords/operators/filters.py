"""Quality filters over clip candidates: kept, or dropped for exactly one reason, the first that holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewords.functions import scripts
from tidewords.functions.exact import compression_ratio, fixed
from tidewords.functions.text import preview, strip
from tidewords.operators import blocks

#: Seconds a spoken word lasts at most when silences are measured.
LONGEST_WORD_S = 2.0


@dataclass(frozen=True)
class Limits:
    """Thresholds of the filters. ``language`` null in the data, or a script that isn't known, turns the script rules off."""

    least_s: float = 1.0
    most_s: float = 15.0
    most_silence_s: float = 2.0
    most_compression: float = 2.4
    least_confidence: float = 0.30
    least_chars_s: float = 5.0
    most_chars_s: float = 25.0
    require_script: bool = True
    enabled: bool = True

    def __post_init__(self):
        if self.most_s < self.least_s:
            raise ValueError("most_s is less than least_s")


def silence_s(words: Column) -> Column:
    """Longest silence between neighbouring words of an array of structs; a word's end counts LONGEST_WORD_S after its start at most,
    NaN times make no silence."""
    start = lambda w: F.greatest(w["start_s"], F.lit(0.0))
    end = lambda w: F.least(F.greatest(w["end_s"], start(w)), start(w) + LONGEST_WORD_S)
    gaps = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.greatest(F.lit(0.0), F.nanvl(b["start_s"] - end(a), F.lit(0.0))))
    return F.coalesce(F.array_max(gaps), F.lit(0.0))


def mean_confidence(words: Column) -> Column:
    """Mean confidence of the words that have one; 1 without any."""
    held = F.filter(F.transform(words, lambda w: w["confidence"]), lambda c: c.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, c: a + c) / F.size(held)).otherwise(F.lit(1.0))


def reasons(candidates: DataFrame, limits: Limits | None = None, *, with_compression: bool = True) -> DataFrame:
    """``candidates`` with ``reason``, null for the kept.

    candidates: text, start_s, end_s, words, language. The rules run in this order: empty_text, duration,
    internal_silence, non_target_script, char_rate, compression_ratio, confidence. Native rules come first and
    zlib in Python sees only rows they keep. Null times count as no duration; null text as empty.
    """
    lim = limits or Limits()
    if not lim.enabled:
        return candidates.withColumn("reason", F.lit(None).cast("string"))
    text = strip(F.coalesce("text", F.lit("")))
    ms = F.coalesce(F.round((F.col("end_s") - F.col("start_s")) * 1000), F.lit(0.0))
    script = scripts.target(F.col("language"))
    candidates = candidates.withColumn("__top", F.when(script.isNotNull(), scripts.dominant(text)))
    top = F.col("__top")
    wrong = (top["script"] != script) & (2 * top["n"] > top["letters"])
    spaced = script.isNotNull() & ~script.isin(*scripts.UNSPACED) & (ms > 0)
    rate = F.length(text) * 1000 / F.nullif(ms, F.lit(0.0))
    silence = silence_s(F.col("words"))
    first = F.when(text == "", "empty_text").when((ms < 1000 * lim.least_s) | (ms > 1000 * lim.most_s), "duration").when(silence > lim.most_silence_s, "internal_silence")
    if lim.require_script:
        first = first.when(script.isNotNull() & wrong, "non_target_script")
    first = first.when(spaced & ((rate < lim.least_chars_s) | (rate > lim.most_chars_s)), "char_rate")
    out = candidates.withColumn("reason", first).drop("__top")
    unsure = mean_confidence(F.col("words")) < lim.least_confidence
    if not with_compression:
        return out.withColumn("reason", F.coalesce("reason", F.when(unsure, "confidence")))
    ratio = compression_ratio(F.when(F.col("reason").isNull(), text))
    out = out.withColumn("__ratio", ratio)
    late = F.when(F.col("__ratio") > lim.most_compression, "compression_ratio").when(unsure, "confidence")
    return out.withColumn("reason", F.coalesce("reason", late)).drop("__ratio")


def drops(judged: DataFrame, key: str = "ref", limits: Limits | None = None, *, clip_key: str | None = None) -> DataFrame:
    """``clip, filter, value, threshold, text`` of the dropped rows, all strings: what was measured, what was asked for, a preview
    of 80 characters. judged: rows with ``reason`` and what it was found from, as :func:`reasons` takes them, or, where these
    were measured before, ``silence_ms`` and ``confidence``. Numbers are printed to their own digits, half to even."""
    lim = limits or Limits()
    out = judged.where("reason is not null")
    has = set(judged.columns)
    text = strip(F.coalesce("text", F.lit("")))
    start, end = (("start_s", "end_s") if "start_s" in has else ("start_ms", "end_ms"))
    seconds = F.coalesce(F.round((F.col(end) - F.col(start)) * (1000 if start == "start_s" else 1)), F.lit(0.0)) / 1000
    silence = F.col("silence_ms") / 1000 if "silence_ms" in has else silence_s(F.col("words"))
    sure = F.col("confidence") if "confidence" in has else mean_confidence(F.col("words"))
    script = scripts.target(F.col("language"))
    rate = F.length(text) / F.nullif(seconds, F.lit(0.0))
    num = lambda c, digits, unit: F.concat(fixed(c.cast("double"), F.lit(digits)), F.lit(unit))
    more, less = lambda x, unit="": F.lit(f">={x}{unit}"), lambda x, unit="": F.lit(f"<={x}{unit}")
    why = F.col("reason")
    said = {
        "empty_text": (F.lit("0"), F.lit(">0 chars")),
        "duration": (num(seconds, 2, "s"), F.when(seconds < lim.least_s, more(lim.least_s, "s")).otherwise(less(lim.most_s, "s"))),
        "internal_silence": (num(silence, 2, "s"), less(lim.most_silence_s, "s")),
        "non_target_script": (scripts.dominant(text)["script"], script),
        "char_rate": (num(rate, 1, "/s"), F.when(rate < lim.least_chars_s, more(lim.least_chars_s, "/s")).otherwise(less(lim.most_chars_s, "/s"))),
        "compression_ratio": (num(compression_ratio(F.when(why == "compression_ratio", text)), 2, ""), less(lim.most_compression)),
        "confidence": (num(sure, 2, ""), more(lim.least_confidence)),
    }
    value, threshold = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (v, t) in said.items():
        value, threshold = F.when(why == name, v).otherwise(value), F.when(why == name, t).otherwise(threshold)
    return out.select(F.col(clip_key or key).alias("clip"), why.alias("filter"), value.alias("value"), threshold.alias("threshold"), preview(F.when(why == "empty_text", F.coalesce("text", F.lit(""))).otherwise(text)).alias("text"))


# Seconds that a written clip must be longer than; failures that a source may have, and what part of its clips.
LEAST_CLIP_S, FAILURES, FAILURE_RATE = 0.01, 3, 0.2
# Share of samples at full scale above which a clip is clipped, and full scale.
CLIPPED, FULL_SCALE = 0.005, 32_767


def sliced(kept: DataFrame, slices: DataFrame, *, clipping: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What came of cutting clips: those written, with ``clip_id`` numbered without holes; drops; sources given up.

    kept: ref, source_id, seg (their order), text. slices: ref, error (null if cut), written_s, and, for ``clipping``, clipped, the
    share of samples at full scale (null where that can't be told, which drops nothing). The drops are ``slice_failed``,
    ``empty_slice`` and, by final id, ``clipping``. Of a source more of whose cuts fail than FAILURES and FAILURE_RATE of its
    clips nothing is written; it comes out as ``source_id, failures, clips``. A clip without a slice has failed.
    """
    from tidewords.operators import merge

    rows = kept.join(slices.select("ref", F.col("error").alias("__e"), "written_s", *(["clipped"] if clipping else []), F.lit(True).alias("__s")), "ref", "left")
    error = F.coalesce("__e", F.when(F.col("__s").isNull(), F.lit("not cut")))
    rows = rows.withColumn("__e", error)
    per = rows.groupBy("source_id").agg(F.count("*").alias("clips"), F.count_if(F.col("__e").isNotNull()).alias("failures"))
    lost = per.where(F.col("failures") > F.greatest(F.lit(float(FAILURES)), F.col("clips") * FAILURE_RATE))
    rows = blocks.lookup(rows, lost.select("source_id"), ["source_id"], ["ref"], "left_anti")
    empty = F.coalesce(F.col("written_s") <= LEAST_CLIP_S, F.lit(True))
    early = rows.where(F.col("__e").isNotNull() | empty)
    why = F.when(F.col("__e").isNotNull(), "slice_failed").otherwise("empty_slice")
    text = F.left(F.coalesce("text", F.lit("")), F.lit(80))
    drops_ = early.select(F.col("ref").alias("clip"), why.alias("filter"), F.when(F.col("__e").isNotNull(), F.left("__e", F.lit(80))).otherwise("0.00s").alias("value"), F.when(F.col("__e").isNotNull(), "cut").otherwise(">0s").alias("threshold"), text.alias("text"))
    out = merge.clip_numbers(rows.where(F.col("__e").isNull() & ~empty).drop("__e", "__s"), "seg")
    if clipping:
        loud = F.coalesce(F.col("clipped") > CLIPPED, F.lit(False))
        drops_ = drops_.unionByName(out.where(loud).select(F.col("clip_id").alias("clip"), F.lit("clipping").alias("filter"), F.concat(fixed(F.col("clipped") * 100, F.lit(2)), F.lit("%")).alias("value"), F.lit(f"<={CLIPPED * 100}%").alias("threshold"), preview(F.coalesce("text", F.lit(""))).alias("text")))
        out = out.where(~loud).drop("clipped")
    return out, drops_, lost.select("source_id", "failures", "clips")


def padded(clips: DataFrame, *, pad_s: float = 0.1, media_s: str | None = None) -> DataFrame:
    """Clips (``source_id, clip_no, start_ms, end_ms``) with ``cut_start_ms, cut_end_ms``: widened by the pad, at most to
    the middle of the way to the neighbours, kept or not, and not past the media's end."""
    pad = int(round(pad_s * 1000))
    rows = blocks.neighbours(clips, ["source_id"], "clip_no", ["start_ms", "end_ms"])
    # greatest and least skip nulls, so an absent neighbour is asked for by name
    half = lambda gap: F.when(gap.isNull(), F.lit(float(pad))).otherwise(F.least(F.lit(float(pad)), F.greatest(F.lit(0.0), gap / 2)))
    left, right = half(F.col("start_ms") - F.col("prev.end_ms")), half(F.col("next.start_ms") - F.col("end_ms"))
    a, b = F.greatest(F.lit(0.0), F.col("start_ms") - left), F.col("end_ms") + right
    if media_s:
        ms = F.round(F.col(media_s) * 1000)
        b = F.when(ms > 0, F.least(b, ms)).otherwise(F.col("end_ms").cast("double"))  # past an unknown end nothing is added
    return rows.withColumn("cut_start_ms", a).withColumn("cut_end_ms", b).drop("prev", "next")


def clipped_share(samples: Column, full_scale: float) -> Column:
    """Share of samples at or past full scale; null for null and empty arrays."""
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, lambda x: F.abs(x) >= full_scale)) / F.size(samples))

"""Who speaks: interval overlap of clips with speaker turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewords.operators import blocks

#: Milliseconds in a bucket of the overlap join.
BUCKET_MS = 60_000


def _ms(c: str):
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9), F.round(F.col(c) * 1000).cast("bigint"))


def turns_ms(turns: DataFrame) -> DataFrame:
    """``source_id, speaker, c, d`` of the turns that last, each once; unusable times are dropped."""
    return turns.select("source_id", "speaker", _ms("start_s").alias("c"), _ms("end_s").alias("d")).where("source_id is not null and speaker is not null and d > c").distinct()


def overlaps(clips: DataFrame, turns: DataFrame) -> DataFrame:
    """``id, source_id, speaker, overlap_ms, first_ms``: how long each speaker's turns overlap each clip.

    Both sides are spread over time buckets and joined on (source, bucket), an equi-join that a hot source
    doesn't skew; a pair meets in every bucket both touch and adds what lies inside each. first_ms is the
    start of the speaker's first turn that overlaps.
    """
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET_MS), F.floor(F.col(b) / BUCKET_MS)))
    one = clips.select("id", "source_id", _ms("start_s").alias("a"), _ms("end_s").alias("b")).where("id is not null and b > a").distinct()
    one = one.select("*", spread("a", "b").alias("k"))
    two = turns_ms(turns).select("*", spread("c", "d").alias("k"))
    shared = F.least("b", "d", (F.col("k") + 1) * BUCKET_MS) - F.greatest("a", "c", F.col("k") * BUCKET_MS)
    both = one.join(two, ["source_id", "k"]).select("id", "source_id", "speaker", "c", shared.alias("ms")).where("ms > 0")
    return both.groupBy("id", "source_id", "speaker").agg(F.sum("ms").alias("overlap_ms"), F.min("c").alias("first_ms"))


def assigned(clips: DataFrame, turns: DataFrame) -> DataFrame:
    """``id, speaker, overlap_ms, total_ms`` of every clip: the speaker of longest overlap, of equals the one heard first.

    Purity is overlap_ms / total_ms. A clip that no turn overlaps has a null speaker and zeros.
    """
    per = overlaps(clips, turns)
    top = per.groupBy("id").agg(F.min(F.struct((-F.col("overlap_ms")).alias("o"), "first_ms", "speaker")).alias("m"), F.sum("overlap_ms").alias("total_ms"))
    top = top.select("id", F.col("m.speaker").alias("speaker"), (-F.col("m.o")).alias("overlap_ms"), "total_ms")
    every = clips.select("id").where("id is not null").distinct()
    return every.join(top, "id", "left").select("id", "speaker", F.coalesce("overlap_ms", F.lit(0)).alias("overlap_ms"), F.coalesce("total_ms", F.lit(0)).alias("total_ms"))


def dominant(turns: DataFrame) -> DataFrame:
    """``source_id, speaker, ms``: who speaks longest in each source; of equals who spoke first, then by name."""
    per = turns_ms(turns).groupBy("source_id", "speaker").agg(F.sum(F.col("d") - F.col("c")).alias("ms"), F.min("c").alias("first"))
    return per.groupBy("source_id").agg(F.min(F.struct((-F.col("ms")).alias("m"), "first", "speaker")).alias("x")).select("source_id", F.col("x.speaker").alias("speaker"), (-F.col("x.m")).alias("ms"))


def speaker_drops(clips: DataFrame, turns: DataFrame, *, mode: str = "tag", least_purity: float = 0.85, measured: bool = False) -> DataFrame:
    """``id, speaker, reason`` of every clip: ``no_speaker``, ``cross_speaker``, ``non_dominant_speaker`` or null if kept; with
    ``measured`` also ``purity`` and ``main``, the source's main speaker.

    mode ``tag`` and ``per_speaker`` keep all speakers, ``dominant`` only each source's main one.
    """
    if mode not in ("tag", "dominant", "per_speaker"):
        raise ValueError(f"no such mode: {mode}")
    got = assigned(clips, turns)
    main = dominant(turns).select("source_id", F.col("speaker").alias("main"))
    of = clips.select("id", "source_id").where("id is not null").distinct()
    got = blocks.lookup(got.join(of, "id"), main, ["source_id"], ["id"])
    reason = F.when(F.col("speaker").isNull(), "no_speaker").when(F.col("overlap_ms") < least_purity * F.col("total_ms"), "cross_speaker")
    if mode == "dominant":
        reason = reason.when(F.col("speaker") != F.col("main"), "non_dominant_speaker")
    purity = F.col("overlap_ms") / F.nullif("total_ms", F.lit(0))
    return got.select("id", "speaker", reason.alias("reason"), *([purity.alias("purity"), "main"] if measured else []))

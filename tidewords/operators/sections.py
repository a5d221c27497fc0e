"""Paragraphs put into sections: the chapter that is running, or slices of time."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions.text import format_timestamp
from tidewords.operators import blocks
from tidewords.operators.cutting import latest


def chapter_of(paragraphs: DataFrame, sources: DataFrame) -> DataFrame:
    """Paragraphs (``source_id, para_no, start_s``) with ``chapter_no``, from 0, and ``title`` of the last chapter
    that has begun; nulls before the first and in sources without chapters. Chapters are ordered by start,
    equal starts by their place in the list.

    An as-of join by list search: a source's chapters, a handful, travel with its row in one array, and each
    paragraph looks up its place by a filter on the JVM. Paragraphs of a hot source meet one row, in several tasks.
    """
    placed = F.transform("chapters", lambda c, i: F.struct(c["start_time"].alias("s"), i.alias("i"), c["title"].alias("title")))
    chapters = latest(sources.where("source_id is not null").select("source_id", F.array_sort(F.filter(placed, lambda c: c["s"].isNotNull())).alias("chapters")), ["source_id"], None)
    begun = F.filter("chapters", lambda c: c["s"] <= F.col("start_s"))
    out = blocks.lookup(paragraphs, chapters, ["source_id"], ["para_no"]).withColumn("begun", F.coalesce(F.size(begun), F.lit(0)))
    at = F.when(F.col("begun") > 0, F.col("begun") - 1)
    return out.withColumn("chapter_no", at).withColumn("title", F.get("chapters", at)["title"]).drop("begun", "chapters")


def time_sections(paragraphs: DataFrame, *, window_s: float = 300.0) -> DataFrame:
    """``source_id, para_no, first_no``: the first paragraph of the slice each paragraph lies in.

    A slice ends with the first paragraph that starts ``window_s`` or more after the slice did, and that one
    begins the next: slices are anchored by speech, not by the clock. Paragraphs must have unique numbers.
    Where a paragraph starts so long after all before it a slice begins whatever came before; the fold runs
    between such places.
    """
    rows = paragraphs.select("source_id", F.col("para_no").cast("bigint").alias("para_no"), F.coalesce("start_s", F.lit(0.0)).alias("start_s"))
    rows = blocks.running(rows, ["source_id"], "para_no", F.col("start_s"), "reach", highest=True)
    rows = blocks.neighbours(rows, ["source_id"], "para_no", ["reach"]).drop("next")
    apart = F.coalesce((F.col("start_s") - F.col("prev.reach") >= window_s).cast("bigint"), F.lit(1).cast("bigint"))
    rows = blocks.running(rows.drop("reach"), ["source_id"], "para_no", apart, "run_no").drop("prev")
    return blocks.fold(rows, ["source_id", "run_no"], ["para_no"], partial(_slices, window_s=window_s), "source_id string, para_no bigint, first_no bigint")


def _slices(cols: dict[str, list], window_s: float) -> dict[str, list]:
    first, anchor = [], None
    for no, start in zip(cols["para_no"], cols["start_s"], strict=True):
        if anchor is None or start >= anchor[1] + window_s:
            anchor = (no, start)
        first.append(anchor[0])
    return {"source_id": cols["source_id"], "para_no": cols["para_no"], "first_no": first}


def sections(paragraphs: DataFrame, sources: DataFrame, *, window_s: float = 300.0) -> DataFrame:
    """``source_id, para_no, section_no, section``: chapters where a source has any, else slices of time.

    Paragraphs before the first chapter and slices are titled by their span. Sections are numbered from 1 in order.
    """
    paras = latest(paragraphs.where("source_id is not null and para_no is not null").select("source_id", "para_no", "start_s", "end_s"), ["source_id", "para_no"], None)
    has = latest(sources.where("source_id is not null").select("source_id", (F.coalesce(F.size("chapters"), F.lit(0)) > 0).alias("has")), ["source_id"], None)
    by_chapter = chapter_of(blocks.lookup(paras, has.where("has"), ["source_id"], ["para_no"], "left_semi"), sources).select("source_id", "para_no", "start_s", "end_s", F.coalesce("chapter_no", F.lit(-1)).cast("bigint").alias("key"), "title")
    rest = blocks.lookup(paras, has.where("has"), ["source_id"], ["para_no"], "left_anti")
    by_time = rest.join(time_sections(rest, window_s=window_s), ["source_id", "para_no"]).select("source_id", "para_no", "start_s", "end_s", F.col("first_no").alias("key"), F.lit(None).cast("string").alias("title"))
    both = by_chapter.unionByName(by_time)
    spans = both.groupBy("source_id", "key").agg(F.min_by("start_s", "para_no").alias("a"), F.max("end_s").alias("b"), F.max("title").alias("title"))
    span = F.concat(F.lit("["), format_timestamp(F.col("a")), F.lit(" – "), format_timestamp(F.col("b")), F.lit("]"))
    spans = spans.select("source_id", "key", F.row_number().over(Window.partitionBy("source_id").orderBy("key")).alias("section_no"), F.coalesce("title", span).alias("section"))
    return both.select("source_id", "para_no", "key").join(spans, ["source_id", "key"]).select("source_id", "para_no", "section_no", "section")


def windows(media: DataFrame, *, window_s: float = 120.0) -> DataFrame:
    """``source_id, window_no, start_s, end_s``: stretches of ``window_s``, the last one shorter, in which long media are worked off.
    Media without a positive finite duration_s have none."""
    some = media.where("source_id is not null and duration_s > 0 and not isnan(duration_s) and duration_s < 1e9")
    cut = some.select("source_id", "duration_s", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("duration_s") / window_s) - 1).cast("int"))).alias("window_no"))
    return cut.select("source_id", "window_no", (F.col("window_no") * window_s).alias("start_s"), F.least((F.col("window_no") + 1) * window_s, "duration_s").alias("end_s"))

"""A dataset folder measured and judged: structure, pairing, script, edges, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions import scripts
from tidewords.functions.exact import similarity
from tidewords.functions.text import pipe_safe, strip

# Thresholds of the verdict.
LEAST_GAP = 0.25
GOOD_ACCURACY, FAIR_ACCURACY = 0.90, 0.75
GOOD_SCRIPT, FAIR_SCRIPT = 0.95, 0.80
GOOD_EDGES, BAD_EDGES, HOT = 0.10, 0.50, 0.5
DURATION_MS = 50


def missing_audio(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``id`` of rows whose file isn't there; a null path is missing."""
    return manifest.join(files.select(F.col("path").alias("audio_path")).distinct(), "audio_path", "left_anti").select("id").distinct()


def duplicate_ids(manifest: DataFrame) -> DataFrame:
    """``id, n`` of ids that several rows have."""
    return manifest.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def duration_off(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``id`` where the listed and the actual duration differ by more than 50 ms; unknown ones don't count."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    both = manifest.select("id", "audio_path", ms("duration_s").alias("a")).join(files.select(F.col("path").alias("audio_path"), ms("actual_s").alias("b")), "audio_path")
    return both.where(F.abs(F.col("a") - F.col("b")) > DURATION_MS).select("id").distinct()


def csv_mismatch(manifest: DataFrame, lines: DataFrame) -> DataFrame:
    """``malformed, mismatched`` of the pipe-delimited index ``lines (line, pos)`` against the manifest (id, text).

    Malformed lines haven't three fields; a line mismatches if its id is in the manifest with another text. Of
    repeated ids in the manifest the greatest text stands.
    """
    fields = F.split("line", r"\|")
    cells = lines.where(strip(F.col("line")) != "").select(F.size(fields).alias("k"), fields[0].alias("id"), F.get(fields, F.lit(2)).alias("said"))
    texts = manifest.where("id is not null").groupBy("id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    wrong = cells.where("k = 3").join(texts, "id").where(pipe_safe(F.col("said")) != pipe_safe(F.col("text")))
    return cells.agg(F.count_if(F.col("k") != 3).alias("malformed")).crossJoin(wrong.agg(F.count("*").alias("mismatched")))  # one row each


def structure(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``source_id, rows, missing, duplicated, empty, control`` of each source's manifest rows, in one pass after the file lookup."""
    here = manifest.join(files.select(F.col("path").alias("audio_path"), F.lit(1).alias("there")).distinct(), "audio_path", "left")
    text = F.coalesce("text", F.lit(""))
    per = here.groupBy("source_id", "id").agg(F.count("*").alias("n"), F.max(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("m"), F.max(F.when(strip(text) == "", 1).otherwise(0)).alias("e"), F.max(F.when(text.rlike(r"[\x00-\x08\x0a-\x1f]"), 1).otherwise(0)).alias("c"))
    return per.groupBy("source_id").agg(F.sum("n").alias("rows"), F.sum("m").alias("missing"), F.count_if(F.col("n") > 1).alias("duplicated"), F.sum("e").alias("empty"), F.sum("c").alias("control"))


def hot_share(ratios: DataFrame, keys: list[str], ratio: str = "edge_ratio") -> DataFrame:
    """``keys, measured, hot_edges``: of the clips whose edges were measured, the share with loud ones; null where none was."""
    known = F.when(~F.isnan(ratio), F.col(ratio))
    return ratios.groupBy(*keys).agg(F.count(known).alias("measured"), F.avg((known > HOT).cast("double")).alias("hot_edges"))


#: Checks of a dataset's structure in order, and which of them are only untidy.
CHECKS = ("audio present", "ids unique", "texts whole", "audio format", "durations", "no orphans", "index agrees")
SOFT = ("no orphans", "index agrees")


def checks(manifest: DataFrame, files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``place, check, ok, fatal, bad, of, example``: the structural checks of a dataset's rows, in order of CHECKS.

    manifest: id, audio_path, text, duration_s. files: path, actual_s, channels, width, rate (nulls if unreadable). lines: line, of
    the pipe-delimited index. Listed durations are checked where any is listed and its file is read, the index where there is one.
    ``bad`` of the format counts unreadable and unfit files and rates past the first; example is the least bad id or path.
    """
    read = files.select(F.col("path").alias("audio_path"), F.round(F.when(F.abs("actual_s") < 1e9, F.col("actual_s")) * 1000).cast("bigint").alias("actual_ms"), "channels", "width", "rate", F.lit(1).alias("there")).dropDuplicates(["audio_path"])
    rows = manifest.select("id", "audio_path", F.coalesce("text", F.lit("")).alias("text"), F.round(F.when(F.abs("duration_s") < 1e9, F.col("duration_s")) * 1000).cast("bigint").alias("ms")).join(read, "audio_path", "left")
    here = F.col("there").isNotNull()
    readable = here & F.col("rate").isNotNull()
    fit = F.coalesce((F.col("channels") == 1) & (F.col("width") == 2), F.lit(False))
    listed = readable & F.col("ms").isNotNull() & F.col("actual_ms").isNotNull()
    off = listed & (F.abs(F.col("ms") - F.col("actual_ms")) > DURATION_MS)
    odd = (strip(F.col("text")) == "") | F.col("text").rlike(r"[\x00-\x08\x0a-\x1f]")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    example = lambda c: F.min(F.when(c, F.col("id")))
    unfit = here & ~(readable & fit)
    one = rows.agg(F.count("*").alias("n"), count(~here).alias("b0"), example(~here).alias("e0"), count(odd).alias("b2"), example(odd).alias("e2"), count(unfit).alias("unfit"), example(unfit).alias("e3"), count(here).alias("n3"), F.countDistinct(F.when(readable, F.col("rate"))).alias("rates"), count(off).alias("b4"), example(off).alias("e4"), count(listed).alias("n4"))
    twice = duplicate_ids(manifest).agg(F.count("*").alias("b1"), F.min("id").alias("e1"))
    left = files.select("path").distinct().where(F.col("path").rlike(r"(^|/)[^/]+_\d{4}\.wav$")).join(manifest.select(F.col("audio_path").alias("path")).where("path is not null").distinct(), "path", "left_anti").agg(F.count("*").alias("b5"), F.min("path").alias("e5"))
    out = one.crossJoin(twice).crossJoin(left)  # one row each
    index = csv_mismatch(manifest, lines) if lines is not None else manifest.sparkSession.createDataFrame([(None, None)], "malformed bigint, mismatched bigint")
    out = out.crossJoin(index)
    none = F.lit(None).cast("string")
    bad = [F.col("b0"), F.col("b1"), F.col("b2"), F.col("unfit") + F.greatest(F.lit(0), F.col("rates") - 1), F.when(F.col("n4") > 0, F.col("b4")), F.col("b5"), F.col("malformed") + F.col("mismatched")]
    of = [F.col("n"), F.col("n"), F.col("n"), F.col("n3"), F.col("n4"), F.lit(None), F.lit(None)]
    example_ = [F.col("e0"), F.col("e1"), F.col("e2"), F.col("e3"), F.col("e4"), F.col("e5"), none]
    made = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("check"), (b == 0).alias("ok"), F.lit(name not in SOFT).alias("fatal"), b.cast("bigint").alias("bad"), o.cast("bigint").alias("of"), e.alias("example")) for i, (name, b, o, e) in enumerate(zip(CHECKS, bad, of, example_, strict=True))])
    return out.select(F.inline(made)).where("bad is not null")


def sentences(v: dict, failed: list[dict]) -> list[str]:
    """What speaks against a dataset, in sentences: failed checks (rows of :func:`checks`) and the measures of a verdict:
    pairing_gap, pairing_mean, control_mean, script_share, language, hot_edges."""
    out = []
    for c in sorted(failed, key=lambda c: (not c["fatal"], c["place"])):
        of, example = f" of {c['of']}" if c["of"] is not None else "", f", such as {c['example']}" if c["example"] else ""
        out.append(f"{'Broken' if c['fatal'] else 'Untidy'}: {c['check']} fails for {c['bad']}{of}{example}.")
    gap, mean = v.get("pairing_gap"), v.get("pairing_mean")
    if gap is None:
        out.append("Whether audio and text belong together was not measured.")
    elif gap < LEAST_GAP:
        out.append(f"Audio and text don't belong together: heard again, clips are {mean:.2f} like their own text and {v.get('control_mean') or 0:.2f} like another's; the gap of {gap:+.2f} should be {LEAST_GAP:+.2f}.")
    elif mean is not None and mean < FAIR_ACCURACY:
        out.append(f"Texts are largely wrong: heard again, clips are {mean:.2f} like them, under {FAIR_ACCURACY:.2f}.")
    elif mean is not None and mean < GOOD_ACCURACY:
        out.append(f"Texts are approximate: heard again, clips are {mean:.2f} like them, under {GOOD_ACCURACY:.2f}.")
    share, edges = v.get("script_share"), v.get("hot_edges")
    if share is not None and share < GOOD_SCRIPT:
        out.append(f"{1 - share:.0%} of the clips aren't written in the script of {v.get('language') or 'the language'}.")
    if edges is not None and edges > GOOD_EDGES:
        out.append(f"{edges:.0%} of the clips begin or end amid speech or music.")
    return out


def script_share(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id, judged, matching``: clips with letters, and those of them mostly in the script of the source's language.

    Sources whose language or script isn't known have no row.
    """
    lang = sources.where("source_id is not null").groupBy("source_id").agg(F.max("language").alias("language")).select("source_id", scripts.target(F.col("language")).alias("script")).where("script is not null")
    # texts stay where they lie: of each goes on its script and, to know it again, a hash
    one = clips.select("id", "source_id", F.xxhash64("text").alias("h"), F.length("text").alias("k"), scripts.dominant(F.col("text"))["script"].alias("own")).where("own is not null").distinct()
    one = one.groupBy("source_id", "own").agg(F.count("*").alias("n")).join(lang, "source_id")
    return one.groupBy("source_id").agg(F.sum("n").alias("judged"), F.coalesce(F.sum(F.when(F.col("own") == F.col("script"), F.col("n"))), F.lit(0)).alias("matching"))


def sampled(rows: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` rows by hash of the key and a seed: the same ones in every run. A sampling operator; the order is the column ``h``."""
    return rows.withColumn("h", F.xxhash64(key, F.lit(seed))).orderBy("h", key).limit(n)


def controls(sample: DataFrame, text: str = "text") -> DataFrame:
    """A sample (a few rows, ordered by ``h``) with ``control``: the text of the next row, the first's for the last."""
    over = Window.orderBy("h")
    return sample.withColumn("control", F.coalesce(F.lead(text).over(over), F.first(text).over(over)))


def pairing(sample: DataFrame) -> DataFrame:
    """``pairing_mean, pairing_median, control_mean, pairing_gap`` of rows ``heard, text, control``, each rounded to three
    digits; the gap is that of the rounded means. Of fewer than two rows all are null."""
    own, other = F.round(similarity("heard", "text"), 3), F.round(similarity("heard", "control"), 3)
    got = sample.select(own.alias("a"), other.alias("b")).agg(F.count("*").alias("n"), F.round(F.avg("a"), 3).alias("pairing_mean"), F.round(F.median("a"), 3).alias("pairing_median"), F.round(F.avg("b"), 3).alias("control_mean"))
    gap = F.round(F.col("pairing_mean") - F.col("control_mean"), 3)
    some = F.col("n") >= 2
    return got.select(*[F.when(some, F.col(c)).alias(c) for c in ("pairing_mean", "pairing_median", "control_mean")], F.when(some, gap).alias("pairing_gap"))


def verdict(gap: Column, accuracy: Column, script: Column, edges: Column, *, fatal: Column | None = None, soft: Column | None = None) -> Column:
    """Struct of ``verdict`` and ``reasons`` (names in order). Null measures are unmeasured; only a missing gap counts against."""
    broken, untidy = fatal if fatal is not None else F.lit(False), soft if soft is not None else F.lit(False)
    paired = gap >= LEAST_GAP
    bad = [(broken, "structure"), (gap < LEAST_GAP, "pairing"), (paired & (accuracy < FAIR_ACCURACY), "accuracy"), (script < FAIR_SCRIPT, "script"), (edges > BAD_EDGES, "edges")]
    fair = [(untidy, "tidy"), (gap.isNull(), "unmeasured"), (paired & (accuracy >= FAIR_ACCURACY) & (accuracy < GOOD_ACCURACY), "approximate"), ((script >= FAIR_SCRIPT) & (script < GOOD_SCRIPT), "mixed_script"), ((edges > GOOD_EDGES) & (edges <= BAD_EDGES), "some_edges")]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in [*bad, *fair]]))
    some = lambda rules: F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c, _ in rules]), lambda x: x)
    return F.struct(F.when(some(bad), "not trainable").when(some(fair), "marginal").otherwise("trainable").alias("verdict"), names.alias("reasons"))

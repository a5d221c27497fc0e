"""The three products as compositions: readable transcripts, a training dataset, a verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.functions import scripts
from tidewords.functions.exact import compression_ratio, fixed
from tidewords.operators import blocks, cutting, filters, merge, sections, speakers, verify
from tidewords.session import settle
from tidewords.sinks import rows as sinks
from tidewords.sources import landed


@dataclass(frozen=True)
class DatasetConfig:
    """What a dataset is built with. Filter bounds follow the segment bounds unless they are given."""

    least_s: float = 1.0
    most_s: float = 15.0
    pause_s: float = 2.0
    pad_s: float = 0.1
    target_language: str | None = None
    speaker_mode: str | None = None
    least_purity: float = 0.85
    limits: filters.Limits | None = field(default=None)

    def __post_init__(self):
        if self.most_s < self.least_s:
            raise ValueError("most_s is less than least_s")
        if self.speaker_mode not in (None, "tag", "dominant", "per_speaker"):
            raise ValueError(f"no such mode: {self.speaker_mode}")
        if not 0 <= self.least_purity <= 1:
            raise ValueError("least_purity is a share")


def transcripts(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """``source_id, pos, start_s, end_s, section, text``: chunks of readable paragraphs in their sections, from raw lines."""
    p = settle(cutting.paragraphs(segments), "paragraphs")
    p = p.select("source_id", F.col("para_no").cast("int").alias("para_no"), "text", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))
    return sinks.chunks(p, sections.sections(p, sources))


def dataset(words: DataFrame, sources: DataFrame, turns: DataFrame | None = None, config: DatasetConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Clips and drops out of words.

    clips: id, source_id, audio_path, text, start_s, end_s, duration_s, oversized, speaker, with the window to slice,
    cut_start_ms and cut_end_ms. drops: clip, filter, value, threshold, text. Clip ends are clamped to the media's length, clips past it
    vanish; ids have no holes before speakers are judged; a source without known language is held to no script.
    """
    cfg = config or DatasetConfig()
    lim = cfg.limits or filters.Limits(least_s=cfg.least_s, most_s=cfg.most_s)
    src = cutting.latest(sources.where("source_id is not null").select("source_id", "duration_s", "language", "ingested_at"), ["source_id"], "ingested_at")
    language = F.coalesce(F.lit(cfg.target_language), scripts.normalized_code(F.col("language")))
    cut = cutting.clips(words, least_s=cfg.least_s, most_s=cfg.most_s, pause_s=cfg.pause_s)
    cut = blocks.lookup(cut, src.select("source_id", "duration_s", language.alias("language")), ["source_id"], ["clip_no"])
    media = F.round(F.col("duration_s") * 1000).cast("bigint")
    cut = clamped(cut.withColumn("__media", media), "__media").drop("__media")
    cut = settle(filters.padded(cut, pad_s=cfg.pad_s, media_s="duration_s"), "cut")
    judged = _judged(cut.withColumn("ref", F.concat("source_id", F.lit("_seg"), F.lpad(F.col("clip_no").cast("string"), 4, "0"))), lim)
    judged = settle(judged, "judged")
    kept = merge.clip_numbers(judged.where("reason is null"), "clip_no")
    kept = kept.select(F.col("clip_id").alias("id"), "source_id", F.concat(F.lit("wavs/"), "clip_id", F.lit(".wav")).alias("audio_path"), "text", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration_s"), "oversized", "cut_start_ms", "cut_end_ms")
    drops = filters.drops(judged, limits=lim)
    if turns is None or cfg.speaker_mode is None:
        return kept.withColumn("speaker", F.lit(None).cast("string")), drops
    kept = settle(kept, "kept")
    said = speakers.speaker_drops(kept, turns, mode=cfg.speaker_mode, least_purity=cfg.least_purity, measured=True)
    with_speaker = kept.join(said, "id", "left")
    lost = with_speaker.where("reason is not null").select(F.col("id").alias("clip"), F.col("reason").alias("filter"), *_purity(cfg.least_purity), filters.preview(F.col("text")).alias("text"))
    return with_speaker.where("reason is null").drop("reason", "purity", "main"), drops.unionByName(lost)


def clamped(clips: DataFrame, media_ms: str) -> DataFrame:
    """Clips (start_ms, end_ms) that end with their media at the latest; those that begin at its end or past it vanish. A length that
    is null or not positive clamps nothing."""
    end = F.when(F.col(media_ms) > 0, F.least("end_ms", F.col(media_ms).cast("bigint"))).otherwise(F.col("end_ms"))
    return clips.withColumn("end_ms", end).where("end_ms > start_ms")


def wordless(sources: DataFrame, words: DataFrame) -> DataFrame:
    """``source_id`` of the sources without any word, of which no clips can be made."""
    said = words.where("source_id is not null and text is not null").groupBy("source_id").agg(F.lit(1).alias("one"))
    return sources.where("source_id is not null").select("source_id").distinct().join(said, "source_id", "left_anti")


def advice(sources: DataFrame, *, rate: int = 22_050, formats: tuple[str, ...] = ("jsonl",)) -> DataFrame:
    """``source_id, advice``: what to think over before a source is built, an array in this order: ``low_resource`` (recognized by a stock
    model that can't read its language), ``small_model`` (words may be lost in alignment), ``upsampled`` (its rate is under the target),
    ``formats`` (indexes that don't go together).

    sources: source_id, language, model (``tiny`` to ``large-v3``, else one's own), rate where known.
    """
    base = scripts.base_code(F.col("language"))
    stock = F.col("model").isin(*STOCK)
    rules = {"low_resource": stock & base.isin(*scripts.UNUSABLE.split()), "small_model": F.col("model").isin("tiny", "base"), "upsampled": (F.col("rate") > 0) & (F.col("rate") < rate), "formats": F.lit({"hf", "ljspeech"} <= set(formats))}
    return sources.select("source_id", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])).alias("advice"))


# Sizes of the recognizer that come ready-made.
STOCK = ("tiny", "base", "small", "medium", "large-v3")


def _purity(least: float) -> list[Column]:
    """Value and threshold of a drop for speakers: how pure, or who it is and who is wanted."""
    why = F.col("reason")
    value = F.when(why == "cross_speaker", fixed("purity", F.lit(2))).otherwise(F.coalesce("speaker", F.lit("none")))
    asked = F.when(why == "cross_speaker", f">={least}").when(why == "no_speaker", "a speaker").otherwise(F.coalesce("main", F.lit("")))
    return [value.alias("value"), asked.alias("threshold")]


def _judged(cut: DataFrame, lim: filters.Limits) -> DataFrame:
    """The filter chain over freshly cut clips, whose silence and confidence were measured while cutting."""
    if not lim.enabled:
        return cut.withColumn("reason", F.lit(None).cast("string"))
    as_words = F.array(F.struct(F.lit("").alias("text"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"), F.lit(1.0).alias("confidence")))
    df = cut.withColumn("words", as_words).withColumn("start_s", F.col("start_ms") / 1000).withColumn("end_s", F.col("end_ms") / 1000)
    df = filters.reasons(df, lim, with_compression=False).drop("words", "start_s", "end_s")
    silent = F.col("silence_ms") > 1000 * lim.most_silence_s
    # silence comes before script and rate in the order of the rules
    df = df.withColumn("reason", F.when(F.col("reason").isin("empty_text", "duration"), F.col("reason")).when(silent, "internal_silence").otherwise(F.col("reason")))
    df = df.withColumn("__ratio", compression_ratio(F.when(F.col("reason").isNull(), F.col("text"))))
    late = F.when(F.col("__ratio") > lim.most_compression, "compression_ratio").when(F.col("confidence") < lim.least_confidence, "confidence")
    return df.withColumn("reason", F.coalesce("reason", late)).drop("__ratio")


def verification(clips: DataFrame, files: DataFrame, sources: DataFrame, heard: DataFrame | None = None, *, lines: DataFrame | None = None, edges: DataFrame | None = None, sample: int = 8, seed: int = 0) -> DataFrame:
    """One row per source with clips or with clip files that no clip refers to: counts of what is wrong, script share, hot
    edges, verdict and reasons. Pairing, agreement of the index and the number of sample rates are of all sources together.

    files: path, actual_s, and where known channels, width, rate (:func:`~tidewords.sources.landed.wav_info`). clips without
    duration_s list no durations. heard: id, heard, what was recognized again from the clips. lines: line, the pipe-delimited
    index. edges: path, edge_ratio. What isn't given is unmeasured; of that only pairing counts against.
    """
    own = clips.where("source_id is not null")
    checks = verify.structure(own, files)
    share = verify.script_share(clips, sources).select("source_id", (F.col("matching") / F.col("judged")).alias("script_share"))
    out = checks.join(share, "source_id", "left").join(_off(own, files), "source_id", "left").join(_unfit(own, files), "source_id", "left")
    left = merge.orphans(files, clips, sources).groupBy(merge.owner("path").alias("source_id")).agg(F.count("*").alias("orphans"))
    out = out.join(left, "source_id", "full").join(_hot(own, files, edges), "source_id", "left")
    out = out.fillna(0, ["rows", "missing", "duplicated", "empty", "control", "off", "unfit", "orphans"])
    out = out.crossJoin(F.broadcast(_rates(own, files)))  # one row, as are those below
    if lines is None:
        out = out.withColumn("malformed", F.lit(None).cast("bigint")).withColumn("mismatched", F.lit(None).cast("bigint"))
    else:
        out = out.crossJoin(F.broadcast(verify.csv_mismatch(clips, lines)))
    if heard is None:
        out = out.withColumn("pairing_mean", F.lit(None).cast("double")).withColumn("pairing_gap", F.lit(None).cast("double"))
    else:
        rows = clips.select("id", "text").where("id is not null").groupBy("id").agg(F.max("text").alias("text")).join(heard.groupBy("id").agg(F.max("heard").alias("heard")), "id")
        measured = verify.pairing(verify.controls(verify.sampled(rows, sample, seed))).select("pairing_mean", "pairing_gap")
        out = out.crossJoin(F.broadcast(measured))
    fatal = (F.col("missing") > 0) | (F.col("duplicated") > 0) | (F.col("empty") > 0) | (F.col("control") > 0) | (F.col("off") > 0) | (F.col("unfit") > 0) | (F.col("rates") > 1)
    soft = (F.col("orphans") > 0) | (F.coalesce("malformed", F.lit(0)) > 0) | (F.coalesce("mismatched", F.lit(0)) > 0)
    v = verify.verdict(F.col("pairing_gap"), F.col("pairing_mean"), F.col("script_share"), F.col("hot_edges"), fatal=fatal, soft=soft)
    return out.withColumn("v", v).select(*out.columns, F.col("v.verdict").alias("verdict"), F.col("v.reasons").alias("reasons"))


def heard_again(clips: DataFrame, root: str, recognize: Callable[[str], list[dict]], *, sample: int = 8, seed: int = 0) -> DataFrame:
    """``id, heard, error`` of a sample of clips, recognized again by an outside ``recognize(path)``, which gives rows with ``text`` for the
    file at ``root/audio_path``. A file it fails for has its error and no text."""
    some = verify.sampled(clips.where("id is not null and audio_path is not null").select("id", "audio_path").dropDuplicates(["id"]), sample, seed)
    some = settle(some.select("id", F.concat(F.lit(root.rstrip("/") + "/"), "audio_path").alias("path")), "sample")
    said = landed.recognized(some.select("path"), recognize, "text string")
    text = F.array_join(F.collect_list("text"), " ")
    return some.join(said.groupBy("path").agg(F.when(F.count("text") > 0, text).alias("heard"), F.max("error").alias("error")), "path", "left").select("id", "heard", "error")


def verify_folder(spark: SparkSession, root: str, heard: DataFrame | None = None, *, recognize: Callable[[str], list[dict]] | None = None, language: str | None = None, sample: int = 8, seed: int = 0) -> tuple[dict, list[dict], list[str], list[dict]]:
    """A dataset folder measured and judged: the measures with the verdict, the checks, what speaks against it in sentences, and
    the pairs that were compared. The first index of landed.INDEXES that is there counts; language and model are the card's.

    heard: id, heard, what was recognized again from clips; or recognize, which hears a sample of them. Without either pairing is
    unmeasured, which is marginal.
    """
    root = root.rstrip("/")
    clips, kind = landed.index_scan(spark, root)
    clips = settle(clips, "index")
    if heard is None and recognize is not None and sample > 0:
        heard = heard_again(clips, root, recognize, sample=sample, seed=seed).where("heard is not null")
    files = settle(landed.wav_listing(spark, root), "files")  # the audio is read once
    said = landed.read_card(spark, root).first()
    language = language or said.language
    csv = f"{root}/{landed.INDEXES['ljspeech']}"
    lines = spark.read.text(csv).withColumnRenamed("value", "line") if kind == "manifest" and landed.exists(spark, csv) else None
    found = [r.asDict() for r in verify.checks(clips, files, lines).orderBy("place").collect()]  # seven rows at most
    one = spark.createDataFrame([("all", language)], "source_id string, language string")
    share = verify.script_share(clips.withColumn("source_id", F.lit("all")), one).select((F.col("matching") / F.col("judged")).alias("script_share"))
    used = clips.select(F.col("audio_path").alias("path"), "id").distinct().join(files, "path")
    edges = verify.hot_share(used.withColumn("one", F.lit(1)), ["one"]).select("hot_edges")
    total = used.select("path", "actual_s").distinct().agg(F.sum("actual_s").alias("seconds"))
    pairs: list[dict] = []
    v = {"clips": clips.count(), "language": language, "model": said.model, "index": kind, "pairing_mean": None, "pairing_median": None, "control_mean": None, "pairing_gap": None}
    for df in (share, edges, total):
        got = df.first()
        v |= got.asDict() if got else dict.fromkeys(df.columns)
    if heard is not None and sample > 0:
        rows = clips.where("id is not null").groupBy("id").agg(F.max("text").alias("text")).join(heard.groupBy("id").agg(F.max("heard").alias("heard")), "id")
        compared = verify.controls(verify.sampled(rows, sample, seed))
        v |= verify.pairing(compared).first().asDict()
        pairs = [r.asDict() for r in compared.orderBy("h").select(F.col("id").alias("clip"), F.round(verify.similarity("heard", "text"), 3).alias("own"), F.round(verify.similarity("heard", "control"), 3).alias("control"), "heard").collect()]
    broken, untidy = (any(not c["ok"] and c["fatal"] is fatal for c in found) for fatal in (True, False))
    lit = lambda k: F.lit(v[k]).cast("double")
    judged = verify.verdict(lit("pairing_gap"), lit("pairing_mean"), lit("script_share"), lit("hot_edges"), fatal=F.lit(broken), soft=F.lit(untidy))
    v["verdict"] = spark.range(1).select(judged["verdict"]).first()[0]
    return v, found, verify.sentences(v, [c for c in found if not c["ok"]]), pairs


def _off(own: DataFrame, files: DataFrame) -> DataFrame:
    """``source_id, off``: clips of each source whose listed duration isn't that of their file."""
    if "duration_s" not in own.columns:
        return own.groupBy("source_id").agg(F.lit(0).cast("bigint").alias("off"))
    finite = lambda c: F.when(F.abs(c) < 1e9, F.col(c)).cast("double").alias(c)
    named = own.select(F.struct("source_id", "id").alias("id"), "audio_path", finite("duration_s"))
    return verify.duration_off(named, files.select("path", finite("actual_s"))).groupBy("id.source_id").agg(F.count("*").alias("off"))


def _used(own: DataFrame, files: DataFrame, cols: list[str]) -> DataFrame:
    """``source_id, path`` and ``cols`` of the files that clips refer to."""
    return own.select("source_id", F.col("audio_path").alias("path")).distinct().join(files.select("path", *cols), "path")


def _unfit(own: DataFrame, files: DataFrame) -> DataFrame:
    """``source_id, unfit``: files of each source that can't be read or aren't mono and of 16 bits."""
    if not {"channels", "width"} <= set(files.columns):
        return own.groupBy("source_id").agg(F.lit(0).cast("bigint").alias("unfit"))
    fit = F.coalesce((F.col("channels") == 1) & (F.col("width") == 2), F.lit(False))
    return _used(own, files, ["channels", "width"]).where(~fit).groupBy("source_id").agg(F.countDistinct("path").alias("unfit"))


def _rates(own: DataFrame, files: DataFrame) -> DataFrame:
    """``rates``: in one row the number of sample rates; null where the listing has none."""
    if "rate" not in files.columns:
        return own.sparkSession.createDataFrame([(None,)], "rates bigint")
    return _used(own, files, ["rate"]).agg(F.countDistinct("rate").alias("rates"))


def _hot(own: DataFrame, files: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``source_id, hot_edges``: of the clips whose file is there and measured, the share with loud edges."""
    if edges is None:
        return own.select("source_id").distinct().withColumn("hot_edges", F.lit(None).cast("double"))
    ratio = edges.where("edge_ratio is not null and not isnan(edge_ratio)").groupBy(F.col("path").alias("audio_path")).agg(F.max("edge_ratio").alias("r"))
    here = ratio.join(files.select(F.col("path").alias("audio_path")), "audio_path", "left_semi")
    one = own.select("source_id", "id", "audio_path").distinct().join(here, "audio_path")
    return one.groupBy("source_id").agg(F.avg((F.col("r") > verify.HOT).cast("double")).alias("hot_edges"))

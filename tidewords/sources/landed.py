"""Landed inputs brought to the model's tables: metadata, listings, feeds, caption tracks, recognizer words, index files.

Fetching media, recognizing speech and telling speakers apart stay outside; what they leave behind is read here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.errors import SourceError
from tidewords.functions.exact import loud_edges, unescape
from tidewords.functions.text import collapse, duration_seconds, is_noise_cue, strip
from tidewords.operators import blocks

METADATA = "id string, title string, channel string, uploader string, channel_id string, duration double, webpage_url string, upload_date string, language string, chapters array<struct<start_time:double,title:string,end_time:double>>"
PLAYLIST = "title string, entries array<struct<id:string,title:string,url:string>>"
FEED_ITEM = "title string, guid string, link string, duration string, enclosure array<struct<_url:string,_type:string>>"


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """:func:`metadata` of JSON files, one object each, over several lines or one a line."""
    return metadata(spark.read.schema(METADATA).option("multiLine", "true").json(path))


def metadata(raw: DataFrame) -> DataFrame:
    """Sources out of raw metadata (METADATA): titles and channels with defaults, duration 0 where unknown. A null id is an error."""
    vid = F.when(_given(F.col("id")).isNull(), F.raise_error(F.lit("metadata without an id"))).otherwise(F.col("id"))
    chapters = F.transform("chapters", lambda c: F.struct(F.coalesce(c["start_time"], F.lit(0.0)).alias("start_time"), F.coalesce(_given(c["title"]), F.lit("Untitled")).alias("title"), F.coalesce(c["end_time"], c["start_time"], F.lit(0.0)).alias("end_time")))
    return raw.select(vid.alias("video_id"), F.coalesce(_given(F.col("title")), F.lit("Untitled")).alias("title"), F.coalesce(_given(F.col("channel")), _given(F.col("uploader")), F.lit("Unknown")).alias("channel"), F.col("webpage_url").alias("source"), F.coalesce("duration", F.lit(0.0)).alias("duration_s"), "language", F.coalesce(chapters, F.array().cast("array<struct<start_time:double,title:string,end_time:double>>")).alias("chapters"))


def playlist(raw: DataFrame, watch: str = "https://video.example/watch?v=") -> DataFrame:
    """``pos, video_id, title, url`` of a listing (PLAYLIST): entries without id are skipped, titles and URLs default to the id's.
    A listing without any such entry is an error."""
    some = F.exists(F.coalesce("entries", F.array().cast(raw.schema["entries"].dataType)), lambda e: F.coalesce(e["id"] != "", F.lit(False)))
    empty = F.raise_error(F.concat(F.lit("nothing is listed under "), F.coalesce("title", F.lit("no title")))).cast("boolean")
    e = raw.where(F.when(some, F.lit(True)).otherwise(empty)).select(F.posexplode("entries").alias("pos", "e")).where("e is not null and e.id <> ''")
    return e.select("pos", F.col("e.id").alias("video_id"), F.coalesce(_given(F.col("e.title")), F.col("e.id")).alias("title"), F.coalesce(_given(F.col("e.url")), F.concat(F.lit(watch), "e.id")).alias("url"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """``title, audio_url, duration_s, guid`` of a podcast feed's items, read as XML rows."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, guid string, link string, `itunes:duration` string, enclosure array<struct<_url:string,_type:string>>").load(path)
    return episodes(items.withColumnRenamed("itunes:duration", "duration"))


def show(spark: SparkSession, path: str) -> DataFrame:
    """``title`` of each feed, ``Podcast`` where it has none."""
    feeds = spark.read.format("xml").option("rowTag", "channel").schema("title string").load(path)
    return feeds.select(F.coalesce(_given(strip(F.col("title"))), F.lit("Podcast")).alias("title"))


def episodes(items: DataFrame) -> DataFrame:
    """``title, audio_url, duration_s, guid`` of feed items (FEED_ITEM)."""
    return items.select(F.coalesce(_given(F.col("title")), F.lit("Untitled episode")).alias("title"), enclosure(F.col("enclosure")).alias("audio_url"), F.coalesce(duration_seconds(F.col("duration")), F.lit(0.0)).alias("duration_s"), F.coalesce(_given(F.col("guid")), _given(F.col("link")), F.lit("")).alias("guid"))


def enclosure(enclosures: Column) -> Column:
    """URL of the first audio enclosure, else of the first that has one, else null."""
    has = lambda e: _given(e["_url"]).isNotNull()
    audio = F.get(F.filter(enclosures, lambda e: has(e) & F.coalesce(e["_type"].startswith("audio"), F.lit(False))), F.lit(0))
    return F.coalesce(audio["_url"], F.get(F.filter(enclosures, has), F.lit(0))["_url"])


def track_choice(tracks: DataFrame, requested: Column) -> DataFrame:
    """``source_id, language_code, is_generated`` of the best caption track of each source.

    tracks: source_id, pos, language_code, is_generated. Manual before generated in the language asked for
    (``en`` takes ``en-GB``), then any manual, then any generated; in list order.
    """
    matches = (F.col("language_code") == requested) | F.col("language_code").startswith(F.concat(requested, F.lit("-")))
    rank = F.when(F.coalesce(matches, F.lit(False)), 0).otherwise(2) + F.when(F.col("is_generated"), 1).otherwise(0)
    best = tracks.where("source_id is not null").groupBy("source_id").agg(F.min(F.struct(rank.alias("rank"), "pos", "language_code", "is_generated")).alias("t"))
    return best.select("source_id", F.col("t.language_code").alias("language_code"), F.col("t.is_generated").alias("is_generated"))


def fetched_track(tracks: DataFrame, requested: Column, fetched: DataFrame) -> DataFrame:
    """Rows of ``fetched`` (source_id, language_code, is_generated, ...) of the track that :func:`track_choice` picks."""
    return fetched.join(track_choice(tracks, requested), ["source_id", "language_code", "is_generated"], "left_semi")


def snippets(raw: DataFrame) -> DataFrame:
    """``source_id, pos, text, start_s, end_s`` of caption snippets (source_id, pos, text, start, duration): entities
    resolved, white space collapsed, blank snippets and lone sound cues dropped."""
    df = raw.withColumn("text", collapse(unescape(F.col("text")))).where(F.col("text") != "")
    return df.where(~is_noise_cue(F.col("text"))).select("source_id", "pos", "text", F.col("start").alias("start_s"), (F.col("start") + F.coalesce("duration", F.lit(0.0))).alias("end_s"))


def whisper_words(raw: DataFrame) -> DataFrame:
    """Model words of recognizer words (source_id, pos, word, start, end, probability).

    Null and blank words are dropped; one without a leading space joins the word before; probabilities go into
    [0, 1], bad ones are 1; a start that isn't finite is 0, such an end is the start.
    """
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    start = F.coalesce(finite("start"), F.lit(0.0))
    df = raw.where(strip(F.col("word")) != "")
    return df.select("source_id", "pos", strip(F.col("word")).alias("text"), start.alias("start_s"), F.coalesce(finite("end"), start).alias("end_s"), F.least(F.greatest(F.coalesce(finite("probability"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), (~F.col("word").rlike(r"^[ \x{a0}]")).alias("joins_left"))


def token_words(raw: DataFrame, starts: Column, text: Column) -> DataFrame:
    """``source_id, word_no, text, start_s, end_s, confidence`` of words put together from tokens.

    raw: source_id, pos, start_s, end_s, confidence. A word begins where ``starts`` is true and at the first token;
    its text is the tokens', its end the last token's, its confidence their geometric mean.
    """
    df = raw.withColumn("__t", text).withColumn("__s", F.coalesce(starts, F.lit(True)).cast("bigint"))
    df = blocks.running(df, ["source_id"], "pos", F.col("__s"), "word_no")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("__t", F.lit("")).alias("t")))), lambda x: x["t"])
    mean = F.exp(F.avg(F.ln(F.coalesce("confidence", F.lit(1.0)) + 1e-10)))
    return df.groupBy("source_id", "word_no").agg(strip(F.array_join(parts, "")).alias("text"), F.min_by("start_s", "pos").alias("start_s"), F.max_by("end_s", "pos").alias("end_s"), mean.alias("confidence")).where("text <> ''")


def index_rows(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``id, audio_path, text, duration_s`` of an index: ``manifest`` or ``audiofolder`` (JSON lines), ``ljspeech`` (``id|text|text``)."""
    stem = lambda p: F.regexp_extract(p, r"([^/]+?)(?:\.[^./]*)?$", 1)
    if kind == "manifest":
        df = spark.read.schema("audio_filepath string, duration double, text string, offset double, speaker string").json(f"{root}/manifest.jsonl")
        return df.select(stem(F.col("audio_filepath")).alias("id"), F.col("audio_filepath").alias("audio_path"), "text", F.col("duration").alias("duration_s"))
    if kind == "audiofolder":
        df = spark.read.schema("file_name string, transcription string").json(f"{root}/metadata.jsonl")
        return df.select(stem(F.col("file_name")).alias("id"), F.col("file_name").alias("audio_path"), F.col("transcription").alias("text"), F.lit(None).cast("double").alias("duration_s"))
    if kind == "ljspeech":
        df = spark.read.text(f"{root}/metadata.csv").where("value <> ''")
        cut = F.split("value", r"\|")
        df = df.where(strip(F.col("value")) != "")
        return df.select(cut[0].alias("id"), F.concat(F.lit("wavs/"), cut[0], F.lit(".wav")).alias("audio_path"), F.when(F.size(cut) > 1, F.element_at(cut, -1)).otherwise("").alias("text"), F.lit(None).cast("double").alias("duration_s"))
    raise ValueError(f"no such index: {kind}")


#: Names of index files by kind, the one that tells most first.
INDEXES = {"manifest": "manifest.jsonl", "ljspeech": "metadata.csv", "audiofolder": "metadata.jsonl"}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def index_scan(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """:func:`index_rows` of the first index in the order of INDEXES that a folder has, and that index's kind; without any it is
    an error."""
    for kind, name in INDEXES.items():
        if exists(spark, f"{root.rstrip('/')}/{name}"):
            return index_rows(spark, root.rstrip("/"), kind), kind
    raise SourceError(f"{root} has no index", f"One of {', '.join(INDEXES.values())} is needed.")


# Where a card says its language and how it was recognized.
_LANGUAGE = r'(?m)^language:\s*\n-\s*"?([A-Za-z-]+)"?'
_METHOD = r"\*\*transcription_method:\*\*\s*(\S+)"


def card_facts(cards: DataFrame) -> DataFrame:
    """``language, model`` that each dataset card (column ``text``) declares; null where it doesn't, or the language is ``und``."""
    language, method = F.regexp_extract("text", _LANGUAGE, 1), F.regexp_extract("text", _METHOD, 1)
    model = F.when(F.startswith(method, F.lit("whisper-")), F.substr(method, F.lit(9))).when(F.startswith(method, F.lit("parakeet")), "parakeet")
    return cards.select(F.when(~language.isin("", "und"), language).alias("language"), model.alias("model"))


def read_card(spark: SparkSession, root: str) -> DataFrame:
    """:func:`card_facts` of a folder's card; nulls without one."""
    at = f"{root.rstrip('/')}/dataset_card.md"
    if not exists(spark, at):
        return spark.createDataFrame([(None, None)], "language string, model string")
    return card_facts(spark.read.text(at, wholetext=True).withColumnRenamed("value", "text"))


def wav_info(files: DataFrame, *, edges: bool = False) -> DataFrame:
    """``path, channels, width, rate, actual_s`` of PCM files (``spark.read.format("binaryFile")``); nulls if unreadable.

    With ``edges`` also ``edge_ratio``, :func:`~tidewords.functions.exact.loud_edges` of 16-bit files, of several channels their mean.
    """
    import io
    import wave

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("content"):
                try:
                    with wave.open(io.BytesIO(data.as_py())) as w:
                        rows.append((w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes() / w.getframerate(), ratio(w) if edges else None))
                except (wave.Error, EOFError, ZeroDivisionError, TypeError):
                    rows.append((None,) * 5)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [batch.column("path"), *(pa.array(c, pa.int32()) for c in cols[:3]), *(pa.array(c, pa.float64()) for c in cols[3:])]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    def ratio(w: wave.Wave_read) -> float | None:
        if w.getsampwidth() != 2:
            return None
        raw, k = w.readframes(w.getnframes()), w.getnchannels()
        x = np.frombuffer(raw[: len(raw) // (2 * k) * 2 * k], np.int16).astype(np.float32) / 32768
        return loud_edges(x.reshape(-1, k).mean(axis=1), w.getframerate())

    names = ["path", "channels", "width", "rate", "actual_s", *["edge_ratio"] * edges]
    return files.select("path", "content").mapInArrow(run, "path string, channels int, width int, rate int, actual_s double" + ", edge_ratio double" * edges)


def wav_listing(spark: SparkSession, root: str) -> DataFrame:
    """:func:`wav_info` with edges of every ``.wav`` file under a folder; paths are relative to it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(root)
    return wav_info(found.withColumn("path", F.substr("path", F.lit(len(at) + 2))), edges=True)


def recognized(files: DataFrame, recognize: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """Rows that an outside ``recognize(path)`` gives for each file's path, with ``path, error``; one file's failure is its row's
    error and stops no other. The callable makes its model once per worker."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path in batch.column("path").to_pylist():
                try:
                    out += [{"path": path, "error": None} | {n: r.get(n) for n in names} for r in recognize(path)]
                except Exception as e:  # noqa: BLE001 - any failure of the outside engine belongs to its file
                    out.append({"path": path, "error": str(e) or type(e).__name__} | dict.fromkeys(names))
            yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = f"path string, error string, {schema}"
    target = to_arrow_schema(StructType.fromDDL(whole))
    return files.select("path").mapInArrow(run, whole)

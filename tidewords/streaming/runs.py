"""Runs of events as they arrive, and builds that can be repeated."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewords.operators import blocks, intervals, merge
from tidewords.sources.landed import exists


def sessions(events: DataFrame, *, pause: str = "6 hours", late: str | None = "1 day") -> DataFrame:
    """``user_id, start_ts, end_ts, n, total`` of runs of events no farther apart than ``pause``, in batch or streaming.

    events: ts, user_id, value. In a stream rows later than ``late`` behind the newest are dropped, and a run
    comes out once the watermark has passed it. In batch a user's events are ranked and compared in blocks, so that a
    user with a third of all events is spread over tasks.
    """
    df = events.where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if not df.isStreaming:
        df = blocks.ranked(df.select("user_id", "ts", "value"), ["user_id"], ["ts"], "n").withColumn("n", F.col("n").cast("bigint"))
        df = blocks.neighbours(df, ["user_id"], "n", ["ts"]).drop("next")
        apart = F.col("prev").isNull() | (F.col("ts") > F.col("prev.ts") + F.expr(f"interval {pause}"))
        df = blocks.running(df, ["user_id"], "n", apart.cast("bigint"), "no").drop("prev")
        out = df.groupBy("user_id", "no").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        return out.select("user_id", "start_ts", "end_ts", "n", "total")
    if late:
        df = df.withWatermark("ts", late)
    out = df.groupBy("user_id", F.session_window("ts", pause).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_ts"))
    return out.select("user_id", F.col("w.start").alias("start_ts"), F.col("last_ts").alias("end_ts"), "n", "total")


def speech_runs(lines: DataFrame, *, pause_s: float = 2.0, late: str | None = "1 hour") -> DataFrame:
    """``source_id, start_ms, end_ms`` of runs of lines (source_id, start_s, end_s) that no pause of more than ``pause_s`` parts,
    measured from the farthest end so far to the next start; in batch or streaming.

    In batch a sweep in blocks of time, so that no task gets a whole source; in a stream session windows whose gap
    is a line's own length and the pause. Lines without two finite times in order count for nothing.
    """
    pause = round(pause_s * 1000)
    if not lines.isStreaming:
        spans = intervals.spans(lines, F.col("source_id"))
        runs = intervals.periods(spans.withColumn("end_ms", F.col("end_ms") + pause))
        return runs.select(F.col("key").alias("source_id"), "start_ms", (F.col("end_ms") - pause).alias("end_ms"))
    start, end = intervals.to_ms(F.col("start_s")), intervals.to_ms(F.col("end_s"))
    df = lines.where("source_id is not null").where(start.isNotNull() & end.isNotNull() & (end >= start))
    df = df.select("source_id", start.alias("start_ms"), end.alias("end_ms"), F.timestamp_millis(start).alias("ts"))
    if late:
        df = df.withWatermark("ts", late)
    gap = F.concat((F.col("end_ms") - F.col("start_ms") + pause).cast("string"), F.lit(" milliseconds"))
    return df.groupBy("source_id", F.session_window("ts", gap)).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).select("source_id", "start_ms", "end_ms")


STATE = "source_id string, fingerprint string, ok boolean, error string, clips bigint, dropped bigint, build string, built_at timestamp"


def state(spark: SparkSession, out: str, config: object) -> DataFrame:
    """The last row of each source in the state under ``out`` that was written under this config; empty if there is none."""
    at = f"{out.rstrip('/')}/state"
    rows = spark.read.schema(STATE).parquet(at) if exists(spark, at) else spark.createDataFrame([], STATE)
    names = [f.split()[0] for f in STATE.split(", ")]
    last = rows.where(F.col("fingerprint") == merge.fingerprint(config)).groupBy("source_id").agg(F.max(F.struct("built_at", *[n for n in names if n not in ("built_at", "source_id")])).alias("r"))
    return last.select("source_id", *[F.col(f"r.{n}").alias(n) for n in names if n != "source_id"])


def built(spark: SparkSession, out: str, config: object) -> DataFrame:
    """The clips under ``out`` that this config's last good builds made, one build for each source."""
    at = f"{out.rstrip('/')}/clips"
    clips = spark.read.parquet(at)
    good = state(spark, out, config).where("ok").select("source_id", "build")
    return clips.withColumn("build", F.col("build").cast("string")).join(good, ["source_id", "build"], "left_semi").drop("build")


def build_resumed(sources: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, config: object, *, files: DataFrame | None = None, number: str | None = None) -> DataFrame:
    """Builds the sources that aren't built well under this config yet; the outcomes of those, as in ``state``.

    ``build(sources)`` gives clips (with source_id) and drops (with clip, filter and what else). A source is taken over if its last
    build under the config's fingerprint went well and, where ``files`` (path) are given, all of its clips' audio is there; another
    config finds no state and builds anew. Clips and drops go to ``out/clips/build=N``, outcomes to ``out/state`` once these
    are written; a run that fails in between leaves nothing that counts, and is repeated under the same ``number`` over itself.
    """
    spark, out, mark = sources.sparkSession, out.rstrip("/"), merge.fingerprint(config)
    done = state(spark, out, config)
    if files is not None and exists(spark, f"{out}/clips"):
        paths = built(spark, out, config).select("source_id", F.col("audio_path").alias("path"))
        keep = merge.reusable(sources, done, files, mark, paths)
    else:
        keep = done.where("ok").select("source_id")
    todo = sources.join(keep, "source_id", "left_anti")
    number = number or uuid.uuid4().hex[:12]
    clips, drops = build(todo)
    clips.write.mode("overwrite").parquet(f"{out}/clips/build={number}")
    drops.write.mode("overwrite").parquet(f"{out}/drops/build={number}")
    made, lost = spark.read.schema(clips.schema).parquet(f"{out}/clips/build={number}"), spark.read.schema(drops.schema).parquet(f"{out}/drops/build={number}")
    if "source_id" not in lost.columns:
        lost = lost.withColumn("source_id", F.regexp_extract("clip", r"^(.*)_(?:seg)?\d+$", 1))
    tried = todo.select("source_id", F.lit(None).cast("string").alias("error"))
    rows = merge.outcome(made, lost, tried).select("source_id", F.lit(mark).alias("fingerprint"), "ok", "error", "clips", "dropped", F.lit(number).alias("build"), F.current_timestamp().alias("built_at"))
    rows.write.mode("append").parquet(f"{out}/state")
    return spark.read.schema(STATE).parquet(f"{out}/state").where(F.col("build") == number)


def build_increments(sources: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, config: object) -> StreamingQuery:
    """Starts a stream that builds each batch of sources with :func:`build_resumed`, numbered by batch and config: a batch that is
    run again after a failure overwrites what it wrote. The checkpoint lies in a folder of the config's fingerprint, so that
    another config starts anew."""
    mark = merge.fingerprint(config)

    def write(batch: DataFrame, number: int) -> None:
        build_resumed(batch, build, out, config, number=f"{mark[:12]}-{number}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{mark}").trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict[str, float]:
    """Of a running or finished stream: ``batches`` and ``rows`` that its recent progress tells of, ``seconds`` they took, ``done``."""
    recent = query.recentProgress
    took = lambda p: p["durationMs"].get("triggerExecution", 0)
    return {"batches": len(recent), "rows": sum(p["numInputRows"] for p in recent), "seconds": sum(map(took, recent)) / 1000, "done": float(not query.isActive)}

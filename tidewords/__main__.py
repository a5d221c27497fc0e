"""``python -m tidewords transcripts|dataset|verify DATA OUT``: the three pipelines.

transcripts and dataset read a folder of Parquet tables. dataset takes over what an earlier run with the same options built, and
writes the indexes, the card and the drop log of all. verify reads a dataset folder, its index, card and WAV files, and writes
verification.md and verification.json; or, where DATA holds a table of clips, it measures the WAV files under ``--audio`` (else
DATA) and DATA's metadata.csv, and writes a Parquet report by source.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewords.errors import TidewordsError
from tidewords.operators import merge
from tidewords.plans import pipelines
from tidewords.session import put, read, settle
from tidewords.sinks import rows
from tidewords.sinks.named import write_named
from tidewords.sources import landed
from tidewords.streaming import runs

#: Exit codes by verdict, and of an error that was foreseen.
CODES, FAILED = {"trainable": 0, "marginal": 1, "not trainable": 2}, 3


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 all done, for verify trainable; 1 some sources failed, or marginal; 2 all failed, or not trainable; 3 an error."""
    p = argparse.ArgumentParser(prog="tidewords", description=__doc__)
    p.add_argument("what", choices=("transcripts", "dataset", "verify"))
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("--json", action="store_true", help="transcripts: a JSON file beside each transcript")
    p.add_argument("--speakers", choices=("tag", "dominant", "per_speaker"))
    p.add_argument("--language")
    p.add_argument("--format", action="append", choices=tuple(rows.FORMATS), help="dataset: an index to write, any number of times")
    p.add_argument("--audio", help="verify: the folder with the audio files of a table of clips")
    p.add_argument("--version", action="version", version=_version())
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidewords").getOrCreate()
    try:
        return {"transcripts": _transcripts, "dataset": _dataset, "verify": _verify}[a.what](spark, a)
    except TidewordsError as e:
        print(f"{e.message}\n{e.hint}".strip(), file=sys.stderr)
        return FAILED


def _version() -> str:
    from tidewords import __version__

    return __version__


def _transcripts(spark: SparkSession, a: argparse.Namespace) -> int:
    sources = read(spark, a.data, "sources")
    chunks = settle(pipelines.transcripts(sources, read(spark, a.data, "segments")), "chunks")
    write_named(rows.markdown(sources, chunks).withColumnRenamed("source_id", "name"), a.out)
    if a.json:
        write_named(rows.sidecar(sources, chunks).withColumnRenamed("source_id", "name"), a.out, separator="\n", suffix=".json")
    return 0


def _dataset(spark: SparkSession, a: argparse.Namespace) -> int:
    formats = a.format or ["jsonl", "ljspeech"]
    for warning in rows.checked_formats(formats):
        print(warning, file=sys.stderr)
    cfg = pipelines.DatasetConfig(speaker_mode=a.speakers, target_language=a.language)
    table = lambda name: read(spark, a.data, name)
    sources = table("sources").where("source_id is not null")

    def build(todo):
        own = todo.select("source_id").distinct()
        turns = table("turns") if a.speakers else None
        return pipelines.dataset(table("words").join(own, "source_id", "left_semi"), todo, turns, cfg)

    runs.build_resumed(sources, build, a.out, cfg)
    clips, state = runs.built(spark, a.out, cfg), settle(runs.state(spark, a.out, cfg), "state")
    rows.write_indices(clips, a.out, formats)
    lost = spark.read.parquet(f"{a.out}/drops").withColumn("build", F.col("build").cast("string")).join(state.select("build").distinct(), "build", "left_semi")
    rows.write_drops(lost, f"{a.out}/dropped.jsonl")
    if a.speakers == "per_speaker":
        rows.write_by_speaker(clips, f"{a.out}/by_speaker", formats)
    total, done = merge.totals(clips).where("source_id is null").first(), merge.succeeded(state).first()
    language = a.language or merge.language_vote(sources.select("language").distinct()).first().language
    dropped = {r["filter"]: r.n for r in lost.groupBy("filter").agg(F.count("*").alias("n")).collect()}  # a row per filter
    methods = [r.method for r in sources.select("method").distinct().limit(2).collect()]
    listed = [r.asDict() for r in state.orderBy("source_id").limit(LISTED).collect()]  # what a card has room for
    put(spark, f"{a.out}/dataset_card.md", rows.card(a.data.rstrip("/").split("/")[-1], total.clips if total else 0, (total.total_ms if total else 0) / 1000, language, methods[0] if len(methods) == 1 else "", dropped, sources=listed, oversized=total.oversized if total else 0, formats=tuple(formats), origin=a.data))
    return 0 if not done.failed else 1 if done.succeeded else 2


#: Sources that a card lists; state has them all.
LISTED = 1_000


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    if not landed.exists(spark, f"{a.data.rstrip('/')}/clips.parquet"):
        v, checks, reasons, pairs = pipelines.verify_folder(spark, a.data, language=a.language)
        v["verified_at"] = dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        md, js = rows.report(v, checks, reasons, pairs)
        put(spark, f"{a.out}/verification.md", md)
        put(spark, f"{a.out}/verification.json", js)
        print(v["verdict"], *reasons, sep="\n")
        return CODES[v["verdict"]]
    root = (a.audio or a.data).rstrip("/")
    files = settle(landed.wav_listing(spark, root), "files")  # the audio is read once
    index = f"{root}/metadata.csv"
    lines = spark.read.text(index).withColumnRenamed("value", "line") if landed.exists(spark, index) else None
    report = pipelines.verification(read(spark, a.data, "clips"), files, read(spark, a.data, "sources"), lines=lines, edges=files.select("path", "edge_ratio"))
    report.write.mode("overwrite").parquet(a.out)
    worst = [r.verdict for r in spark.read.parquet(a.out).select("verdict").distinct().collect()]
    return max((CODES[v] for v in worst), default=0)


if __name__ == "__main__":
    sys.exit(main())

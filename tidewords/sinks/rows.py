"""What goes into files: index lines, manifests, transcripts, cards. All are columns first, then plain writers."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewords.errors import DatasetError
from tidewords.functions.exact import wrapped
from tidewords.functions.text import collapse, format_timestamp, pipe_safe, utc_stamp
from tidewords.operators import blocks


def ljspeech_line() -> Column:
    t = pipe_safe(F.coalesce("text", F.lit("")))
    return F.concat_ws("|", "id", t, t)


def ljspeech(clips: DataFrame) -> DataFrame:
    """``line``: ``id|text|text`` of each clip, no header and no quoting."""
    return clips.select(ljspeech_line().alias("line"))


def manifest_line() -> Column:
    return F.to_json(F.struct(F.col("audio_path").alias("audio_filepath"), F.round("duration_s", 3).alias("duration"), "text", F.lit(0.0).alias("offset"), "speaker"))


def manifest(clips: DataFrame) -> DataFrame:
    """``line``: JSON with audio_filepath, duration to three digits, text, offset and, where known, speaker."""
    return clips.select(manifest_line().alias("line"))


def audiofolder(clips: DataFrame) -> DataFrame:
    """``line``: JSON with file_name and transcription."""
    return clips.select(F.to_json(F.struct(F.col("audio_path").alias("file_name"), F.col("text").alias("transcription"))).alias("line"))


#: Kinds of indexes, their files and their lines.
FORMATS = {"jsonl": ("manifest.jsonl", manifest), "ljspeech": ("metadata.csv", ljspeech), "hf": ("metadata.jsonl", audiofolder)}


def checked_formats(formats: list[str]) -> list[str]:
    """Warnings of formats that don't go together in one folder; a format that isn't known, or none at all, is an error."""
    strange = sorted(set(formats) - set(FORMATS))
    if strange or not formats:
        raise DatasetError(f"no such index format: {', '.join(strange) or 'none given'}", f"Known ones are {', '.join(FORMATS)}.")
    clash = {"hf", "ljspeech"} <= set(formats)
    return ["readers of audio folders take metadata.csv beside metadata.jsonl for a second index and stop; build hf without ljspeech"] if clash else []


def write_indices(clips: DataFrame, out: str, formats: list[str]) -> list[str]:
    """Writes the indexes of ``formats`` under ``out``; the warnings of :func:`checked_formats`."""
    said = checked_formats(formats)
    for f in dict.fromkeys(formats):
        name, lines = FORMATS[f]
        write_lines(lines(clips), f"{out.rstrip('/')}/{name}")
    return said


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def speaker_slug(speaker: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(speaker, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "unknown").otherwise(slug)


def write_by_speaker(clips: DataFrame, path: str, formats: list[str] | None = None) -> None:
    """One manifest folder per speaker under ``path``, and with ``ljspeech`` among the formats one of lines under ``path_ljspeech``; clips
    without speaker are left out."""
    named = clips.where("speaker is not null").withColumn("speaker_slug", speaker_slug(F.col("speaker")))
    to = {path: manifest_line()} | ({f"{path}_ljspeech": ljspeech_line()} if "ljspeech" in (formats or ()) else {})
    for folder, line in to.items():
        named.select("speaker_slug", line.alias("line")).write.mode("overwrite").partitionBy("speaker_slug").text(folder)


def write_drops(drops: DataFrame, path: str) -> None:
    """Drop records as JSON lines."""
    drops.select("clip", "filter", "value", "threshold", "text").write.mode("overwrite").json(path)


def size_category(n: Column) -> Column:
    """Bucket of a clip count as dataset cards have it."""
    return F.when(n < 1_000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").when(n < 1_000_000, "100K<n<1M").otherwise("n>1M")


def chunks(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """``source_id, pos, start_s, end_s, section, text``: flat chunks for retrieval, in order."""
    p = paragraphs.select("source_id", "para_no", "text", "start_s", "end_s").distinct()
    return p.join(sections, ["source_id", "para_no"]).select("source_id", F.col("para_no").alias("pos"), "start_s", "end_s", "section", "text")


def quoted(c: Column) -> Column:
    """A double-quoted YAML scalar: backslash and quote escaped, control characters as ``\\xNN``."""
    c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for n in [*range(32), 127]:
        c = F.replace(c, F.lit(chr(n)), F.lit(f"\\x{n:02x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def markdown(sources: DataFrame, chunked: DataFrame) -> DataFrame:
    """``source_id, line_no, line``: each source's transcript as Markdown: front matter, title, sections, stamped paragraphs.

    One row per block of lines, so that no source is put together in one task; ``line_no`` orders them.
    """
    keys = ("title", "source", "channel", "duration", "language", "method", "ingested_at")
    src = sources.groupBy("source_id").agg(F.max(F.struct("title", "source", "channel", "duration_s", "language", "method", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at"))).alias("s"))
    value = {k: F.col(f"s.{k}") for k in keys if k != "duration"} | {"duration": format_timestamp(F.col("s.duration_s"))}
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), quoted(value[k])) for k in keys], F.lit("---"), F.lit(""), F.concat(F.lit("# "), collapse(F.coalesce("s.title", F.lit("Untitled")))))
    heads = src.select("source_id", F.lit(-1).cast("double").alias("line_no"), head.alias("line"))
    first = chunked.groupBy("source_id", "section").agg(F.min("pos").alias("pos"))
    titles = first.select("source_id", (F.col("pos") - 0.5).alias("line_no"), F.concat(F.lit("## "), collapse(F.coalesce("section", F.lit("")))).alias("line"))
    body = wrapped(F.concat(F.lit("**["), format_timestamp(F.col("start_s")), F.lit("]** "), F.coalesce("text", F.lit(""))))
    paras = chunked.select("source_id", F.col("pos").cast("double").alias("line_no"), body.alias("line"))
    return heads.unionByName(titles).unionByName(paras)


def sidecar(sources: DataFrame, chunked: DataFrame) -> DataFrame:
    """``source_id, line_no, line``: each source's transcript as one JSON object: title, source, channel, duration, ingested, method,
    language and, last, chunks of start_s, end_s, section and text.

    One row per line, as in :func:`markdown`: the head, a line for each chunk, the end; together they are the object. Sources
    without chunks have an empty list. Absent values are empty strings, unknown languages ``und``.
    """
    src = sources.where("source_id is not null").groupBy("source_id").agg(F.max(F.struct("ingested_at", "title", "source", "channel", "duration_s", "method", "language")).alias("s"))
    text = lambda c, other="": F.coalesce(F.col(f"s.{c}"), F.lit(other)).alias(c)
    head = F.to_json(F.struct(text("title", "Untitled"), text("source"), text("channel", "Unknown"), F.coalesce(format_timestamp(F.col("s.duration_s")), F.lit("00:00:00")).alias("duration"), F.coalesce(utc_stamp(F.col("s.ingested_at")), F.lit("")).alias("ingested"), text("method"), text("language", "und")))
    heads = src.withColumn("h", head).select("source_id", F.lit(-1.0).alias("line_no"), F.concat(F.expr("substr(h, 1, length(h) - 1)"), F.lit(',"chunks":[')).alias("line"))
    ends = src.select("source_id", F.lit(1e15).alias("line_no"), F.lit("]}").alias("line"))
    last = chunked.groupBy("source_id").agg(F.max("pos").alias("last"))
    body = F.to_json(F.struct("start_s", "end_s", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("text", F.lit("")).alias("text")))
    lines = blocks.lookup(chunked, src.select("source_id").join(last, "source_id"), ["source_id"], ["pos"], "inner")
    lines = lines.select("source_id", F.col("pos").cast("double").alias("line_no"), F.concat(body, F.when(F.col("pos") < F.col("last"), ",").otherwise("")).alias("line"))
    return heads.unionByName(lines).unionByName(ends)


def _rows(table: list[tuple]) -> str:
    return "".join("| " + " | ".join(str(x).replace("|", " ") for x in r) + " |\n" for r in table)


def size_name(n: int) -> str:
    """:func:`size_category` of a number."""
    return next((name for most, name in ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M")) if n < most), "n>1M")


def card(name: str, clips: int, seconds: float, language: str, model: str, dropped: dict[str, int], *, sources: list[dict] | None = None, oversized: int = 0, rate: int = 22_050, formats: tuple[str, ...] = ("jsonl",), origin: str = "") -> str:
    """A dataset card from totals that were aggregated before. ``sources``, rows of :func:`~tidewords.operators.merge.outcome`, make
    it the card of a merged dataset: a table of those that went well, and a list of the others with their errors.
    :func:`~tidewords.sources.landed.card_facts` reads language and model back."""
    quote = lambda x: json.dumps(x, ensure_ascii=False)
    head = f"---\nlicense: unknown\nlanguage:\n- {quote(language)}\ntask_categories:\n- automatic-speech-recognition\n- text-to-speech\npretty_name: {quote(name)}\nsize_categories:\n- {size_name(clips)}\n---\n\n# {name}\n\n"
    more = f", {oversized} of them over the limit of length" if oversized else ""
    facts = f"{clips} clips{more}, {seconds / 60:.1f} minutes; mono, 16 bits, {rate} Hz. Indexes: {', '.join(formats)}.\n\n- **language:** {language}\n- **transcription_method:** {model or 'unknown'}\n" + (f"- **source:** {origin}\n" if origin else "")
    lost = "\n| dropped for | clips |\n| --- | --- |\n" + _rows(sorted(dropped.items())) if dropped else ""
    parts = ""
    if sources is not None:
        good, bad = [s for s in sources if s["ok"]], [s for s in sources if not s["ok"]]
        parts = f"\nMerged from {len(good)} sources, {len(bad)} left out.\n\n| source | clips | dropped |\n| --- | --- | --- |\n" + _rows([(s["source_id"], s["clips"], s["dropped"]) for s in good])
        parts += "".join(f"\n- left out: {s['source_id']}, {s['error']}" for s in bad) + ("\n" if bad else "")
    return head + facts + lost + parts + "\nVoices belong to people. Whoever uses this set must have the right to, and consent where it is needed.\n"


def report(v: dict, checks: list[dict], reasons: list[str], pairs: list[dict] = ()) -> tuple[str, str]:
    """A verification as Markdown and as JSON. v: verdict, clips, seconds, language, model, verified_at and the measures; pairs: rows of
    clip, own, control, heard."""
    num = lambda x: "n/a" if x is None else f"{x:.3f}"
    pct = lambda x: "n/a" if x is None else f"{x:.0%}"
    measures = [("pairing gap", num(v.get("pairing_gap"))), ("own text, mean and median", f"{num(v.get('pairing_mean'))}, {num(v.get('pairing_median'))}"), ("another's text, mean", num(v.get("control_mean"))), ("script", pct(v.get("script_share"))), ("loud edges", pct(v.get("hot_edges")))]
    marks = [("passed" if c["ok"] else "failed" if c["fatal"] else "untidy", c["check"], "" if c["ok"] else c["bad"], c["example"] or "") for c in checks]
    said = "".join(f"- {r}\n" for r in reasons) or "- Nothing to report.\n"
    md = f"# Verification: {v['verdict']}\n\n{v.get('clips', 0)} clips, {(v.get('seconds') or 0) / 60:.1f} minutes, language {v.get('language') or 'unknown'}, heard again by {v.get('model') or 'nothing'}; {v.get('verified_at', '')}\n\n{said}\n"
    md += "| measure | value |\n| --- | --- |\n" + _rows(measures) + "\n| | check | rows | such as |\n| --- | --- | --- | --- |\n" + _rows(marks)
    if pairs:
        md += "\n| clip | own | another's | heard |\n| --- | --- | --- | --- |\n" + _rows([(p["clip"], num(p["own"]), num(p["control"]), (p["heard"] or "")[:60]) for p in pairs])
    return md, json.dumps({**v, "checks": checks, "reasons": reasons, "pairing": list(pairs)}, ensure_ascii=False, indent=2, default=str) + "\n"


def zipped(folder: str, to: str) -> int:
    """Packs the files of a local folder, sorted, with paths relative to it, into a zip file; their number. Hidden files and
    checksums that writers leave stay out."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.relative_to(folder))
    return len(files)

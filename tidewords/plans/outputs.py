"""Queries over what is fetched, cut, dropped, written and resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords import errors
from tidewords.functions import exact, scripts, urls
from tidewords.functions import text as tx
from tidewords.operators import cutting, filters, merge, sections, verify
from tidewords.plans import pipelines, records
from tidewords.session import read
from tidewords.sinks import rows as sinks
from tidewords.sources import landed
from tidewords.streaming import runs

# what fetching tools print, one for each source by the length of its id
LOGS = ("ERROR: Private video. Sign in", "ERROR: Video unavailable", "ERROR: confirm your age", "Sign in to confirm you're NOT A BOT", "ERROR: 'x' is not a valid URL", "WARNING: slow\nERROR: timed out", "  ")


def _log() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LOGS]), F.length("source_id") % len(LOGS) + 1)


def fetch_failures(spark: SparkSession, d: str) -> DataFrame:
    """What kind of failure each source's log tells of."""
    return records._sources(spark, d).select("source_id", errors.fetch_failure(_log()).alias("f")).select("source_id", "f.kind", "f.error", "f.tail")


def url_stems(spark: SparkSession, d: str) -> DataFrame:
    """File stems of all sources' URLs."""
    return records._sources(spark, d).select("source_id", urls.stem(F.col("source")).alias("stem"))


def media_files(spark: SparkSession, d: str) -> DataFrame:
    """Clips whose path names a medium, with its suffix."""
    return records._clips(spark, d).where(urls.is_media(F.col("audio_path"))).select("id", urls.suffix(F.col("audio_path")).alias("suffix"))


def code_checks(spark: SparkSession, d: str) -> DataFrame:
    """Labels of documents and sources, and whether a recognizer takes each as a code; the code of those that it takes."""
    labels = read(spark, d, "documents").select(F.col("lang").alias("label")).unionByName(read(spark, d, "sources").select(F.col("language").alias("label"))).distinct()
    good = scripts.is_code(F.col("label"))
    return labels.select("label", F.coalesce(good, F.lit(False)).alias("good"), scripts.checked_code(F.when(good, F.col("label"))).alias("code"))


def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sources as raw metadata has them, brought to the model; their first chapter's title."""
    raw = records._sources(spark, d).select(F.col("source_id").alias("id"), F.when(F.length("source_id") % 3 > 0, F.col("title")).otherwise("").alias("title"), F.when(F.length("source_id") % 2 > 0, F.col("channel")).alias("channel"), F.col("channel").alias("uploader"), "channel_id", F.col("duration_s").alias("duration"), F.col("source").alias("webpage_url"), "upload_date", "language", "chapters")
    return landed.metadata(raw).select("video_id", "title", "channel", "source", "duration_s", "language", F.size("chapters").alias("n_chapters"), F.get("chapters", F.lit(0))["title"].alias("first"))


def listing_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each source as a listing of two entries, one without a title and one without an id."""
    e = F.array(F.struct(F.col("source_id").alias("id"), F.lit(None).cast("string").alias("title"), F.lit("").alias("url")), F.struct(F.lit("").alias("id"), F.col("title"), F.col("source").alias("url")))
    return landed.playlist(records._sources(spark, d).select("title", e.alias("entries")))


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Sources as items of a feed: enclosures, printed durations, ids."""
    odd = F.length("source_id") % 2 > 0
    media = F.struct(F.col("source").alias("_url"), F.when(odd, "audio/mpeg").otherwise("video/mp4").alias("_type"))
    page = F.struct(F.when(odd, "").otherwise(F.concat(F.lit("https://page.example/"), "source_id")).alias("_url"), F.lit("text/html").alias("_type"))
    items = records._sources(spark, d).select("title", F.when(odd, F.col("video_id")).alias("guid"), F.col("source").alias("link"), tx.format_timestamp(F.col("duration_s")).alias("duration"), F.array(page, media).alias("enclosure"))
    return landed.episodes(items)


def fetched_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Of each channel's sources, taken as tracks, those of the track that is chosen."""
    s = records._sources(spark, d).where("channel is not null").select(F.col("channel").alias("source_id"), F.col("source_id").alias("pos"), F.coalesce("language", F.lit("")).alias("language_code"), (F.coalesce("method", F.lit("")) == "captions-auto").alias("is_generated"))
    return landed.fetched_track(s, F.lit("en"), s).select(F.col("source_id").alias("channel"), "pos", "language_code", "is_generated")


def card_facts(spark: SparkSession, d: str) -> DataFrame:
    """Language and model read back from a card made for each verification."""
    v = read(spark, d, "verifications").distinct()
    text = F.concat(F.lit('---\nlanguage:\n- "'), F.coalesce("language", F.lit("und")), F.lit('"\n---\n\n- **transcription_method:** '), F.coalesce("model", F.lit("unknown")), F.lit("\n"))
    return landed.card_facts(v.select(text.alias("text"))).groupBy("language", "model").agg(F.count("*").alias("n"))


def _cuts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and invented outcomes of cutting them: failures, empty files, loud ones."""
    c = cutting.latest(read(spark, d, "clip_candidates"), ["ref"], None).where("source_id is not null")
    kept = c.select("ref", "source_id", F.regexp_extract("ref", "([0-9]+)$", 1).cast("bigint").alias("seg"), "text")
    n = F.length(F.coalesce("text", F.lit("")))
    slices = c.select("ref", F.when(F.col("oversized").isNull() | (n % 17 == 3), "no audio there").alias("error"), F.when(n % 11 == 5, 0.005).otherwise(2.5).alias("written_s"), F.when(n % 3 > 0, (n % 13) * 0.0005).alias("clipped"))
    return kept, slices


def late_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips that were written, numbered."""
    return filters.sliced(*_cuts(spark, d), clipping=True)[0].select("ref", "clip_id")


def late_drops(spark: SparkSession, d: str) -> DataFrame:
    """Drop records of clips that failed to be cut, came out empty or are clipped."""
    return filters.sliced(*_cuts(spark, d), clipping=True)[1]


def given_up(spark: SparkSession, d: str) -> DataFrame:
    """Sources too many of whose clips failed to be cut."""
    return filters.sliced(*_cuts(spark, d))[2]


def drop_records(spark: SparkSession, d: str) -> DataFrame:
    """Drop records of candidates by the rules that need no zlib: what was measured and what was asked for."""
    return filters.drops(filters.reasons(records._candidates(spark, d), with_compression=False))


def sidecar_lines(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of all sources as JSON, line by line; times in milliseconds."""
    p = cutting.latest(read(spark, d, "paragraphs"), ["source_id", "para_no"], None)
    flat = p.select("source_id", F.col("para_no").alias("pos"), F.round(F.col("start_s") * 1000).cast("bigint").alias("start_s"), F.round(F.col("end_s") * 1000).cast("bigint").alias("end_s"), "section", "text")
    return sinks.sidecar(records._sources(spark, d), flat)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    judged = filters.reasons(records._candidates(spark, d), with_compression=False).where("source_id is not null")
    tried = records._sources(spark, d).select("source_id", F.when(F.length("source_id") % 5 == 0, "no audio").alias("error"))
    return merge.outcome(judged.where("reason is null"), judged.where("reason is not null"), tried)


def build_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Clips, drops and errors of every source."""
    return _outcomes(spark, d)


def build_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many sources went well, and what came of all."""
    return merge.succeeded(_outcomes(spark, d))


def owned_ids(spark: SparkSession, d: str) -> DataFrame:
    """Sources at hand and those that were built before."""
    return merge.all_ids(read(spark, d, "clip_candidates"), read(spark, d, "verifications"))


def hot_edges(spark: SparkSession, d: str) -> DataFrame:
    """Share of loud edges by label, embeddings taken as samples."""
    e = read(spark, d, "embeddings").select("label", exact.edge_ratio("embedding", F.lit(320)).alias("edge_ratio"))
    return verify.hot_share(e, ["label"]).withColumn("hot_edges", F.round("hot_edges", 6))


def _listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips, a listing without some of them whose files are read as their spans and numbers say, and index lines."""
    clips = read(spark, d, "clips").where("id is not null").select("id", "audio_path", "text", "duration_s")
    n = F.length(F.coalesce("text", F.lit("")))
    files = records._files(spark, d).where("path not like '%7.wav'")
    rate = F.when(F.length("path") % 19 == 0, F.lit(None)).otherwise(16_000)
    files = files.select("path", F.when(rate.isNotNull(), F.col("actual_s")).alias("actual_s"), F.when(rate.isNotNull(), 1).alias("channels"), F.when(rate.isNotNull(), F.when(F.length("path") % 23 == 0, 1).otherwise(2)).alias("width"), rate.cast("int").alias("rate"))
    lines = records._clips(spark, d).select(F.concat_ws("|", "id", F.lit("x"), F.when(n % 29 == 1, "another").otherwise(F.coalesce("text", F.lit("")))).alias("line"))
    return clips, files, lines


def structure_checks(spark: SparkSession, d: str) -> DataFrame:
    """All structural checks of the clips as one dataset."""
    return verify.checks(*_listed(spark, d))


def speech_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines that no pause of more than two seconds parts, from end to start."""
    return runs.speech_runs(read(spark, d, "segments"))


def audio_windows(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of two minutes of all media."""
    return sections.windows(records._sources(spark, d))


def wordless_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources without words, those of clips taken for all."""
    return pipelines.wordless(read(spark, d, "sources"), read(spark, d, "clips"))


def build_advice(spark: SparkSession, d: str) -> DataFrame:
    """What to think over before each source is built."""
    model = F.element_at(F.array(*[F.lit(m) for m in ("tiny", "small", "large-v3", "own/model")]), F.length("source_id") % 4 + 1)
    s = records._sources(spark, d).select("source_id", F.when(F.length("source_id") % 3 == 0, "uz-Latn").otherwise(F.col("language")).alias("language"), model.alias("model"), F.when(F.length("source_id") % 2 == 0, 16_000).alias("rate"))
    return pipelines.advice(s, formats=("hf", "ljspeech")).select("source_id", F.array_join("advice", " ").alias("advice"))


def clamped_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates clamped to half of their media's length."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    c = cutting.latest(read(spark, d, "clip_candidates"), ["ref"], None).select("ref", "source_id", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"))
    c = c.join(records._sources(spark, d).select("source_id", F.floor(ms("duration_s") / 2).alias("media")), "source_id", "left")
    return pipelines.clamped(c, "media").select("ref", "start_ms", "end_ms")


def pinned_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language each source is held to: the one asked for, here of every third, else its own; null holds to none."""
    asked = F.when(F.length("source_id") % 3 == 0, "el")
    return records._sources(spark, d).select("source_id", F.coalesce(asked, scripts.normalized_code(F.col("language"))).alias("target"))


def printed_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of verifications as reports print them, half to even, and the time as a stamp."""
    v = read(spark, d, "verifications").distinct()
    return v.select("source_id", tx.utc_stamp(F.col("verified_at")).alias("at"), exact.fixed(F.nanvl("pairing_mean", F.lit(None).cast("double")), F.lit(2)).alias("mean"), exact.fixed(F.col("total_duration_s") / 60, F.lit(1)).alias("minutes"))


QUERIES = {f.__name__: f for f in (fetch_failures, url_stems, media_files, code_checks, metadata_rows, listing_entries, episodes, fetched_tracks, card_facts, late_clips, late_drops, given_up, drop_records, sidecar_lines, build_outcomes, build_totals, owned_ids, hot_edges, structure_checks, speech_runs, audio_windows, wordless_sources, build_advice, clamped_candidates, pinned_languages, printed_measures)}

# --- SQL ------------------------------------------------------------------------------------------

_S, _C, _K, _F, _REASON = records._S, records._C, records._K, records._F, records._REASON
_LOGS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in LOGS) + "]"
_CODES = "(" + ", ".join(f"'{c}'" for c in scripts.CODES.split()) + ")"
_MEDIA = "(" + ", ".join(f"'{c}'" for c in urls.MEDIA) + ")"
_STAMP = "lpad(CAST({0} // 3600 AS VARCHAR), CAST(greatest(2, len(CAST({0} // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({0} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"
_CUTS = f"""WITH {_S}, {_K}, kept AS (SELECT ref, source_id, CAST(regexp_extract(ref, '([0-9]+)$', 1) AS BIGINT) AS seg, text, len(coalesce(text, '')) AS n, oversized FROM k WHERE source_id IS NOT NULL),
w AS (SELECT *, CASE WHEN oversized IS NULL OR n % 17 = 3 THEN 'no audio there' END AS error, CASE WHEN n % 11 = 5 THEN 0.005 ELSE 2.5 END AS written, CASE WHEN n % 3 > 0 THEN (n % 13) * 0.0005::DOUBLE END AS clipped FROM kept),
per AS (SELECT source_id, count(*) AS clips, count(*) FILTER (error IS NOT NULL) AS failures FROM w GROUP BY source_id),
lost AS (SELECT * FROM per WHERE failures > greatest(3.0, clips * 0.2)),
l AS (SELECT * FROM w WHERE source_id NOT IN (SELECT source_id FROM lost)),
g AS (SELECT *, source_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY source_id ORDER BY seg) AS VARCHAR), 4, '0') AS clip_id FROM l WHERE error IS NULL AND written > 0.01)"""
_PREVIEW = "CASE WHEN len({0}) <= 80 THEN {0} ELSE left({0}, 77) || '...' END"
_JSON = "to_json({0})"

SQL = {
    "fetch_failures": f"""
WITH {_S}, l AS (SELECT source_id, ({_LOGS})[len(source_id) % {len(LOGS)} + 1] AS log FROM s),
k AS (SELECT source_id, log, CASE WHEN contains(lower(log), 'private video') THEN 'private' WHEN contains(lower(log), 'video unavailable') OR contains(lower(log), 'this video has been removed') THEN 'gone' WHEN contains(lower(log), 'age') AND contains(lower(log), 'confirm') THEN 'age'
  WHEN contains(lower(log), 'not a bot') OR contains(lower(log), 'sign in to confirm') THEN 'check' WHEN contains(lower(log), 'is not a valid url') OR contains(lower(log), 'unsupported url') THEN 'url' ELSE 'other' END AS kind FROM l)
SELECT source_id, kind, CASE kind WHEN 'other' THEN 'MetadataError' WHEN 'url' THEN 'SourceError' ELSE 'UnavailableError' END AS error, CASE WHEN trim(log) = '' THEN 'no error output' ELSE list_last(string_split(trim(log), chr(10))) END AS tail FROM k""",
    "url_stems": f"""
WITH {_S}, u AS (SELECT source_id, regexp_extract(source, '^https?://([^/?#]+)([^?#]*)', ['host', 'path']) AS p FROM s), v AS (SELECT source_id, coalesce(nullif(list_last(list_filter(string_split(p.path, '/'), lambda x: x <> '')), ''), nullif(lower(p.host), ''), 'media') AS t FROM u),
w AS (SELECT source_id, regexp_replace(regexp_replace(lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\p{{M}}{tx.SPACE}_-]', '', 'g')), '[{tx.SPACE}_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS g FROM v)
SELECT source_id, left(CASE WHEN g = '' THEN 'episode' ELSE g END, 80) AS stem FROM w""",
    "media_files": f"WITH {_C}, x AS (SELECT id, lower(regexp_extract(regexp_replace(audio_path, '[?#].*$', ''), '[^/.](\\.[A-Za-z0-9]+)$', 1)) AS suffix FROM c) SELECT * FROM x WHERE suffix IN {_MEDIA}",
    "code_checks": f"""
WITH l AS (SELECT lang AS label FROM documents UNION SELECT language FROM sources), c AS (SELECT label, replace(lower({records._STRIP.replace('{0}', 'label')}), '_', '-') AS code FROM l), b AS (SELECT *, split_part(code, '-', 1) AS base FROM c),
g AS (SELECT *, label IS NULL OR code = '' OR code IN {_CODES} OR base IN {_CODES} AS good FROM b)
SELECT label, good, CASE WHEN good AND code <> '' THEN CASE WHEN code IN {_CODES} THEN code ELSE base END END AS code FROM g""",
    "metadata_rows": f"""
WITH {_S} SELECT source_id AS video_id, CASE WHEN len(source_id) % 3 > 0 THEN coalesce(nullif(title, ''), 'Untitled') ELSE 'Untitled' END AS title, coalesce(nullif(channel, ''), 'Unknown') AS channel, source, coalesce(duration_s, 0) AS duration_s, language,
  CAST(coalesce(len(chapters), 0) AS INTEGER) AS n_chapters, CASE WHEN len(chapters) > 0 THEN coalesce(nullif(chapters[1].title, ''), 'Untitled') END AS first FROM s""",
    "listing_entries": f"WITH {_S} SELECT 0 AS pos, source_id AS video_id, source_id AS title, 'https://video.example/watch?v=' || source_id AS url FROM s WHERE source_id <> ''",
    "episodes": f"""
WITH {_S}, x AS (SELECT *, len(source_id) % 2 > 0 AS odd, CAST(floor(duration_s) AS BIGINT) AS sec FROM s)
SELECT coalesce(nullif(title, ''), 'Untitled episode') AS title, CASE WHEN odd THEN nullif(source, '') ELSE 'https://page.example/' || source_id END AS audio_url, CAST(coalesce(sec, 0) AS DOUBLE) AS duration_s,
  coalesce(CASE WHEN odd THEN nullif(video_id, '') END, nullif(source, ''), '') AS guid FROM x""",
    "fetched_tracks": f"""
WITH {_S}, t AS (SELECT channel, source_id AS pos, coalesce(language, '') AS l, coalesce(method, '') = 'captions-auto' AS g FROM s WHERE channel IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY CASE WHEN l = 'en' OR starts_with(l, 'en-') THEN 0 ELSE 2 END + CASE WHEN g THEN 1 ELSE 0 END, pos) AS k FROM t)
SELECT t.channel, t.pos, t.l AS language_code, t.g AS is_generated FROM t JOIN r USING (channel, l, g) WHERE k = 1""",
    "card_facts": """
WITH v AS (SELECT DISTINCT * FROM verifications), f AS (SELECT CASE WHEN regexp_matches(language, '^[A-Za-z-]+$') AND language <> 'und' THEN language WHEN regexp_matches(language, '^[A-Za-z-]') THEN nullif(regexp_extract(language, '^[A-Za-z-]+'), 'und') END AS language,
  CASE WHEN starts_with(model, 'whisper-') THEN substr(regexp_extract(model, '^\\S+'), 9) WHEN starts_with(model, 'parakeet') THEN 'parakeet' END AS model FROM v)
SELECT language, model, count(*) AS n FROM f GROUP BY ALL""",
    "late_clips": _CUTS + " SELECT ref, clip_id FROM g WHERE NOT coalesce(clipped > 0.005, false)",
    "late_drops": _CUTS + f"""
SELECT ref AS clip, CASE WHEN error IS NOT NULL THEN 'slice_failed' ELSE 'empty_slice' END AS filter, coalesce(error, '0.00s') AS value, CASE WHEN error IS NOT NULL THEN 'cut' ELSE '>0s' END AS threshold, left(coalesce(text, ''), 80) AS text FROM l WHERE error IS NOT NULL OR written <= 0.01
UNION ALL SELECT clip_id, 'clipping', printf('%.2f', clipped * 100) || '%', '<=0.5%', {_PREVIEW.replace('{0}', "coalesce(text, '')")} FROM g WHERE clipped > 0.005""",
    "given_up": _CUTS + " SELECT source_id, failures, clips FROM lost",
    "drop_records": _REASON.replace("r AS (SELECT ref, source_id, CASE", "r AS (SELECT *, CASE", 1) + f""",
q AS (SELECT *, CASE WHEN reason = 'empty_text' THEN coalesce(text, '') ELSE t END AS said FROM r WHERE reason IS NOT NULL)
SELECT ref AS clip, reason AS filter,
  CASE reason WHEN 'empty_text' THEN '0' WHEN 'duration' THEN printf('%.2f', ms / 1000) || 's' WHEN 'internal_silence' THEN CASE WHEN isinf(silence) THEN 'inf' ELSE printf('%.2f', silence) END || 's' WHEN 'non_target_script' THEN script WHEN 'char_rate' THEN printf('%.1f', len(t) / (ms / 1000)) || '/s' WHEN 'confidence' THEN printf('%.2f', conf) END AS value,
  CASE reason WHEN 'empty_text' THEN '>0 chars' WHEN 'duration' THEN CASE WHEN ms < 1000 THEN '>=1.0s' ELSE '<=15.0s' END WHEN 'internal_silence' THEN '<=2.0s' WHEN 'non_target_script' THEN target WHEN 'char_rate' THEN CASE WHEN len(t) * 1000 / ms < 5.0 THEN '>=5.0/s' ELSE '<=25.0/s' END WHEN 'confidence' THEN '>=0.3' END AS threshold,
  {_PREVIEW.replace('{0}', 'said')} AS text FROM q""",
    "sidecar_lines": f"""
WITH {_S}, p AS (SELECT DISTINCT source_id, para_no, section, text, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM paragraphs WHERE source_id IN (SELECT source_id FROM s)), m AS (SELECT *, max(para_no) OVER (PARTITION BY source_id) AS last FROM p), h AS (SELECT *, CAST(floor(coalesce(duration_s, 0)) AS BIGINT) AS sec FROM s WHERE source_id IS NOT NULL)
SELECT source_id, CAST(-1 AS DOUBLE) AS line_no, '{{"title":' || to_json(coalesce(title, 'Untitled')) || ',"source":' || to_json(coalesce(source, '')) || ',"channel":' || to_json(coalesce(channel, 'Unknown')) || ',"duration":"' || {_STAMP.replace('{0}', 'sec')} || '","ingested":"' || coalesce(strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ'), '') || '","method":' || to_json(coalesce(method, '')) || ',"language":' || to_json(coalesce(language, 'und')) || ',"chunks":[' AS line FROM h
UNION ALL SELECT source_id, CAST(para_no AS DOUBLE), '{{' || CASE WHEN a IS NULL THEN '' ELSE '"start_s":' || a || ',' END || CASE WHEN b IS NULL THEN '' ELSE '"end_s":' || b || ',' END || '"section":' || to_json(coalesce(section, '')) || ',"text":' || to_json(coalesce(text, '')) || '}}' || CASE WHEN para_no < last THEN ',' ELSE '' END FROM m
UNION ALL SELECT source_id, CAST(1e15 AS DOUBLE), ']}}' FROM h""",
    "build_outcomes": _REASON + """,
t AS (SELECT source_id, CASE WHEN len(source_id) % 5 = 0 THEN 'no audio' END AS error FROM s), o AS (SELECT source_id, count(*) FILTER (reason IS NULL) AS clips, count(*) FILTER (reason IS NOT NULL) AS dropped FROM r WHERE source_id IS NOT NULL GROUP BY source_id),
x AS (SELECT source_id, coalesce(clips, 0) AS clips, coalesce(dropped, 0) AS dropped, coalesce(error, CASE WHEN coalesce(clips, 0) = 0 THEN 'no clips' END) AS error FROM t LEFT JOIN o USING (source_id))
SELECT source_id, clips, dropped, error IS NULL AS ok, error FROM x""",
    "owned_ids": "SELECT source_id FROM clip_candidates WHERE source_id IS NOT NULL UNION SELECT source_id FROM verifications WHERE source_id IS NOT NULL",
    "hot_edges": """
WITH e AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
q AS (SELECT label, sqrt(list_avg(list_transform(x[1:8], lambda v: v * v))) AS a, sqrt(list_avg(list_transform(x[len(x) - 7:len(x)], lambda v: v * v))) AS z, sqrt(list_avg(list_transform(x[9:len(x) - 8], lambda v: v * v))) AS body, len(x) AS n FROM e),
r AS (SELECT label, CASE WHEN n >= 32 AND body >= 0.001 THEN greatest(a, z) / body END AS r FROM q)
SELECT label, count(r) AS measured, round(avg(CASE WHEN r > 0.5 THEN 1.0 WHEN r <= 0.5 THEN 0.0 END), 6) AS hot_edges FROM r GROUP BY label""",
    "structure_checks": f"""
WITH {_S}, {_C}, {_F}, l AS (SELECT DISTINCT path, CASE WHEN len(path) % 19 > 0 THEN actual_s END AS actual, CASE WHEN len(path) % 19 > 0 THEN CASE WHEN len(path) % 23 = 0 THEN 1 ELSE 2 END END AS width, CASE WHEN len(path) % 19 > 0 THEN 16000 END AS rate FROM f WHERE path NOT LIKE '%7.wav'),
n AS (SELECT path, any_value(actual) AS actual, any_value(width) AS width, any_value(rate) AS rate FROM l GROUP BY path),
r AS (SELECT c.id, coalesce(c.text, '') AS text, n.path IS NOT NULL AS here, n.rate IS NOT NULL AS readable, coalesce(n.width = 2, false) AS fit, CAST(round(c.duration_s * 1000) AS BIGINT) AS ms, CAST(round(n.actual * 1000) AS BIGINT) AS got, n.rate FROM (SELECT * FROM clips WHERE id IS NOT NULL) c LEFT JOIN n ON n.path = c.audio_path),
g AS (SELECT *, {records._STRIP.replace('{0}', 'text')} = '' OR regexp_matches(text, '[\\x00-\\x08\\x0a-\\x1f]') AS odd, here AND NOT (readable AND fit) AS unfit, readable AND ms IS NOT NULL AND got IS NOT NULL AS listed, readable AND ms IS NOT NULL AND got IS NOT NULL AND abs(ms - got) > 50 AS off FROM r),
a AS (SELECT count(*) AS n, count(*) FILTER (NOT here) AS b0, min(id) FILTER (NOT here) AS e0, count(*) FILTER (odd) AS b2, min(id) FILTER (odd) AS e2, count(*) FILTER (unfit) + greatest(0, count(DISTINCT rate) - 1) AS b3, min(id) FILTER (unfit) AS e3, count(*) FILTER (here) AS n3, count(*) FILTER (off) AS b4, min(id) FILTER (off) AS e4, count(*) FILTER (listed) AS n4 FROM g),
d AS (SELECT count(*) AS b1, min(id) AS e1 FROM (SELECT id FROM clips WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)),
o AS (SELECT count(DISTINCT path) AS b5, min(path) AS e5 FROM n WHERE regexp_matches(path, '(^|/)[^/]+_\\d{{4}}\\.wav$') AND path NOT IN (SELECT audio_path FROM clips WHERE id IS NOT NULL AND audio_path IS NOT NULL)),
i AS (SELECT id || '|x|' || CASE WHEN len(coalesce(text, '')) % 29 = 1 THEN 'another' ELSE coalesce(text, '') END AS line FROM c), x AS (SELECT string_split(line, '|') AS p FROM i),
y AS (SELECT (SELECT count(*) FROM x WHERE len(p) <> 3) + (SELECT count(*) FROM x JOIN c ON c.id = p[1] WHERE len(p) = 3 AND trim(regexp_replace(replace(p[3], '|', ' '), '[{tx.SPACE}]+', ' ', 'g')) <> {records._PIPE}) AS b6)
SELECT place, "check", bad = 0 AS ok, fatal, CAST(bad AS BIGINT) AS bad, CAST("of" AS BIGINT) AS "of", example FROM (
  SELECT 0 AS place, 'audio present' AS "check", true AS fatal, b0 AS bad, n AS "of", e0 AS example FROM a UNION ALL SELECT 1, 'ids unique', true, b1, n, e1 FROM a, d UNION ALL SELECT 2, 'texts whole', true, b2, n, e2 FROM a UNION ALL SELECT 3, 'audio format', true, b3, n3, e3 FROM a
  UNION ALL SELECT 4, 'durations', true, b4, n4, e4 FROM a WHERE n4 > 0 UNION ALL SELECT 5, 'no orphans', false, b5, NULL, e5 FROM o UNION ALL SELECT 6, 'index agrees', false, b6, NULL, NULL FROM y)""",
    "speech_runs": """
WITH s AS (SELECT source_id, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM segments WHERE source_id IS NOT NULL AND isfinite(start_s) AND isfinite(end_s) AND start_s <= end_s),
m AS (SELECT *, max(b) OVER (PARTITION BY source_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS no FROM m)
SELECT source_id, min(a) AS start_ms, max(b) AS end_ms FROM n GROUP BY source_id, no""",
    "audio_windows": f"WITH {_S}, w AS (SELECT source_id, duration_s, unnest(range(0, CAST(ceil(duration_s / 120) AS BIGINT))) AS i FROM s WHERE duration_s > 0) SELECT source_id, CAST(i AS INTEGER) AS window_no, i * 120.0::DOUBLE AS start_s, least((i + 1) * 120.0::DOUBLE, duration_s) AS end_s FROM w",
    "wordless_sources": "SELECT DISTINCT source_id FROM sources WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM clips WHERE source_id IS NOT NULL AND text IS NOT NULL)",
    "build_advice": f"""
WITH {_S}, x AS (SELECT source_id, CASE WHEN len(source_id) % 3 = 0 THEN 'uz-Latn' ELSE language END AS language, (['tiny', 'small', 'large-v3', 'own/model'])[len(source_id) % 4 + 1] AS model, CASE WHEN len(source_id) % 2 = 0 THEN 16000 END AS rate FROM s)
SELECT source_id, array_to_string(list_filter([CASE WHEN model <> 'own/model' AND {records._BASE} IN {records._in(scripts.UNUSABLE)} THEN 'low_resource' END, CASE WHEN model = 'tiny' THEN 'small_model' END, CASE WHEN rate < 22050 THEN 'upsampled' END, 'formats'], lambda v: v IS NOT NULL), ' ') AS advice FROM x""",
    "clamped_candidates": f"""
WITH {_S}, {_K}, x AS (SELECT ref, CAST(round(k.start_s * 1000) AS BIGINT) AS a, CAST(round(k.end_s * 1000) AS BIGINT) AS b, CAST(floor(CAST(round(s.duration_s * 1000) AS BIGINT) / 2) AS BIGINT) AS m FROM k LEFT JOIN s USING (source_id)), y AS (SELECT ref, a AS start_ms, CASE WHEN m > 0 THEN least(b, m) ELSE b END AS end_ms FROM x)
SELECT * FROM y WHERE end_ms > start_ms""",
    "pinned_languages": f"WITH {_S} SELECT source_id, CASE WHEN len(source_id) % 3 = 0 THEN 'el' ELSE {records._CODE} END AS target FROM s",
    "printed_measures": "WITH v AS (SELECT DISTINCT * FROM verifications) SELECT source_id, strftime(verified_at, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE WHEN isfinite(pairing_mean) THEN printf('%.2f', pairing_mean) END AS mean, CASE WHEN total_duration_s IS NOT NULL THEN printf('%.1f', total_duration_s / 60) END AS minutes FROM v",
}
SQL["build_totals"] = f"SELECT count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, CAST(sum(clips) AS BIGINT) AS clips, CAST(sum(dropped) AS BIGINT) AS dropped FROM ({SQL['build_outcomes']})"

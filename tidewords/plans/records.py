"""Queries over records: sources, clips and candidates, their indexes, checks and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewords.functions import exact, scripts, urls
from tidewords.functions import text as tx
from tidewords.operators import blocks, filters, merge, verify
from tidewords.operators.cutting import latest
from tidewords.session import read
from tidewords.sinks import rows as sinks
from tidewords.sources import landed

HOSTS, SHORT = ["video.example"], ["short.example"]


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "sources"), ["source_id"], "ingested_at")


def _clips(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "clips"), ["id"], None)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    c = latest(read(spark, d, "clip_candidates"), ["ref"], None)
    return blocks.lookup(c, _sources(spark, d).select("source_id", scripts.normalized_code(F.col("language")).alias("language")), ["source_id"], ["ref"])


def url_routes(spark: SparkSession, d: str) -> DataFrame:
    """What every source's URL leads to."""
    u = F.col("source")
    return _sources(spark, d).select("source_id", urls.video_id(u, HOSTS, SHORT).alias("video"), urls.batch(u, HOSTS).alias("batch"))


def language_codes(spark: SparkSession, d: str) -> DataFrame:
    """Labels as codes, and the engine each would get."""
    code = scripts.normalized_code(F.col("language"))
    e = scripts.engine(code, fast=True)
    return _sources(spark, d).select("source_id", code.alias("code"), e["engine"].alias("engine"), e["model"].alias("model"), e["usable"].alias("usable"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    """Printed durations read again."""
    stamp = tx.format_timestamp(F.col("duration_s"))
    return _sources(spark, d).select("source_id", stamp.alias("stamp"), tx.duration_seconds(stamp).cast("bigint").alias("seconds"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """File-safe names of all sources."""
    t = F.coalesce("title", F.lit(""))
    return _sources(spark, d).select("source_id", tx.slug(t).alias("slug"), tx.safe_id(t).alias("safe"), tx.safe_id(t, F.col("channel_id")).alias("keyed"))


def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of sources by channel, collisions numbered."""
    s = _sources(spark, d).select("source_id", F.lower("channel").alias("base"))
    return merge.unique_names(s, "base", "source_id")


def track_choice(spark: SparkSession, d: str) -> DataFrame:
    """The best English track of every channel, its sources taken as tracks."""
    s = _sources(spark, d).where("channel is not null").select(F.col("channel").alias("source_id"), F.col("source_id").alias("pos"), F.coalesce("language", F.lit("")).alias("language_code"), (F.coalesce("method", F.lit("")) == "captions-auto").alias("is_generated"))
    return landed.track_choice(s, F.lit("en")).withColumnRenamed("source_id", "channel")


def batch_selection(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 items of the listing of sources; the limit is what the selection is for."""
    return merge.picked(_sources(spark, d).select("source_id", "title"), "source_id", everything=True, limit=25)


def batch_modes(spark: SparkSession, d: str) -> DataFrame:
    """What the other ways of selecting take of the listing: its first item, its seventh, nothing."""
    items = _sources(spark, d).select("source_id", "title")
    named = lambda mode, df: df.withColumn("mode", F.lit(mode))
    out = named("latest", merge.picked(items, "source_id", latest=True)).unionByName(named("number", merge.picked(items, "source_id", number=7, latest=True)))
    return out.unionByName(named("none", merge.picked(items, "source_id")))


def filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each candidate is dropped, by the rules that need no zlib."""
    return filters.reasons(_candidates(spark, d), with_compression=False).select("ref", "reason")


def filter_drops(spark: SparkSession, d: str) -> DataFrame:
    """Drop records of all candidates by all rules."""
    return filters.drops(filters.reasons(_candidates(spark, d)))


def drop_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by drop reason."""
    return filter_reasons(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def word_measures(spark: SparkSession, d: str) -> DataFrame:
    """Longest silence inside, and mean confidence, of every candidate."""
    c = latest(read(spark, d, "clip_candidates"), ["ref"], None)
    return c.select("ref", F.least(F.round(filters.silence_s(F.col("words")) * 1000), F.lit(1e12)).cast("bigint").alias("silence_ms"), F.round(filters.mean_confidence(F.col("words")), 3).alias("confidence"))


def edge_padding(spark: SparkSession, d: str) -> DataFrame:
    """Slice windows of all clips, padded but not into their neighbours."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    c = _clips(spark, d).select("id", "source_id", F.try_to_number(F.regexp_extract("id", "_([0-9]+)$", 1), F.lit("999999999")).cast("bigint").alias("clip_no"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms")).where("clip_no is not null and end_ms is not null")
    c = blocks.lookup(c, _sources(spark, d).select("source_id", "duration_s"), ["source_id"], ["id"])
    return filters.padded(c, media_s="duration_s").select("id", "cut_start_ms", "cut_end_ms")


def combined_totals(spark: SparkSession, d: str) -> DataFrame:
    """Clips, length and oversized clips of each source and of all."""
    return merge.totals(read(spark, d, "clips"))


def language_vote(spark: SparkSession, d: str) -> DataFrame:
    """The language all sources agree on."""
    return merge.language_vote(_sources(spark, d).select(scripts.normalized_code(F.col("language")).alias("language")))


def renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Clips that the filters keep, numbered without holes."""
    kept = filters.reasons(_candidates(spark, d), with_compression=False).where("reason is null and source_id is not null")
    kept = kept.select("source_id", "ref", F.regexp_extract("ref", "([0-9]+)$", 1).cast("bigint").alias("seg"))
    return merge.clip_numbers(kept, "seg").select("ref", "clip_id")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A file listing: the clips of verified sources, and a first clip of every source."""
    verified = read(spark, d, "verifications").select("source_id").distinct()
    clips = _clips(spark, d)
    listed = clips.join(verified, "source_id", "left_semi").select(F.col("audio_path").alias("path"), (F.col("end_s") - F.col("start_s")).alias("actual_s"))
    firsts = _sources(spark, d).select(F.concat(F.lit("wavs/"), "source_id", F.lit("_0000.wav")).alias("path"), F.lit(None).cast("double").alias("actual_s"))
    return listed.unionByName(firsts)


def missing_audio(spark: SparkSession, d: str) -> DataFrame:
    """Clips without their file, in a listing that lacks every tenth."""
    return verify.missing_audio(_clips(spark, d), _files(spark, d).where("path not like '%7.wav'"))


def orphan_audio(spark: SparkSession, d: str) -> DataFrame:
    """Clip files that no clip refers to."""
    return merge.orphans(_files(spark, d), _clips(spark, d), _sources(spark, d))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that several rows of the clips table have."""
    return verify.duplicate_ids(read(spark, d, "clips"))


def duration_off(spark: SparkSession, d: str) -> DataFrame:
    """Clips whose listed duration isn't that of their span."""
    return verify.duration_off(_clips(spark, d), _files(spark, d))


def csv_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The pipe-delimited index of candidates against the clips of the same number."""
    c = _clips(spark, d)
    lines = latest(read(spark, d, "clip_candidates"), ["ref"], None).select(F.concat_ws("|", F.replace("ref", F.lit("_seg"), F.lit("_")), F.coalesce("text", F.lit("")), F.coalesce("text", F.lit(""))).alias("line"))
    return verify.csv_mismatch(c, lines)


def structure(spark: SparkSession, d: str) -> DataFrame:
    """Structural checks of every source's rows."""
    return verify.structure(read(spark, d, "clips").where("source_id is not null"), _files(spark, d))


def script_share(spark: SparkSession, d: str) -> DataFrame:
    """Clips in the script of their source's language."""
    return verify.script_share(read(spark, d, "clips"), _sources(spark, d))


def document_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The commonest script of every document's letters."""
    s = scripts.dominant(F.col("text"))
    return read(spark, d, "documents").select("doc_id", s["script"].alias("script"), s["n"].alias("n"), s["letters"].alias("letters"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict and reasons from the measures of every verification; the accuracy stands for the gap."""
    v = verify.verdict(F.col("pairing_mean"), F.col("pairing_mean"), F.col("script_share"), F.col("hot_edges"))
    return read(spark, d, "verifications").distinct().select("source_id", v.alias("v")).select("source_id", F.col("v.verdict").alias("verdict"), F.array_join("v.reasons", " ").alias("reasons"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    """Verifications by verdict: number, clips, mean accuracy and share of hot edges above the limit."""
    v = read(spark, d, "verifications").distinct()
    return v.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("clips").alias("clips"), F.count_if(F.col("hot_edges") > verify.GOOD_EDGES).alias("some_edges"), F.round(F.median(F.nanvl("pairing_mean", F.lit(None).cast("double"))), 3).alias("accuracy"))


def resume(spark: SparkSession, d: str) -> DataFrame:
    """Sources that need not be built again: verified as trainable by the model asked for, every clip on file."""
    v = read(spark, d, "verifications").distinct()
    paths = _clips(spark, d).select("source_id", F.col("audio_path").alias("path"))
    state = v.join(paths.select("source_id").distinct(), "source_id").select("source_id", F.col("model").alias("fingerprint"), (F.col("verdict") == "trainable").alias("ok"))
    return merge.reusable(_sources(spark, d), state, _files(spark, d), "whisper-small", paths)


def ljspeech_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pipe-delimited index lines of all clips."""
    return sinks.ljspeech(_clips(spark, d))


def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    """Manifest lines of all clips."""
    return sinks.manifest(_clips(spark, d))


def audiofolder_lines(spark: SparkSession, d: str) -> DataFrame:
    """Audio folder index lines of all clips."""
    return sinks.audiofolder(_clips(spark, d))


def speaker_index(spark: SparkSession, d: str) -> DataFrame:
    """Clips and length by speaker label."""
    c = _clips(spark, d).where("speaker is not null")
    return c.groupBy(sinks.speaker_slug(F.col("speaker")).alias("slug")).agg(F.count("*").alias("clips"), F.sum(F.round(F.col("duration_s") * 1000).cast("bigint")).alias("ms"))


def size_categories(spark: SparkSession, d: str) -> DataFrame:
    """Card bucket of every source's clips."""
    return _clips(spark, d).where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n")).select("source_id", "n", sinks.size_category(F.col("n")).alias("category"))


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    """What of each clip can be heard."""
    return _clips(spark, d).select("id", exact.normalized("text").alias("heard"))


def compression(spark: SparkSession, d: str) -> DataFrame:
    """Compression ratio of each clip's text."""
    return _clips(spark, d).select("id", exact.compression_ratio(F.coalesce("text", F.lit(""))).alias("ratio"))


def cyclic_control(spark: SparkSession, d: str) -> DataFrame:
    """A sample of eight clips, each with the next one's text as control; a sampling operator."""
    return verify.controls(verify.sampled(_clips(spark, d).where("text is not null").select("id", "text"), 8)).select("id", "text", "control")


def pairing(spark: SparkSession, d: str) -> DataFrame:
    """Pairing of a sample of eight clips with the candidates' text of the same span; a sampling operator."""
    said = latest(read(spark, d, "clip_candidates"), ["ref"], None).select("source_id", F.round(F.col("start_s") * 1000).alias("ms"), F.col("text").alias("heard")).where("ms is not null").groupBy("source_id", "ms").agg(F.max("heard").alias("heard"))
    c = _clips(spark, d).select("id", "source_id", "text", F.round(F.col("start_s") * 1000).alias("ms")).join(said, ["source_id", "ms"])
    return verify.pairing(verify.controls(verify.sampled(c, 8)))


def sample_measures(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings taken as samples: share at or past a fifth of full scale, and the edges' loudness."""
    e = read(spark, d, "embeddings")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", F.round(filters.clipped_share(wide, 0.2), 6).alias("clipped"), (exact.edge_ratio("embedding", F.lit(320)) > verify.HOT).alias("hot"))


def source_rank(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of each source by number of clips, the three commonest."""
    c = _clips(spark, d).where("source_id is not null and speaker is not null").groupBy("source_id", "speaker").agg(F.count("*").alias("n"))
    over = Window.partitionBy("source_id").orderBy(F.desc("n"), "speaker")
    return c.withColumn("place", F.row_number().over(over)).where("place <= 3")


QUERIES = {f.__name__: f for f in (url_routes, language_codes, durations, names, unique_names, track_choice, batch_selection, batch_modes, filter_reasons, filter_drops, drop_histogram, word_measures, edge_padding, combined_totals, language_vote, renumbered, missing_audio, orphan_audio, duplicate_ids, duration_off, csv_agreement, structure, script_share, document_scripts, verdicts, measures, resume, ljspeech_lines, manifest_lines, audiofolder_lines, speaker_index, size_categories, normalized_text, compression, cyclic_control, pairing, sample_measures, source_rank)}

# --- SQL ------------------------------------------------------------------------------------------

_S = "s AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_C = "c AS (SELECT DISTINCT * FROM clips WHERE id IS NOT NULL)"
_K = "k AS (SELECT * FROM clip_candidates QUALIFY row_number() OVER (PARTITION BY ref) = 1)"
_STRIP = "regexp_replace({0}, '^[" + tx.SPACE + "]+|[" + tx.SPACE + "]+$', '', 'g')"
_PIPE = "trim(regexp_replace(replace(coalesce(text, ''), '|', ' '), '[" + tx.SPACE + "]+', ' ', 'g'))"
_BASE = "split_part(lower(replace(" + _STRIP.replace("{0}", "language") + ", '_', '-')), '-', 1)"
_CODE = f"coalesce(CASE lower({_STRIP.replace('{0}', 'language')}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scripts.NAMED.items()) + f" END, CASE WHEN regexp_matches({_BASE}, '^[a-z]{{2}}$') THEN {_BASE} END)"
_SCRIPT = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(c) for c in codes.split())}) THEN '{name}'" for name, codes in scripts.LANGUAGES.items()) + " END"
_F = f"""f AS (SELECT audio_path AS path, end_s - start_s AS actual_s FROM c WHERE source_id IN (SELECT source_id FROM verifications)
  UNION ALL SELECT 'wavs/' || source_id || '_0000.wav', NULL FROM s)"""


def _in(codes: str) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes.split()) + ")"


def _n(text: str, name: str) -> str:
    cls = "".join("\\x{%s}-\\x{%s}" % tuple(r.split("-")) for r in scripts.RANGES[name].split())
    return f"len(list_filter(regexp_extract_all({text}, '[{cls}]'), lambda ch: regexp_matches(ch, '\\p{{L}}')))"


def _dominant(table: str, text: str, keep: str) -> str:
    """CTEs n, top: counts by script and the first of the largest."""
    cols = ", ".join(f"{_n(text, name)} AS {name}" for name in scripts.RANGES)
    total = f"len(regexp_extract_all({text}, '\\p{{L}}'))"
    rest = " - ".join(["letters", *scripts.RANGES])
    largest = "greatest(" + ", ".join([*scripts.RANGES, "other"]) + ")"
    pick = "CASE " + " ".join(f"WHEN {s} = {largest} THEN '{s}'" for s in scripts.RANGES) + " ELSE 'other' END"
    return f"n0 AS (SELECT {keep}, {cols}, {total} AS letters FROM {table}), n1 AS (SELECT *, {rest} AS other FROM n0), top AS (SELECT *, CASE WHEN letters > 0 THEN {pick} END AS script, CASE WHEN letters > 0 THEN {largest} END AS n FROM n1)"


_REASON = f"WITH {_S}, {_K}, j AS (SELECT k.*, {_CODE} AS lang FROM k LEFT JOIN s USING (source_id)), " + """
m AS (SELECT *, STRIPPED AS t, coalesce(round((end_s - start_s) * 1000), 0) AS ms, SCRIPT AS target,
  coalesce(list_max(list_transform(range(1, len(words)), lambda i: greatest(0.0, CASE WHEN isnan(words[i + 1].start_s - least(greatest(words[i].end_s, greatest(words[i].start_s, 0.0)), greatest(words[i].start_s, 0.0) + 2.0)) THEN 0.0 ELSE words[i + 1].start_s - least(greatest(words[i].end_s, greatest(words[i].start_s, 0.0)), greatest(words[i].start_s, 0.0) + 2.0) END))), 0) AS silence,
  coalesce(list_avg(list_filter(list_transform(words, lambda w: w.confidence), lambda x: x IS NOT NULL)), 1.0) AS conf FROM j),
""".replace("STRIPPED", _STRIP.replace("{0}", "coalesce(text, '')")).replace("SCRIPT", _SCRIPT.replace("{0}", "lang")) + _dominant("m", "t", "*") + """,
r AS (SELECT ref, source_id, CASE WHEN t = '' THEN 'empty_text' WHEN ms < 1000 OR ms > 15000 THEN 'duration' WHEN silence > 2.0 THEN 'internal_silence'
  WHEN target IS NOT NULL AND script <> target AND 2 * n > letters THEN 'non_target_script'
  WHEN target IS NOT NULL AND target NOT IN ('cjk', 'thai', 'lao', 'myanmar', 'khmer') AND ms > 0 AND (len(t) * 1000 / ms < 5.0 OR len(t) * 1000 / ms > 25.0) THEN 'char_rate'
  WHEN conf < 0.3 THEN 'confidence' END AS reason FROM top)"""
_SLUG = "regexp_replace(regexp_replace(lower(" + _STRIP.replace("{0}", "regexp_replace(coalesce(title, ''), '[^\\p{L}\\p{N}\\p{M}" + tx.SPACE + "_-]', '', 'g')") + "), '[" + tx.SPACE + "_-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_STEM = "left(regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 60)"
_STEM = f"CASE WHEN {_STEM} = '' THEN 'clip' ELSE {_STEM} END"
_LOSSY = "len(list_filter(regexp_extract_all(coalesce(title, ''), '[\\p{L}\\p{N}]'), lambda ch: ord(ch) > 127)) > 0"
_URL = r"regexp_extract(source, '^https?://(?:www\.)?(?:m\.)?([^/?#]+)([^?#]*)(?:\?([^#]*))?', ['host', 'path', 'query'])"
_SEC = "CAST(floor(duration_s) AS BIGINT)"

SQL = {
    "url_routes": f"""
WITH {_S}, u AS (SELECT source_id, {_URL} AS p FROM s),
v AS (SELECT source_id, lower(p.host) AS host, p.path AS path, regexp_extract('&' || p.query, '&v=([^&]*)', 1) AS q, list_filter(string_split(p.path, '/'), lambda x: x <> '') AS seg, regexp_extract('&' || p.query, '&list=([^&]*)', 1) AS l FROM u),
w AS (SELECT *, CASE WHEN host = 'short.example' AND len(seg) = 1 THEN seg[1] WHEN host = 'video.example' AND len(seg) = 1 AND seg[1] = 'watch' THEN q WHEN host = 'video.example' AND len(seg) = 2 AND seg[1] IN ('embed', 'shorts', 'live') THEN seg[2] END AS id FROM v)
SELECT source_id, CASE WHEN regexp_matches(id, '^[A-Za-z0-9_-]{{11}}$') THEN id END AS video, CASE WHEN rtrim(path, '/') = '/playlist' AND regexp_matches(l, '^[A-Za-z0-9_-]+$') THEN l END AS batch FROM w""",
    "language_codes": f"""
WITH {_S}, x AS (SELECT source_id, {_CODE} AS code FROM s)
SELECT source_id, code, CASE WHEN code IN {_in(scripts.FAST_ENGINE)} THEN 'fast' ELSE 'whisper' END AS engine, CASE WHEN code IN {_in(scripts.FAST_ENGINE)} THEN 'fast' WHEN code IN {_in(scripts.LARGE_MODEL)} THEN 'large-v3' ELSE 'small' END AS model, NOT coalesce(code IN {_in(scripts.UNUSABLE)}, false) AS usable FROM x""",
    "durations": f"""
WITH {_S} SELECT source_id, CASE WHEN {_SEC} IS NOT NULL THEN lpad(CAST({_SEC} // 3600 AS VARCHAR), CAST(greatest(2, len(CAST({_SEC} // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({_SEC} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_SEC} % 60 AS VARCHAR), 2, '0') END AS stamp, coalesce({_SEC}, 0) AS seconds FROM s""",
    "names": f"""
WITH {_S} SELECT source_id, left(CASE WHEN {_SLUG} = '' THEN 'episode' ELSE {_SLUG} END, 80) AS slug,
  {_STEM} || CASE WHEN {_LOSSY} THEN '-' || left(sha1(coalesce(title, '')), 8) ELSE '' END AS safe,
  {_STEM} || CASE WHEN channel_id IS NOT NULL OR {_LOSSY} THEN '-' || left(sha1(coalesce(channel_id, title, '')), 8) ELSE '' END AS keyed FROM s""",
    "unique_names": f"""
WITH {_S}, b AS (SELECT source_id, lower(channel) AS base FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source_id) AS r FROM b)
SELECT source_id, base, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS unique_name FROM n""",
    "track_choice": f"""
WITH {_S}, t AS (SELECT channel, source_id, coalesce(language, '') AS l, coalesce(method, '') = 'captions-auto' AS g FROM s WHERE channel IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY CASE WHEN l = 'en' OR starts_with(l, 'en-') THEN 0 ELSE 2 END + CASE WHEN g THEN 1 ELSE 0 END, source_id) AS k FROM t)
SELECT channel, l AS language_code, g AS is_generated FROM r WHERE k = 1""",
    "batch_selection": f"WITH {_S} SELECT source_id, title FROM s ORDER BY source_id LIMIT 25",
    "batch_modes": f"WITH {_S}, n AS (SELECT source_id, title, row_number() OVER (ORDER BY source_id) AS k FROM s) SELECT source_id, title, CASE k WHEN 1 THEN 'latest' ELSE 'number' END AS mode FROM n WHERE k IN (1, 7)",
    "filter_reasons": _REASON + " SELECT ref, reason FROM r",
    "drop_histogram": _REASON + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1",
    "word_measures": _REASON + " SELECT ref, CAST(least(round(silence * 1000), 1e12) AS BIGINT) AS silence_ms, round(conf, 3) AS confidence FROM m",
    "renumbered": _REASON + " SELECT ref, source_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY source_id ORDER BY CAST(regexp_extract(ref, '([0-9]+)$', 1) AS BIGINT)) AS VARCHAR), 4, '0') AS clip_id FROM r WHERE reason IS NULL AND source_id IS NOT NULL",
    "edge_padding": f"""
WITH {_S}, {_C}, x AS (SELECT id, source_id, TRY_CAST(regexp_extract(id, '_([0-9]+)$', 1) AS BIGINT) AS no, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM c),
y AS (SELECT *, lag(b) OVER w AS pb, lead(a) OVER w AS na FROM x WHERE no IS NOT NULL AND b IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY no)),
z AS (SELECT y.*, round(s.duration_s * 1000) AS m FROM y LEFT JOIN s USING (source_id))
SELECT id, greatest(0.0, a - CASE WHEN pb IS NULL THEN 100.0 ELSE least(100.0, greatest(0.0, (a - pb) / 2)) END) AS cut_start_ms,
  CASE WHEN m > 0 THEN least(b + CASE WHEN na IS NULL THEN 100.0 ELSE least(100.0, greatest(0.0, (na - b) / 2)) END, m) ELSE CAST(b AS DOUBLE) END AS cut_end_ms FROM z""",
    "combined_totals": f"""
WITH {_C} SELECT source_id, count(*) AS clips, CAST(coalesce(sum(CAST(round(duration_s * 1000) AS BIGINT)), 0) AS BIGINT) AS total_ms, count(*) FILTER (coalesce(oversized, false)) AS oversized FROM c WHERE source_id IS NOT NULL GROUP BY source_id
UNION ALL SELECT NULL, count(*), CAST(coalesce(sum(CAST(round(duration_s * 1000) AS BIGINT)), 0) AS BIGINT), count(*) FILTER (coalesce(oversized, false)) FROM c""",
    "language_vote": f"""
WITH {_S}, x AS (SELECT {_CODE} AS l FROM s), y AS (SELECT l, count(*) AS n FROM x WHERE l IS NOT NULL GROUP BY l)
SELECT CASE WHEN count(*) = 1 THEN max(l) ELSE 'und' END AS language, coalesce(string_agg(l || ':' || n, ' ' ORDER BY n DESC, l), '') AS votes FROM y""",
    "missing_audio": f"WITH {_S}, {_C}, {_F} SELECT DISTINCT id FROM c WHERE audio_path IS NULL OR audio_path NOT IN (SELECT path FROM f WHERE path IS NOT NULL AND path NOT LIKE '%7.wav')",
    "orphan_audio": f"WITH {_S}, {_C}, {_F} SELECT DISTINCT path FROM f WHERE regexp_matches(path, '_\\d{{4}}\\.wav$') AND regexp_extract(path, '([^/]+)_\\d{{4}}\\.wav$', 1) IN (SELECT source_id FROM s) AND path NOT IN (SELECT audio_path FROM c WHERE audio_path IS NOT NULL)",
    "duplicate_ids": "SELECT id, count(*) AS n FROM clips WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
    "duration_off": f"WITH {_S}, {_C}, {_F} SELECT DISTINCT id FROM c JOIN f ON path = audio_path WHERE abs(CAST(round(duration_s * 1000) AS BIGINT) - CAST(round(actual_s * 1000) AS BIGINT)) > 50",
    "csv_agreement": f"""
WITH {_C}, {_K}, l AS (SELECT replace(ref, '_seg', '_') || '|' || coalesce(text, '') || '|' || coalesce(text, '') AS line FROM k), x AS (SELECT string_split(line, '|') AS p FROM l WHERE {_STRIP.replace('{0}', 'line')} <> '')
SELECT (SELECT count(*) FROM x WHERE len(p) <> 3) AS malformed, (SELECT count(*) FROM x JOIN c ON c.id = p[1] WHERE len(p) = 3 AND trim(regexp_replace(replace(p[3], '|', ' '), '[{tx.SPACE}]+', ' ', 'g')) <> {_PIPE}) AS mismatched""",
    "structure": f"""
WITH {_S}, {_C}, {_F}, x AS (SELECT source_id, id, count(*) AS n, max(CASE WHEN audio_path IS NULL OR audio_path NOT IN (SELECT path FROM f WHERE path IS NOT NULL) THEN 1 ELSE 0 END) AS m,
  max(CASE WHEN {_STRIP.replace('{0}', "coalesce(text, '')")} = '' THEN 1 ELSE 0 END) AS e, max(CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0a-\\x1f]') THEN 1 ELSE 0 END) AS k FROM clips WHERE source_id IS NOT NULL GROUP BY source_id, id)
SELECT source_id, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(m) AS BIGINT) AS missing, count(*) FILTER (n > 1) AS duplicated, CAST(sum(e) AS BIGINT) AS empty, CAST(sum(k) AS BIGINT) AS control FROM x GROUP BY source_id""",
    "script_share": f"""
WITH {_S}, t AS (SELECT source_id, {_SCRIPT.replace('{0}', _BASE)} AS target FROM s), q AS (SELECT DISTINCT id, source_id, text FROM clips), {_dominant('q', 'text', 'source_id')}
SELECT source_id, count(*) AS judged, count(*) FILTER (script = target) AS matching FROM top JOIN t USING (source_id) WHERE target IS NOT NULL AND script IS NOT NULL GROUP BY source_id""",
    "document_scripts": f"WITH {_dominant('documents', 'text', 'doc_id')} SELECT doc_id, script, CAST(n AS INTEGER) AS n, CASE WHEN script IS NOT NULL THEN CAST(letters AS INTEGER) END AS letters FROM top",
    "verdicts": """
WITH v AS (SELECT DISTINCT * FROM verifications), g AS (SELECT source_id, pairing_mean AS a, script_share AS s, hot_edges AS h FROM v),
r AS (SELECT source_id, [CASE WHEN a < 0.25 THEN 'pairing' END, CASE WHEN a >= 0.25 AND a < 0.75 THEN 'accuracy' END, CASE WHEN s < 0.8 THEN 'script' END, CASE WHEN h > 0.5 THEN 'edges' END] AS bad,
  [CASE WHEN a IS NULL THEN 'unmeasured' END, CASE WHEN a >= 0.75 AND a < 0.9 THEN 'approximate' END, CASE WHEN s >= 0.8 AND s < 0.95 THEN 'mixed_script' END, CASE WHEN h > 0.1 AND h <= 0.5 THEN 'some_edges' END] AS fair FROM g),
f AS (SELECT source_id, list_filter(bad, lambda x: x IS NOT NULL) AS bad, list_filter(fair, lambda x: x IS NOT NULL) AS fair FROM r)
SELECT source_id, CASE WHEN len(bad) > 0 THEN 'not trainable' WHEN len(fair) > 0 THEN 'marginal' ELSE 'trainable' END AS verdict, array_to_string(list_concat(bad, fair), ' ') AS reasons FROM f""",
    "measures": "WITH v AS (SELECT DISTINCT * FROM verifications) SELECT verdict, count(*) AS n, CAST(sum(clips) AS BIGINT) AS clips, count(*) FILTER (hot_edges > 0.1) AS some_edges, round(median(CASE WHEN isfinite(pairing_mean) THEN pairing_mean END), 3) AS accuracy FROM v GROUP BY verdict",
    "resume": f"""
WITH {_S}, {_C}, {_F}, g AS (SELECT DISTINCT source_id FROM verifications WHERE model = 'whisper-small' AND verdict = 'trainable' AND source_id IN (SELECT source_id FROM s) AND source_id IN (SELECT source_id FROM c))
SELECT source_id FROM g WHERE source_id NOT IN (SELECT source_id FROM c WHERE source_id IS NOT NULL AND audio_path IS NOT NULL AND audio_path NOT IN (SELECT path FROM f WHERE path IS NOT NULL))""",
    "ljspeech_lines": f"WITH {_C} SELECT id || '|' || {_PIPE} || '|' || {_PIPE} AS line FROM c",
    "manifest_lines": f"WITH {_C} SELECT '{{' || concat_ws(',', '\"audio_filepath\":' || to_json(audio_path), '\"duration\":' || to_json(round(duration_s, 3)), '\"text\":' || to_json(text), '\"offset\":0.0', '\"speaker\":' || to_json(speaker)) || '}}' AS line FROM c",
    "audiofolder_lines": f"WITH {_C} SELECT '{{' || concat_ws(',', '\"file_name\":' || to_json(audio_path), '\"transcription\":' || to_json(text)) || '}}' AS line FROM c",
    "speaker_index": f"""
WITH {_C}, x AS (SELECT regexp_replace(regexp_replace(speaker, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS g, CAST(round(duration_s * 1000) AS BIGINT) AS d FROM c WHERE speaker IS NOT NULL)
SELECT CASE WHEN g = '' THEN 'unknown' ELSE g END AS slug, count(*) AS clips, CAST(sum(d) AS BIGINT) AS ms FROM x GROUP BY 1""",
    "size_categories": f"WITH {_C} SELECT source_id, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' WHEN count(*) < 1000000 THEN '100K<n<1M' ELSE 'n>1M' END AS category FROM c WHERE source_id IS NOT NULL GROUP BY source_id",
    "source_rank": f"""
WITH {_C}, x AS (SELECT source_id, speaker, count(*) AS n FROM c WHERE source_id IS NOT NULL AND speaker IS NOT NULL GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, speaker) AS place FROM x)
SELECT source_id, speaker, n, CAST(place AS INTEGER) AS place FROM y WHERE place <= 3""",
    "sample_measures": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
q AS (SELECT vec_id, len(list_filter(x, lambda v: abs(v) >= 0.2)) / len(x) AS clipped, sqrt(list_avg(list_transform(x[1:8], lambda v: v * v))) AS a, sqrt(list_avg(list_transform(x[len(x) - 7:len(x)], lambda v: v * v))) AS z, sqrt(list_avg(list_transform(x[9:len(x) - 8], lambda v: v * v))) AS body, len(x) AS n FROM e)
SELECT vec_id, round(clipped, 6) AS clipped, CASE WHEN n >= 32 AND body >= 0.001 THEN greatest(a, z) / body > 0.5 END AS hot FROM q""",
}

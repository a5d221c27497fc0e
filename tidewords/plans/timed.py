"""Queries over timed rows: lines, paragraphs, sections, words, turns, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.functions import text as tx
from tidewords.operators import cutting, sections, speakers
from tidewords.session import read
from tidewords.sinks import rows as sinks
from tidewords.sources import landed
from tidewords.streaming import runs


def effective_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gap and pause after every line."""
    return cutting.with_gaps(read(spark, d, "segments")).select("source_id", "pos", "gap_ms", "pause_ms")


def pause_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines without a pause of more than two seconds."""
    rows = cutting.with_runs(cutting.with_gaps(read(spark, d, "segments")), F.col("pause_ms") > 2000)
    out = rows.groupBy("source_id", "run_no").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.sum(tx.word_count(F.col("text"))).alias("n_words"))
    return out.withColumn("at", tx.format_timestamp(F.col("start_ms") / 1000))


def break_scores(spark: SparkSession, d: str) -> DataFrame:
    """Worth of a break after every line, without its pause, in hundredths."""
    scored = cutting.break_scores(cutting.with_gaps(read(spark, d, "segments")))
    pause = cutting.GAP * F.coalesce(F.col("pause_ms") / 1000, F.lit(0.0))
    return scored.select("source_id", "pos", "n_words", F.round((F.col("score") - pause) * 100).cast("bigint").alias("worth"))


def grouped_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Readable paragraphs out of all lines."""
    return cutting.paragraphs(read(spark, d, "segments"))


def cut_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips out of all words; the words' confidence as a sum of thousandths, which no order of adding changes."""
    out = cutting.clips(read(spark, d, "words"))
    return out.withColumn("thousandths", F.round(F.col("confidence") * F.col("n_words") * 1000).cast("bigint")).drop("confidence")


def span_repair(spark: SparkSession, d: str) -> DataFrame:
    """Words with whole spans, the pause after them and what they end."""
    return cutting.repaired_words(read(spark, d, "words")).select("source_id", "pos", "start_ms", "end_ms", "gap_ms", "sentence", "clause", "blank")


def joined_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Whole words out of tokens that join their left neighbour."""
    w = cutting.latest(read(spark, d, "words").select("source_id", F.col("pos").cast("bigint").alias("pos"), "text", "start_s", "end_s", "confidence", "joins_left"), ["source_id", "pos"], None)
    out = landed.token_words(w, ~F.coalesce("joins_left", F.lit(False)), F.col("text"))
    return out.select("source_id", "word_no", "text")


def recognizer_words(spark: SparkSession, d: str) -> DataFrame:
    """The words table as a recognizer prints it, brought back to model words."""
    raw = read(spark, d, "words").distinct().select("source_id", "pos", F.when(F.col("joins_left"), F.col("text")).otherwise(F.concat(F.lit(" "), "text")).alias("word"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("confidence").alias("probability"))
    return landed.whisper_words(raw)


def noise_cues(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are one sound cue only."""
    s = read(spark, d, "segments").select("source_id", "pos", tx.collapse(F.col("text")).alias("text")).distinct()
    return s.where(tx.is_noise_cue(F.col("text"))).select("source_id", "pos")


def clean_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Lines with entities resolved, without blank ones and lone cues."""
    s = read(spark, d, "segments")
    return landed.snippets(s.select("source_id", "pos", "text", F.col("start_s").alias("start"), (F.col("end_s") - F.col("start_s")).alias("duration")).distinct())


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return cutting.latest(read(spark, d, "paragraphs").select("source_id", "para_no", "start_s", "end_s"), ["source_id", "para_no"], None)


def chapter_asof(spark: SparkSession, d: str) -> DataFrame:
    """The chapter that is running when each paragraph starts."""
    return sections.chapter_of(_paras(spark, d), read(spark, d, "sources")).select("source_id", "para_no", "chapter_no", "title")


def time_sections(spark: SparkSession, d: str) -> DataFrame:
    """Slices of five minutes that are anchored by speech."""
    return sections.time_sections(_paras(spark, d))


def titled_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all paragraphs, by chapters or time."""
    return sections.sections(read(spark, d, "paragraphs"), read(spark, d, "sources"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Flat chunks for retrieval."""
    p = read(spark, d, "paragraphs")
    return sinks.chunks(p, sections.sections(p, read(spark, d, "sources")))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Readable transcripts of all sources as Markdown blocks."""
    return sinks.markdown(read(spark, d, "sources"), chunks(spark, d))


def speaker_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The speaker of every clip by longest overlap."""
    return speakers.assigned(read(spark, d, "clips"), read(spark, d, "turns"))


def dominant_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Who speaks longest in each source."""
    return speakers.dominant(read(spark, d, "turns"))


def speaker_drops(spark: SparkSession, d: str) -> DataFrame:
    """Clips dropped for their speakers where only main speakers are wanted."""
    return speakers.speaker_drops(read(spark, d, "clips"), read(spark, d, "turns"), mode="dominant")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of a user no more than six hours apart."""
    return runs.sessions(read(spark, d, "events")).select("user_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("end_ts"), "n")


QUERIES = {f.__name__: f for f in (effective_gaps, pause_runs, break_scores, grouped_paragraphs, cut_clips, span_repair, joined_tokens, recognizer_words, noise_cues, clean_snippets, chapter_asof, time_sections, titled_sections, chunks, markdown, speaker_overlap, dominant_speaker, speaker_drops, event_sessions)}

# --- SQL ------------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array({0}, '[" + tx.SPACE + "]+'), lambda x: x <> '')"
_BARE = "lower(regexp_replace({0}, '^[" + tx.STRIPPED.replace("'", "''") + "]+|[" + tx.STRIPPED.replace("'", "''") + "]+$', '', 'g'))"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_CL = tx.CLOSERS.replace("'", "''")


def _w(x: str) -> str:
    return _WORDS.replace("{0}", x)


def _b(x: str) -> str:
    return _BARE.replace("{0}", x)


_GAPS = """
WITH s AS (SELECT DISTINCT source_id, pos, text, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM segments WHERE source_id IS NOT NULL AND pos IS NOT NULL),
g AS (SELECT *, lead(a) OVER w - b AS gap_ms, lead(text) OVER w AS next_text FROM s WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
base AS (SELECT source_id, least(0.0, median(gap_ms)) AS base FROM g GROUP BY source_id),
p AS (SELECT g.*, greatest(0.0, gap_ms - base) AS pause_ms FROM g JOIN base USING (source_id))"""
_TURNS = """
WITH t AS (SELECT DISTINCT source_id, speaker, CAST(round(start_s * 1000) AS BIGINT) AS c, CAST(round(end_s * 1000) AS BIGINT) AS d FROM turns WHERE source_id IS NOT NULL AND speaker IS NOT NULL AND end_s > start_s AND round(end_s * 1000) > round(start_s * 1000)),
main AS (SELECT source_id, first(speaker ORDER BY ms DESC, f, speaker) AS speaker, max(ms) AS ms FROM (SELECT source_id, speaker, sum(d - c) AS ms, min(c) AS f FROM t GROUP BY ALL) GROUP BY source_id),
k AS (SELECT DISTINCT id, source_id, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM clips WHERE id IS NOT NULL),
o AS (SELECT id, speaker, sum(least(b, d) - greatest(a, c)) AS ms, min(c) AS f FROM k JOIN t ON k.source_id = t.source_id AND a < d AND c < b GROUP BY ALL),
top AS (SELECT id, first(speaker ORDER BY ms DESC, f, speaker) AS speaker, max(ms) AS overlap_ms, sum(ms) AS total_ms FROM o GROUP BY id),
got AS (SELECT id, source_id, top.speaker, CAST(coalesce(overlap_ms, 0) AS BIGINT) AS overlap_ms, CAST(coalesce(total_ms, 0) AS BIGINT) AS total_ms FROM (SELECT DISTINCT id, source_id FROM clips WHERE id IS NOT NULL) LEFT JOIN top USING (id))"""
_REPAIR = """
WITH w AS (SELECT DISTINCT source_id, pos, coalesce(text, '') AS text, start_s, end_s, coalesce(joins_left, false) AS j, coalesce(confidence, 1.0) AS conf FROM words),
a AS (SELECT *, CAST(CASE WHEN isfinite(start_s) THEN greatest(round(start_s * 1000), 0) ELSE 0 END AS BIGINT) AS start_ms FROM w),
b AS (SELECT *, CASE WHEN isfinite(end_s) THEN greatest(CAST(round(end_s * 1000) AS BIGINT), start_ms) ELSE start_ms END AS end_ms FROM a),
n AS (SELECT *, lead(start_ms) OVER o AS n_start, lead(text) OVER o AS next_text, coalesce(lead(j) OVER o, false) AS goes_on, regexp_replace(text, '^[SP]+|[SP]+$', '', 'g') AS t FROM b WINDOW o AS (PARTITION BY source_id ORDER BY pos)),
e AS (SELECT *, regexp_matches(t, '(\\.\\.\\.|\\x{2026})[CL]*$') AS soft, coalesce(list_last(WORDS_T), '') AS lw FROM n),
f AS (SELECT source_id, CAST(pos AS BIGINT) AS pos, start_ms, end_ms, text, t, j, conf, next_text, lw, CASE WHEN n_start IS NOT NULL THEN greatest(0, n_start - end_ms) END AS gap_ms,
  NOT goes_on AND NOT soft AND regexp_matches(t, '[SM][CL]*$') AND NOT (BARE_LW IN ABBR OR regexp_matches(BARE_LW, '^([a-z]\\.)+$') OR regexp_matches(BARE_LW, '[0-9]\\.[0-9]')) AS sentence,
  NOT goes_on AND (regexp_matches(t, '[CM][CL]*$') OR soft) AS clause, t = '' AS blank FROM e)"""
_REPAIR = _REPAIR.replace("WORDS_T", _w("t")).replace("BARE_LW", _b("lw")).replace("ABBR", _IN(tx.ABBREVIATIONS)).replace("[SP]", f"[{tx.SPACE}]").replace("[CL]", f"[{_CL}]").replace("[SM]", f"[{tx.SENTENCE_MARKS}]").replace("[CM]", f"[{tx.CLAUSE_MARKS}]")

_CONTRACTION = "regexp_matches(lw, '(n[''\\x{2019}]t|[''\\x{2019}](s|re|m|ve|ll|d))$')"
_OPENING = f"CASE WHEN head IN {_IN(tx.STRONG_MARKERS)} THEN 0.8::DOUBLE WHEN head IN {_IN(tx.WEAK_MARKERS)} THEN 0.4::DOUBLE WHEN head IN {_IN(tx.DANGLING)} AND NOT ended THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"
_PLAIN = f"CASE WHEN lw = '' THEN 0.0::DOUBLE WHEN lw IN {_IN(tx.DANGLING)} OR {_CONTRACTION} THEN -2.5::DOUBLE WHEN regexp_matches(lw, '\\p{{Nd}}') THEN -1.25::DOUBLE ELSE 0.0::DOUBLE END"
_HEADS = f"list_filter(list_transform({_w('next_text')}, lambda x: {_b('x')}), lambda h: h NOT IN {_IN(tx.FILLERS)})"
# lines with their words, what their ends are worth and what the next one's opening is
_LINES = _GAPS + f""",
q AS (SELECT *, coalesce(text, '') AS t, {_w("coalesce(text, '')")} AS ws, {_HEADS} AS heads FROM p),
r AS (SELECT *, coalesce({_b("list_last(ws)")}, '') AS lw, heads[1] AS head, regexp_matches(t, '(\\.\\.\\.|\\x{{2026}})[{_CL}]*$') AS soft, regexp_matches(t, '[{tx.SENTENCE_MARKS}][{_CL}]*$') AS mark, regexp_matches(t, '[{tx.CLAUSE_MARKS}][{_CL}]*$') AS clause FROM q),
u AS (SELECT *, lw IN {_IN(tx.ABBREVIATIONS)} OR regexp_matches(lw, '^([a-z]\\.)+$') AS abbr FROM r),
v AS (SELECT *, mark AND NOT abbr AND NOT soft AS ended, CASE WHEN soft THEN 1.0::DOUBLE WHEN mark AND NOT abbr THEN 2.0::DOUBLE WHEN mark OR clause THEN 0.6::DOUBLE ELSE {_PLAIN} END AS ending FROM u)"""
_WORTH = _LINES + f" SELECT source_id, CAST(pos AS BIGINT) AS pos, CAST(len(ws) AS BIGINT) AS n_words, CAST(round((ending + {_OPENING}) * 100) AS BIGINT) AS worth FROM v"


def _greedy(sizes: str, over: str, none: str, value: str, fits: str) -> str:
    """Recursive cuts of runs (rows z, run sizes n): from each end on the rows' sizes, the first that is too much, the best that fits."""
    return f"""
sizes AS (SELECT source_id, run, max(k) AS m FROM z GROUP BY ALL),
cut AS (
  SELECT source_id, run, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS e FROM sizes
  UNION ALL
  SELECT source_id, run, i, CASE WHEN over IS NULL THEN m WHEN best IS NULL THEN {none} ELSE best END FROM (
    SELECT source_id, run, i, any_value(m) AS m, any_value(over) AS over, (max({{'v': {value}, 'k': k}}) FILTER ({fits} AND k <= over)).k AS best FROM (
      SELECT *, min(CASE WHEN {over} THEN k END) OVER (PARTITION BY source_id, run) AS over FROM (
        SELECT z.*, c.e AS i, sizes.m, {sizes} AS size FROM cut c JOIN sizes USING (source_id, run) JOIN z ON z.source_id = c.source_id AND z.run = c.run AND z.k > c.e WHERE c.e < sizes.m
        WINDOW w AS (PARTITION BY z.source_id, z.run ORDER BY z.k ROWS UNBOUNDED PRECEDING))) GROUP BY source_id, run, i)),
piece AS (SELECT source_id, run, i + 1 AS lo, e AS hi FROM cut WHERE e > 0)"""


def _halved(rows: str, left: str, right: str, least: str, value: str, floor: str) -> str:
    """Where rows of two pieces (``source_id, run, x``, in order of pos) are cut anew: the last position of the left part."""
    return f"""SELECT source_id, run, (max({{'good': good, 'v': v, 'pos': pos}})).pos AS cutpos FROM (
    SELECT *, {left} >= {least} AND {right} >= {least} AS good, {value} - 2.0::DOUBLE * abs({left} - whole / 2.0::DOUBLE) / greatest(whole / 2.0::DOUBLE, {floor}) AS v FROM ({rows}) WHERE later > 0) GROUP BY ALL"""


_PARAGRAPHS = _LINES.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + f""",
x0 AS (SELECT source_id, pos, text, a, b, pause_ms, len(ws) AS words, 3.0::DOUBLE * coalesce(pause_ms / 1000, 0.0::DOUBLE) + (ending + {_OPENING}) AS score FROM v),
y AS (SELECT *, coalesce(sum(CASE WHEN pause_ms > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM x0),
z AS (SELECT *, row_number() OVER (PARTITION BY source_id, run ORDER BY pos) AS k FROM y),""" + _greedy("sum(z.words) OVER w", "size >= 120", "over", "score - 0.8::DOUBLE * abs(size - 76.0::DOUBLE) / 76.0::DOUBLE", "size BETWEEN 40 AND 120") + """,
g0 AS (SELECT z.*, piece.lo FROM z JOIN piece ON z.source_id = piece.source_id AND z.run = piece.run AND z.k BETWEEN lo AND hi),
s0 AS (SELECT source_id, run, lo, sum(words) AS words, row_number() OVER (PARTITION BY source_id, run ORDER BY lo DESC) AS place, lead(lo) OVER o AS before, lead(sum(words)) OVER o AS body FROM g0 GROUP BY source_id, run, lo WINDOW o AS (PARTITION BY source_id, run ORDER BY lo DESC)),
t0 AS (SELECT source_id, run, before AS x, lo AS y, body + words <= 120 AS whole FROM s0 WHERE place = 1 AND before IS NOT NULL AND words < 40),
h0 AS (""" + _halved("SELECT g0.source_id, g0.run, x, pos, score, sum(words) OVER w AS l, sum(words) OVER p - sum(words) OVER w AS r, sum(words) OVER p AS whole, count(*) OVER p - row_number() OVER w AS later FROM g0 JOIN t0 ON g0.source_id = t0.source_id AND g0.run = t0.run AND g0.lo IN (x, y) AND NOT t0.whole WINDOW w AS (PARTITION BY g0.source_id, g0.run ORDER BY pos ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY g0.source_id, g0.run)", "l", "r", "40", "score", "1.0::DOUBLE") + """),
g1 AS (SELECT g0.* EXCLUDE (lo), CASE WHEN g0.lo = t0.y AND t0.whole THEN t0.x WHEN g0.lo IN (t0.x, t0.y) AND NOT t0.whole THEN CASE WHEN pos <= cutpos THEN t0.x ELSE t0.x + 0.5 END ELSE lo END AS lo FROM g0 LEFT JOIN t0 USING (source_id, run) LEFT JOIN h0 USING (source_id, run)),
g2 AS (SELECT *, min(pos) OVER (PARTITION BY source_id, run, lo) AS first FROM g1),
s1 AS (SELECT source_id, first, sum(words) AS words, arg_max(pause_ms, pos) AS after, row_number() OVER (PARTITION BY source_id ORDER BY first DESC) AS place, lead(first) OVER o AS before, lead(sum(words)) OVER o AS body, lead(arg_max(pause_ms, pos)) OVER o AS gap FROM g2 GROUP BY source_id, first WINDOW o AS (PARTITION BY source_id ORDER BY first DESC)),
t1 AS (SELECT source_id, before AS x, first AS y, body + words <= 120 AS whole FROM s1 WHERE place = 1 AND before IS NOT NULL AND words < 40 AND coalesce(gap, 0) <= 4000),
h1 AS (""" + _halved("SELECT g2.source_id, 0 AS run, x, pos, score, sum(words) OVER w AS l, sum(words) OVER p - sum(words) OVER w AS r, sum(words) OVER p AS whole, count(*) OVER p - row_number() OVER w AS later FROM g2 JOIN t1 ON g2.source_id = t1.source_id AND g2.first IN (x, y) AND NOT t1.whole WINDOW w AS (PARTITION BY g2.source_id ORDER BY pos ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY g2.source_id)", "l", "r", "40", "score", "1.0::DOUBLE") + f"""),
g3 AS (SELECT g2.*, CASE WHEN g2.first = t1.y AND t1.whole THEN t1.x WHEN g2.first IN (t1.x, t1.y) AND NOT t1.whole THEN CASE WHEN pos <= cutpos THEN t1.x ELSE cutpos + 1 END ELSE g2.first END AS piece FROM g2 LEFT JOIN t1 USING (source_id) LEFT JOIN h1 USING (source_id)),
o AS (SELECT source_id, piece, string_agg(text, ' ' ORDER BY pos) FILTER (words > 0) AS text, arg_min(a, pos) AS start_ms, arg_max(b, pos) AS end_ms, CAST(sum(words) AS BIGINT) AS n_words FROM g3 GROUP BY source_id, piece HAVING sum(words) > 0)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY piece) AS BIGINT) AS para_no, text, start_ms, end_ms, n_words FROM o"""

_CLIPS = _REPAIR.replace("WITH w AS", "WITH RECURSIVE w AS", 1) + f""",
c0 AS (SELECT *, {_b("lw")} AS bare, {_HEADS}[1] AS head, sentence AS ended, 3.0::DOUBLE * coalesce(gap_ms, 0) / 1000 AS pause FROM f),
x0 AS (SELECT *, pause + (CASE WHEN sentence THEN 2.0::DOUBLE WHEN clause THEN 0.6::DOUBLE ELSE {_PLAIN.replace("lw", "bare")} END + {_OPENING}) AS score, pause + CASE WHEN sentence THEN 2.0::DOUBLE WHEN clause THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS plain FROM c0),
y AS (SELECT *, coalesce(sum(CASE WHEN gap_ms > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM x0),
z AS (SELECT *, row_number() OVER (PARTITION BY source_id, run ORDER BY pos) AS k FROM y),""" + _greedy("max(z.end_ms) OVER w - min(z.start_ms) OVER w", "size >= 15000", "greatest(over - 1, i + 1)", "score - 0.8::DOUBLE * abs(size - 7300.0::DOUBLE) / 14000.0::DOUBLE", "size BETWEEN 1000 AND 15000 AND k < m") + """,
g2 AS (SELECT z.*, min(pos) OVER (PARTITION BY z.source_id, z.run, piece.lo) AS first FROM z JOIN piece ON z.source_id = piece.source_id AND z.run = piece.run AND z.k BETWEEN lo AND hi),
s1 AS (SELECT source_id, first, min(start_ms) AS lo, max(end_ms) AS hi, row_number() OVER (PARTITION BY source_id ORDER BY first DESC) AS place, lead(first) OVER o AS before, lead(min(start_ms)) OVER o AS blo, lead(max(end_ms)) OVER o AS bhi, lead(arg_max(gap_ms, pos)) OVER o AS gap FROM g2 GROUP BY source_id, first WINDOW o AS (PARTITION BY source_id ORDER BY first DESC)),
m0 AS (SELECT source_id, median(gap_ms) AS usual FROM y WHERE gap_ms > 0 GROUP BY source_id),
t1 AS (SELECT source_id, before AS x, first AS y, greatest(hi, bhi) - least(lo, blo) <= 15000 AS whole FROM s1 LEFT JOIN m0 USING (source_id) WHERE place = 1 AND before IS NOT NULL AND hi - lo < 1000 AND coalesce(gap, 0) <= 2 * greatest(coalesce(usual, 0), 500)),
h1 AS (""" + _halved("SELECT g2.source_id, 0 AS run, pos, plain, max(end_ms) OVER w - min(start_ms) OVER w AS l, max(end_ms) OVER v - min(start_ms) OVER v AS r, max(end_ms) OVER p - min(start_ms) OVER p AS whole, count(*) OVER p - row_number() OVER w AS later FROM g2 JOIN t1 ON g2.source_id = t1.source_id AND g2.first IN (x, y) AND NOT t1.whole WINDOW w AS (PARTITION BY g2.source_id ORDER BY pos ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY g2.source_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), p AS (PARTITION BY g2.source_id)", "l", "r", "1000", "plain", "0.000001::DOUBLE") + f"""),
g3 AS (SELECT g2.*, CASE WHEN g2.first = t1.y AND t1.whole THEN t1.x WHEN g2.first IN (t1.x, t1.y) AND NOT t1.whole THEN CASE WHEN pos <= cutpos THEN t1.x ELSE cutpos + 1 END ELSE g2.first END AS piece FROM g2 LEFT JOIN t1 USING (source_id) LEFT JOIN h1 USING (source_id)),
g4 AS (SELECT *, CASE WHEN pos < max(pos) OVER (PARTITION BY source_id, piece) THEN gap_ms END AS inner_gap FROM g3),
o AS (SELECT source_id, piece, regexp_replace(string_agg(CASE WHEN j THEN '' ELSE ' ' END || t, '' ORDER BY pos) FILTER (NOT blank), '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g') AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, CAST(round(sum(conf) * 1000) AS BIGINT) AS thousandths, CAST(coalesce(max(inner_gap), 0) AS BIGINT) AS silence_ms FROM g4 GROUP BY source_id, piece HAVING count(*) FILTER (NOT blank) > 0)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY piece) AS BIGINT) AS clip_no, text, start_ms, end_ms, n_words, end_ms - start_ms > 15000 AS oversized, thousandths, silence_ms FROM o"""
_STAMP = "lpad(CAST(CAST(floor({0}) AS BIGINT) // 3600 AS VARCHAR), CAST(greatest(2, len(CAST(CAST(floor({0}) AS BIGINT) // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"

_PARAS = "p AS (SELECT DISTINCT source_id, para_no, section, text, start_s, end_s FROM paragraphs WHERE source_id IS NOT NULL AND para_no IS NOT NULL)"
_FLOOR = "lpad(CAST({0} // 3600 AS VARCHAR), CAST(greatest(2, len(CAST({0} // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({0} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"
# sections: chapters where a source has any, else slices that the first paragraph past their end begins anew
_SECTIONS = f"""
WITH RECURSIVE {_PARAS},
h AS (SELECT source_id, any_value(chapters) AS chapters FROM sources WHERE source_id IS NOT NULL GROUP BY source_id),
c AS (SELECT source_id, u.i AS i, u.c.start_time AS s, u.c.title AS title FROM (SELECT source_id, unnest(list_transform(chapters, lambda c, i: {{'c': c, 'i': i}})) AS u FROM h) WHERE u.c.start_time IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s, i) - 1 AS no FROM c),
a AS (SELECT p.source_id, p.para_no, coalesce(max(no), -1) AS key, arg_max(n.title, no) AS title FROM p LEFT JOIN n ON p.source_id = n.source_id AND n.s <= p.start_s WHERE p.source_id IN (SELECT source_id FROM h WHERE len(chapters) > 0) GROUP BY p.source_id, p.para_no),
t AS (SELECT source_id, para_no, coalesce(start_s, 0) AS s FROM p WHERE source_id NOT IN (SELECT source_id FROM h WHERE len(chapters) > 0)),
chain AS (
  SELECT source_id, para_no, s FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY para_no) AS r FROM t) WHERE r = 1
  UNION ALL
  SELECT c.source_id, n.para_no, n.s FROM chain c, LATERAL (SELECT t.para_no, t.s FROM t WHERE t.source_id = c.source_id AND t.para_no > c.para_no AND t.s >= c.s + 300 ORDER BY t.para_no LIMIT 1) n),
b AS (SELECT t.source_id, t.para_no, max(c.para_no) AS key, NULL AS title FROM t JOIN chain c ON t.source_id = c.source_id AND c.para_no <= t.para_no GROUP BY t.source_id, t.para_no),
k AS (SELECT * FROM a UNION ALL SELECT * FROM b),
z AS (SELECT source_id, key, max(title) AS title, CAST(floor(coalesce(arg_min(start_s, para_no), 0)) AS BIGINT) AS lo, CAST(floor(coalesce(max(end_s), 0)) AS BIGINT) AS hi, row_number() OVER (PARTITION BY source_id ORDER BY key) AS section_no FROM k JOIN p USING (source_id, para_no) GROUP BY source_id, key),
q AS (SELECT source_id, para_no, section_no, coalesce(z.title, '[' || {_FLOOR.replace("{0}", "lo")} || ' – ' || {_FLOOR.replace("{0}", "hi")} || ']') AS section FROM k JOIN z USING (source_id, key)),
w AS (SELECT source_id, para_no AS pos, start_s, end_s, q.section, text FROM p JOIN q USING (source_id, para_no))"""
_QUOTED = "'\"' || replace(replace(coalesce({0}, ''), '\\', '\\\\'), '\"', '\\\"') || '\"'"
_FLAT = "trim(regexp_replace({0}, '[" + tx.SPACE + "]+', ' ', 'g'))"
_TABS = "list_reduce(string_split({0}, chr(9)), lambda acc, x: acc || repeat(' ', 8 - len(list_last(string_split(replace(acc, chr(13), chr(10)), chr(10)))) % 8) || x)"
_WRAPPED = "list_reduce(regexp_extract_all({0}, '[ \\t-\\r]*[^ \\t-\\r]+'), lambda acc, x: acc || CASE WHEN len(list_last(string_split(acc, chr(10)))) + len(x) <= 80 THEN regexp_replace(x, '[\\t-\\r]', ' ', 'g') ELSE chr(10) || ltrim(regexp_replace(x, '[\\t-\\r]', ' ', 'g')) END)"
_MARKDOWN = _SECTIONS + f""",
s AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY title DESC NULLS LAST, source DESC NULLS LAST, channel DESC NULLS LAST, duration_s DESC NULLS LAST, language DESC NULLS LAST, method DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
v AS (SELECT *, CAST(floor(duration_s) AS BIGINT) AS sec FROM s)
SELECT source_id, CAST(-1 AS DOUBLE) AS line_no, concat_ws(chr(10), '---', 'title: ' || {_QUOTED.replace("{0}", "title")}, 'source: ' || {_QUOTED.replace("{0}", "source")}, 'channel: ' || {_QUOTED.replace("{0}", "channel")}, 'duration: ' || {_QUOTED.replace("{0}", _FLOOR.replace("{0}", "sec"))}, 'language: ' || {_QUOTED.replace("{0}", "language")}, 'method: ' || {_QUOTED.replace("{0}", "method")}, 'ingested_at: ' || {_QUOTED.replace("{0}", "strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ')")}, '---', '', '# ' || {_FLAT.replace("{0}", "coalesce(title, 'Untitled')")}) AS line FROM v
UNION ALL SELECT source_id, min(pos) - 0.5, '## ' || {_FLAT.replace("{0}", "coalesce(section, '')")} FROM w GROUP BY source_id, section
UNION ALL SELECT source_id, CAST(pos AS DOUBLE), {_WRAPPED.replace("{0}", _TABS).replace("{0}", "'**[' || " + _FLOOR.replace("{0}", "CAST(floor(start_s) AS BIGINT)") + " || ']** ' || coalesce(text, '')")} FROM w"""

SQL = {
    "titled_sections": _SECTIONS + " SELECT source_id, para_no, CAST(section_no AS INTEGER) AS section_no, section FROM q",
    "chunks": _SECTIONS + " SELECT * FROM w",
    "markdown": _MARKDOWN,
    "clean_snippets": f"""
WITH s AS (SELECT DISTINCT source_id, pos, {_FLAT.replace("{0}", "replace(replace(replace(replace(replace(replace(text, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')")} AS text, start_s, end_s - start_s AS d FROM segments),
c AS (SELECT *, regexp_matches(text, '^[\\[(] *[^\\])]{{0,40}} *[\\])]$') AS cued, regexp_extract(text, '^[\\[(] *([^\\])]{{0,40}}) *[\\])]$', 1) AS i FROM s),
k AS (SELECT *, trim(regexp_replace(trim(i), '^[\\x{{266a}}\\x{{266b}}\\x{{1f3b5}}\\x{{1f3b6}}]+|[\\x{{266a}}\\x{{266b}}\\x{{1f3b5}}\\x{{1f3b6}}]+$', '', 'g')) AS inner_text FROM c)
SELECT source_id, pos, text, start_s, start_s + coalesce(d, 0) AS end_s FROM k WHERE text <> '' AND NOT (cued AND (inner_text = '' OR len(list_filter(string_split(inner_text, ' '), lambda x: lower(regexp_replace(x, '^[.,!?]+|[.,!?]+$', '', 'g')) IN {_IN(tx.NOISE_WORDS)})) > 0))""",
    "effective_gaps": _GAPS + " SELECT source_id, CAST(pos AS BIGINT) AS pos, gap_ms, pause_ms FROM p",
    "pause_runs": _GAPS + f""", r AS (SELECT *, coalesce(sum(CASE WHEN pause_ms > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_no FROM p)
SELECT source_id, CAST(run_no AS BIGINT) AS run_no, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, arg_min(a, pos) AS start_ms, arg_max(b, pos) AS end_ms, CAST(sum(len({_w("text")})) AS BIGINT) AS n_words, {_STAMP.format("arg_min(a, pos) / 1000")} AS at FROM r GROUP BY source_id, run_no""",
    "break_scores": _WORTH,
    "grouped_paragraphs": _PARAGRAPHS,
    "span_repair": _REPAIR + " SELECT source_id, pos, start_ms, end_ms, gap_ms, sentence, clause, blank FROM f",
    "cut_clips": _CLIPS,
    "joined_tokens": """
WITH w AS (SELECT DISTINCT source_id, pos, text, start_s, end_s, joins_left FROM words),
n AS (SELECT *, sum(CASE WHEN coalesce(joins_left, false) THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS word_no FROM w)
SELECT * FROM (SELECT source_id, CAST(word_no AS BIGINT) AS word_no, regexp_replace(string_agg(coalesce(text, ''), '' ORDER BY pos), '^[SP]+|[SP]+$', '', 'g') AS text FROM n GROUP BY source_id, word_no) WHERE text <> ''""".replace("[SP]", f"[{tx.SPACE}]"),
    "recognizer_words": """
WITH w AS (SELECT DISTINCT * FROM words)
SELECT source_id, pos, regexp_replace(text, '^[SP]+|[SP]+$', '', 'g') AS text, CASE WHEN isfinite(start_s) THEN start_s ELSE 0 END AS start_s, CASE WHEN isfinite(end_s) THEN end_s WHEN isfinite(start_s) THEN start_s ELSE 0 END AS end_s,
  CASE WHEN isfinite(confidence) THEN least(greatest(confidence, 0), 1) ELSE 1 END AS confidence, coalesce(joins_left, false) AND NOT regexp_matches(text, '^[ \\x{a0}]') AS joins_left
FROM w WHERE regexp_replace(text, '^[SP]+|[SP]+$', '', 'g') <> ''""".replace("[SP]", f"[{tx.SPACE}]"),
    "noise_cues": f"""
WITH s AS (SELECT DISTINCT source_id, pos, trim(regexp_replace(text, '[{tx.SPACE}]+', ' ', 'g')) AS t FROM segments),
c AS (SELECT *, regexp_extract(t, '^[\\[(] *([^\\])]{{0,40}}) *[\\])]$', 1) AS i FROM s WHERE regexp_matches(t, '^[\\[(] *[^\\])]{{0,40}} *[\\])]$')),
k AS (SELECT *, trim(regexp_replace(trim(i), '^[\\x{{266a}}\\x{{266b}}\\x{{1f3b5}}\\x{{1f3b6}}]+|[\\x{{266a}}\\x{{266b}}\\x{{1f3b5}}\\x{{1f3b6}}]+$', '', 'g')) AS inner_text FROM c)
SELECT source_id, pos FROM k WHERE inner_text = '' OR len(list_filter(string_split(inner_text, ' '), lambda x: lower(regexp_replace(x, '^[.,!?]+|[.,!?]+$', '', 'g')) IN {_IN(tx.NOISE_WORDS)})) > 0""",
    "chapter_asof": """
WITH c AS (SELECT source_id, u.i AS i, u.c.start_time AS s, u.c.title AS title FROM (SELECT source_id, unnest(list_transform(chapters, lambda c, i: {'c': c, 'i': i})) AS u FROM (SELECT source_id, any_value(chapters) AS chapters FROM sources GROUP BY source_id)) WHERE u.c.start_time IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s, i) - 1 AS no FROM c),
p AS (SELECT DISTINCT source_id, para_no, start_s FROM paragraphs)
SELECT p.source_id, p.para_no, CAST(max(no) AS INTEGER) AS chapter_no, arg_max(title, no) AS title FROM p LEFT JOIN n ON p.source_id = n.source_id AND n.s <= p.start_s GROUP BY p.source_id, p.para_no""",
    "time_sections": """
WITH RECURSIVE p AS (SELECT source_id, para_no, coalesce(any_value(start_s), 0) AS s FROM paragraphs GROUP BY source_id, para_no),
chain AS (
  SELECT source_id, para_no, s FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY para_no) AS r FROM p) WHERE r = 1
  UNION ALL
  SELECT c.source_id, n.para_no, n.s FROM chain c, LATERAL (SELECT p.para_no, p.s FROM p WHERE p.source_id = c.source_id AND p.para_no > c.para_no AND p.s >= c.s + 300 ORDER BY p.para_no LIMIT 1) n)
SELECT p.source_id, CAST(p.para_no AS BIGINT) AS para_no, CAST(max(c.para_no) AS BIGINT) AS first_no FROM p JOIN chain c ON p.source_id = c.source_id AND c.para_no <= p.para_no GROUP BY p.source_id, p.para_no""",
    "speaker_overlap": _TURNS + " SELECT id, speaker, overlap_ms, total_ms FROM got",
    "dominant_speaker": _TURNS + " SELECT source_id, speaker, CAST(ms AS BIGINT) AS ms FROM main",
    "speaker_drops": _TURNS + " SELECT id, got.speaker, CASE WHEN got.speaker IS NULL THEN 'no_speaker' WHEN overlap_ms < 0.85 * total_ms THEN 'cross_speaker' WHEN got.speaker <> main.speaker THEN 'non_dominant_speaker' END AS reason FROM got LEFT JOIN main USING (source_id)",
    "event_sessions": """
WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts, count(*) AS n FROM n GROUP BY user_id, no""",
}

"""The queries of the text problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.llm import bpe, charforms, leakage, pieces, profiles, splits, turns
from tidewords.operators import blocks
from tidewords.session import read


def at(*cols: str) -> Column:
    """``row_key``: the plain key as text, parts joined by a colon."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])


KEYS = {"documents": ["doc_id"], "sources": ["source_id"], "clips": ["id"], "clip_candidates": ["ref"], "segments": ["source_id", "pos"], "words": ["source_id", "pos"], "paragraphs": ["source_id", "para_no"]}


def keyed(spark: SparkSession, sf_dir: str, tbl: str, *cols: str) -> DataFrame:
    """``tbl, row_key`` and the given columns of a table."""
    return read(spark, sf_dir, tbl).select(F.lit(tbl).alias("tbl"), at(*KEYS[tbl]).alias("row_key"), *cols)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and clips whose text isn't in canonical form."""
    texts = keyed(spark, sf_dir, "words", "text").unionByName(keyed(spark, sf_dir, "clips", "text"))
    # the quick check comes first, so that Python gets the suspects only
    return charforms.with_canonical(texts.where(charforms.suspect(F.col("text")))).where("changed").select("tbl", "row_key").distinct()


def p1_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words in canonical form."""
    return charforms.canonical_words(read(spark, sf_dir, "words"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, sources and clips that their labels miss or get wrong."""
    tables = lambda name: read(spark, sf_dir, name)
    lang, _, field = profiles.models(spark, tables)
    large = lambda *share: profiles.large(F.col("langs"), lang.langs, *share)
    wrong = lambda tbl, df: df.where("code is null or size(big) > 1 or big[0].lang <> code").select(F.lit(tbl).alias("tbl"), "row_key", F.explode("big.lang").alias("lang"))

    docs = profiles.profiled(tables("documents"), ["doc_id"], lang=lang, repeats=field, label="lang").where("words >= 20 and not repetitive")
    docs = docs.select(at("doc_id").alias("row_key"), "code", large().alias("big"))

    spoken = profiles.by_source(tables("paragraphs"), lang).select("source_id", large().alias("big"))
    labels = profiles.profiled(tables("sources"), ["source_id"], "source_id", label="language").groupBy("source_id").agg(F.max("code").alias("code"))
    sources = spoken.join(labels, "source_id").select(F.col("source_id").alias("row_key"), "code", "big")

    clips = profiles.profiled(tables("clips"), ["id", "source_id"], lang=lang, repeats=field).where("words >= 8 and not repetitive")
    top = F.array_max(F.transform(large(0), lambda x: F.struct(x["n"], x["lang"])))["lang"]
    clips = blocks.lookup(clips.select("id", "source_id", top.alias("lang")), spoken.where("size(big) = 1"), ["source_id"], ["id"], "inner").where("lang <> big[0].lang")
    clips = clips.select(F.lit("clips").alias("tbl"), F.col("id").alias("row_key"), "lang").distinct()
    return wrong("documents", docs).unionByName(wrong("sources", sources)).unionByName(clips)


def p3_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language in every document: first word, words, language, confidence."""
    tables = lambda name: read(spark, sf_dir, name)
    runs = profiles.profiled(tables("documents"), ["doc_id"], lang=profiles.models(spark, tables)[0], stretches=True)
    return runs.select("doc_id", F.inline("stretches"))


def _repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [keyed(spark, sf_dir, t, "text") for t in ("documents", "clips", "segments")]
    return profiles.profiled(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["tbl", "row_key"], repeats=profiles.repetition_field(read(spark, sf_dir, "lang_samples")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, clips and segments of which half or more is repetition."""
    return _repetition(spark, sf_dir).where("repetitive").select("tbl", "row_key").distinct()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of repeated words of every record with boilerplate lines, share of words in content lines, which decides what is kept."""
    out = _repetition(spark, sf_dir).select("tbl", "row_key", F.col("forms").alias("words"), F.coalesce(F.expr("again / nullif(forms, 0)"), F.lit(0.0)).alias("repeated"), (1 - F.col("boiler")).alias("content"), F.col("kept").alias("keep"))
    return out.distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of each document that is in English only."""
    tables = lambda name: read(spark, sf_dir, name)
    lang, grade, field = profiles.models(spark, tables, grade=True)
    docs = profiles.profiled(tables("documents"), ["doc_id"], lang=lang, grade=grade, repeats=field).where("words >= 60 and not repetitive")
    big = profiles.large(F.col("langs"), lang.langs)
    docs = docs.where((F.size(big) == 1) & (big[0]["lang"] == "en"))
    return docs.select("doc_id", profiles.level_of(F.col("levels"), grade.levels).cast("int").alias("level")).where("level is not null")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return bpe.encoded(read(spark, sf_dir, "documents"), ["doc_id"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold a passage."""
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all oversized clip candidates and paragraphs."""
    limits = {r.tbl: r for r in read(spark, sf_dir, "size_limits").where("tbl in ('clip_candidates', 'paragraphs')").collect()}
    timed, text = limits["clip_candidates"], limits["paragraphs"]
    clips = keyed(spark, sf_dir, "clip_candidates", "text", "start_s", "end_s", "words")
    clips = pieces.timed_pieces(clips, ["tbl", "row_key"], timed.max_size, timed.overlap)
    paras = pieces.text_pieces(keyed(spark, sf_dir, "paragraphs", "text"), ["tbl", "row_key"], int(text.max_size), int(text.overlap))
    return clips.unionByName(paras).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip candidates and paragraphs that exceed their limit: those that come out in pieces."""
    return p4_pieces(spark, sf_dir).where("piece_no = 0").select("tbl", "row_key").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that open a speaker's turn."""
    return turns.openings(read(spark, sf_dir, "segments"), read(spark, sf_dir, "turns"))


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All speech in order: turn, speaker and clean text of every spoken segment."""
    said = turns.with_turns(read(spark, sf_dir, "segments"), read(spark, sf_dir, "turns"))
    return turns.numbered(said).select("source_id", "turn_no", "pos", "speaker", "start_s", "end_s", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources that must stay together."""
    return splits.together(splits.components(read(spark, sf_dir, "clips"), read(spark, sf_dir, "sources")))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every clip."""
    clips = read(spark, sf_dir, "clips")
    return splits.dealt(splits.components(clips, read(spark, sf_dir, "sources")), clips, read(spark, sf_dir, "split_plan"))


def p6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest of sources: every edge that Boruvka's rounds chose."""
    return splits.grown(read(spark, sf_dir, "clips"), read(spark, sf_dir, "sources"))[1]


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every source, by its least source and its size."""
    labels = splits.components(read(spark, sf_dir, "clips"), read(spark, sf_dir, "sources"))
    least = labels.groupBy("root").agg(F.min("vertex").alias("least"), F.count("*").alias("n"))
    return labels.join(least, "root").select(F.col("vertex").alias("source_id"), "least", "n")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all clips that each split got."""
    return splits.shares(p6_splits(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_words": p1_words, "p3_found": p3_found, "p3_stretches": p3_stretches, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_turns": p5_turns, "p6_found": p6_found, "p6_splits": p6_splits, "p6_forest": p6_forest, "p6_members": p6_members, "p6_shares": p6_shares, "p7_found": p7_found, "p7_shares": p7_shares, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}

# Classes of characters for the SQL.
_WIDE = "\\x{FF01}-\\x{FF5E}\\x{FF61}-\\x{FFDC}\\x{FFE0}-\\x{FFE6}\\x{1D400}-\\x{1D7FF}"
_UNSEEN = "\\x{AD}\\x{34F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FE00}-\\x{FE0F}\\x{FEFF}"
_SPACES = "\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_SOLID = "[^ \\t-\\r" + _SPACES + "]*"
_LATIN, _OTHER = "[A-Za-z\\x{C0}-\\x{24F}]", "[\\x{370}-\\x{3FF}\\x{400}-\\x{52F}]"
_FULL = "".join(chr(n) for n in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _FULL)
_LOOKS, _LOOK = "аесорхуіһјѕАВСЕНІКМОРТХУοινυρΑΒΕΗΙΚΜΝΟΡΤΥΧΖ", "aecopxyihjsABCEHIKMOPTXYoivupABEHIKMNOPTYXZ"

_TIED = f"""
WITH n AS (SELECT DISTINCT source_id, trim(replace(regexp_replace(translate(regexp_replace(speaker, '[{_UNSEEN}]', '', 'g'), '{_FULL}{_LOOKS}', '{_NARROW}{_LOOK}'), '[ _{_SPACES}]+', ' ', 'g'), ':', '')) AS s FROM clips WHERE speaker IS NOT NULL AND source_id IS NOT NULL),
p AS (SELECT source_id, lower(CASE WHEN contains(s, ',') THEN trim(split_part(s, ',', 2)) || ' ' || trim(split_part(s, ',', 1)) ELSE s END) AS s FROM n),
k AS (SELECT source_id, 'p:' || s AS tie FROM p WHERE s NOT IN ('', 'host', 'guest', 'unknown') AND NOT regexp_matches(s, '^(speaker|spk) ?[0-9]+$')
  UNION SELECT source_id, 'v:' || CASE WHEN trim(coalesce(video_id, '')) <> '' THEN trim(video_id) ELSE regexp_extract(source, '(?:[?&]v=|/)([A-Za-z0-9_-]{{11}})(?:[&?#]|$)', 1) END FROM sources),
e AS (SELECT DISTINCT a.source_id AS a, b.source_id AS b FROM k a JOIN k b USING (tie) WHERE tie <> 'v:' AND a.source_id <> b.source_id),
r AS (WITH RECURSIVE w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT * FROM w)"""

SQL: dict[str, str] = {
    "p1_found": f"""
WITH t AS (SELECT 'words' AS tbl, source_id || ':' || pos AS row_key, text FROM words UNION ALL SELECT 'clips', id, text FROM clips),
e AS (SELECT tbl, row_key, regexp_replace(text, '([\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}])[\\x{{200D}}\\x{{FE0F}}]+', '\\1', 'g') AS x FROM t)
SELECT DISTINCT tbl, row_key FROM e
WHERE regexp_matches(x, '[{_WIDE}{_UNSEEN}{_SPACES}\\x{{300}}-\\x{{36F}}\\x{{FB00}}-\\x{{FB06}}]') OR regexp_matches(x, '{_LATIN}{_SOLID}{_OTHER}|{_OTHER}{_SOLID}{_LATIN}')""",
    "p6_found": _TIED + " SELECT DISTINCT a AS source_a, b AS source_b FROM r WHERE a < b",
    "p6_members": _TIED + """, v AS (SELECT source_id FROM clips WHERE source_id IS NOT NULL UNION SELECT source_id FROM sources WHERE source_id IS NOT NULL),
m AS (SELECT v.source_id, least(v.source_id, coalesce(min(b), v.source_id)) AS least FROM v LEFT JOIN r ON r.a = v.source_id GROUP BY v.source_id)
SELECT source_id, least, count(*) OVER (PARTITION BY least) AS n FROM m""",
    "p7_found": f"""
WITH t AS (SELECT 'documents' AS tbl, CAST(doc_id AS VARCHAR) AS row_key, text FROM documents UNION SELECT 'clips', id, text FROM clips UNION SELECT 'segments', source_id || ':' || pos, text FROM segments),
s AS (SELECT tbl, row_key, list_filter(regexp_split_to_array(lower(translate(text, '{_FULL}', '{_NARROW}')), '[ \\t-\\r{_SPACES}]+'), lambda x: NOT regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]*[0-9]{{1,3}}:[0-9]{{2}}(:[0-9]{{2}})?([.,][0-9]{{1,3}})?[^\\p{{L}}\\p{{N}}]*$')) AS raw FROM t),
w AS (SELECT tbl, row_key, list_filter(list_transform(raw, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> '') AS ws FROM s),
g AS (SELECT tbl, row_key, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 10),
q AS (SELECT tbl, row_key, len(ws) AS n, i, row_number() OVER (PARTITION BY tbl, row_key, ws[i:i + 4] ORDER BY i) AS k FROM g),
c AS (SELECT tbl, row_key, n, count(DISTINCT i + o) AS again FROM q, (SELECT unnest(range(5)) AS o) WHERE k > 1 GROUP BY tbl, row_key, n)
SELECT tbl, row_key FROM c WHERE 2 * again >= n""",
    "p4_found": """
WITH c AS (
  SELECT ref, start_s AS s, end_s AS e, list_filter(words, lambda w: isfinite(w.start_s) AND isfinite(w.end_s) AND w.end_s >= w.start_s) AS ws FROM clip_candidates),
d AS (
  SELECT ref, CASE WHEN isfinite(s) AND isfinite(e) THEN round((e - s) * 1000)
    ELSE round((list_max(list_transform(ws, lambda w: w.end_s)) - list_min(list_transform(ws, lambda w: w.start_s))) * 1000) END AS ms FROM c)
SELECT DISTINCT 'clip_candidates' AS tbl, ref AS row_key FROM d WHERE ms > (SELECT max_size * 1000 FROM size_limits WHERE tbl = 'clip_candidates')
UNION ALL
SELECT DISTINCT 'paragraphs', source_id || ':' || para_no FROM paragraphs
WHERE len(list_filter(regexp_split_to_array(text, '[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '')) > (SELECT max_size FROM size_limits WHERE tbl = 'paragraphs')""",
}

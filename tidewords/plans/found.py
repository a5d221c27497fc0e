"""The queries of the general problems on timed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.operators import intervals
from tidewords.session import read

SEP = "\t"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(tbl: str) -> DataFrame:
        return intervals.spans(read(spark, sf_dir, tbl), F.concat(F.lit(tbl + SEP), F.col("source_id")))

    return one("words").unionByName(one("turns"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.split_part("key", F.lit(SEP), F.lit(1)).alias("tbl"), F.expr("substr(key, instr(key, '\t') + 1)").alias("source_id"), *[c for c in df.columns if c != "key"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of 2,000 to 600,000 ms between the merged periods of each source, in words and in turns."""
    return _named(intervals.gaps(_keyed(spark, sf_dir), least_ms=2_000, most_ms=600_000))


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merged periods of each source, in words and in turns."""
    return _named(intervals.periods(_keyed(spark, sf_dir)))


_SPANS = """
WITH raw AS (
  SELECT 'words' AS tbl, source_id, start_s, end_s FROM words
  UNION ALL SELECT 'turns', source_id, start_s, end_s FROM turns),
s AS (
  SELECT tbl, source_id, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b
  FROM raw WHERE source_id IS NOT NULL AND isfinite(start_s) AND isfinite(end_s) AND start_s <= end_s),
m AS (
  SELECT *, max(b) OVER (PARTITION BY tbl, source_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
"""

SQL = {
    "p2_found": _SPANS + """
SELECT tbl, source_id, reach AS gap_start_ms, a AS gap_end_ms FROM m WHERE a - reach BETWEEN 2000 AND 600000""",
    "p2_periods": _SPANS + """,
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tbl, source_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS no FROM m)
SELECT tbl, source_id, min(a) AS start_ms, max(b) AS end_ms FROM n GROUP BY tbl, source_id, no""",
}

QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods}

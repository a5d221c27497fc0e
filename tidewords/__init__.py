"""Timed-text analytics on Spark: captions, word timings, speaker turns and clips as DataFrames."""

__version__ = "0.1.0"

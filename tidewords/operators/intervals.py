"""Overlapping and gapped intervals: covered periods and the gaps between them, per key.

Method: a sweep line. Every interval becomes a plus event at its start and a minus event at its
end; the prefix sum of the events in time order is the number of open intervals; where it is zero
a gap begins, which the next event ends.

Scale. A key may hold a third of all rows, so no task ever gets a whole key:

1. Each input task sweeps its own rows first and sends on only the covered periods it found. This
   is a map-side combine: a union of intervals is associative. Gaps that are shorter than
   ``bridge_ms`` in one task's rows can only be shorter among all rows, so they are closed at once;
   that loses no gap of ``bridge_ms`` or more.
2. Events are shuffled by (key, time block) and swept inside the block.
3. One row per block and key, the block's net sum and first event, goes through a second prefix sum
   that gives every block the count it starts with. That window is over blocks, not events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.session import settle

#: Milliseconds in a time block.
BLOCK_MS = 3_600_000


def to_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, rounded half away from zero; null for null, NaN and infinity."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e12))
    return F.when(finite, F.round(seconds * 1000).cast("long"))


def spans(df: DataFrame, key: Column, start_s: str = "start_s", end_s: str = "end_s") -> DataFrame:
    """``key, start_ms, end_ms`` of the rows with two finite times in order; others count for nothing.
    A span of no length (start = end) is a period and does count."""
    good = df.where(key.isNotNull() & to_ms(F.col(start_s)).isNotNull() & to_ms(F.col(end_s)).isNotNull() & (F.col(end_s) >= F.col(start_s)))
    return good.select(key.alias("key"), to_ms(F.col(start_s)).alias("start_ms"), to_ms(F.col(end_s)).alias("end_ms"))


def sweep(group: np.ndarray, start: np.ndarray, end: np.ndarray, bridge_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered periods of rows in memory: plus and minus events, prefix sum, periods between zeros."""
    g = np.concatenate([group, group])
    t = np.concatenate([start, end + max(0, bridge_ms - 1)])
    delta = np.concatenate([np.ones(len(start), np.int64), -np.ones(len(end), np.int64)])
    order = np.lexsort((-delta, t, g))  # a start at the very moment of an end touches it
    g, t, active = g[order], t[order], np.cumsum(delta[order])
    closes = np.flatnonzero(active == 0)
    opens = np.concatenate([[0], closes[:-1] + 1]) if len(closes) else closes
    return g[opens], t[opens], t[closes] - max(0, bridge_ms - 1)


def _local(bridge_ms: int, at_least: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            enc = table.column("key").combine_chunks().dictionary_encode()
            enc = enc.chunk(0) if isinstance(enc, pa.ChunkedArray) else enc
            g, a, b = sweep(enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), table.column("start_ms").to_numpy(), table.column("end_ms").to_numpy(), bridge_ms)
            return pa.RecordBatch.from_arrays([enc.dictionary.take(pa.array(g)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "start_ms", "end_ms"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= at_least:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _events(periods: DataFrame, block_ms: int) -> DataFrame:
    """Net change of the number of open intervals at each moment, with its block; in one shuffle, by key and block."""
    both = F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d"))))
    e = periods.select("key", both.alias("e")).select("key", F.floor(F.col("e.t") / block_ms).alias("block"), F.col("e.t").alias("t"), F.col("e.d").alias("d"))
    return e.repartition("key", "block").groupBy("key", "block", "t").agg(F.sum("d").alias("d"))


def _swept(df: DataFrame, bridge_ms: int, block_ms: int) -> tuple[DataFrame, DataFrame]:
    """Events in time order with their block, the count after each (``active``) and the time of the next (``next_t``); and the
    periods that input tasks found."""
    # A minus event moved on by bridge_ms - 1 would join periods here too, but the gaps are measured between true ends.
    # written once, as the events and the blocks both come from it and the input is far larger
    local = settle(df.mapInArrow(_local(bridge_ms), "key string, start_ms bigint, end_ms bigint"), "periods")
    inside = Window.partitionBy("key", "block").orderBy("t")
    events = _events(local, block_ms).select("*", F.sum("d").over(inside).alias("run"), F.lead("t").over(inside).alias("after"))
    blocks = events.groupBy("key", "block").agg(F.sum("d").alias("net"), F.min("t").alias("first_t"))
    over = Window.partitionBy("key").orderBy("block")
    blocks = blocks.select("key", "block", F.coalesce(F.sum("net").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("open"), F.lead("first_t").over(over).alias("later"))
    return events.join(blocks, ["key", "block"]).select("key", "block", "t", "d", (F.col("run") + F.col("open")).alias("active"), F.coalesce("after", "later").alias("next_t")), local


def gaps(df: DataFrame, *, least_ms: int = 1, most_ms: int | None = None, block_ms: int = BLOCK_MS) -> DataFrame:
    """``key, gap_start_ms, gap_end_ms`` of the gaps between consecutive merged periods.

    df: ``key, start_ms, end_ms`` with start_ms <= end_ms, as :func:`spans` gives them; other columns
    are ignored. Null keys or times count for nothing, repeated rows change nothing, touching periods
    are one, an empty table has no gaps. Only gaps of least_ms to most_ms, both included, come out.
    """
    df = df.select("key", "start_ms", "end_ms").where("key is not null and start_ms <= end_ms")
    out = _swept(df, max(1, least_ms), block_ms)[0].where((F.col("active") == 0) & F.col("next_t").isNotNull())
    length = F.col("next_t") - F.col("t")
    out = out.where(length >= max(1, least_ms)) if most_ms is None else out.where(length.between(max(1, least_ms), most_ms))
    return out.select("key", F.col("t").alias("gap_start_ms"), F.col("next_t").alias("gap_end_ms"))


def periods(df: DataFrame, *, block_ms: int = BLOCK_MS) -> DataFrame:
    """``key, start_ms, end_ms`` of the merged periods: what the gaps leave. Arguments as in :func:`gaps`.

    A period ends where the count falls to zero; it began at the end of the gap before it, which is
    the last earlier event that left zero. That event may be any number of blocks back, so the last
    zero of each block is carried in the rows of blocks.
    """
    df = df.select("key", "start_ms", "end_ms").where("key is not null and start_ms <= end_ms")
    swept, local = _swept(df, 1, block_ms)
    zeros = swept.where("active = 0").select("key", "block", "t", "next_t")
    inside = Window.partitionBy("key", "block").orderBy("t")
    here = zeros.select("*", F.lag("next_t").over(inside).alias("began"))
    over = Window.partitionBy("key").orderBy("block")
    first = local.groupBy("key").agg(F.min("start_ms").alias("first_ms"))
    # the key's first moment goes into the rows of blocks, so that no row of events meets its whole key
    last = zeros.groupBy("key", "block").agg(F.max("next_t").alias("last_next"))
    last = last.select("key", "block", F.lag("last_next").over(over).alias("carried")).join(first, "key")
    return here.join(last, ["key", "block"]).select("key", F.coalesce("began", "carried", "first_ms").alias("start_ms"), F.col("t").alias("end_ms"))

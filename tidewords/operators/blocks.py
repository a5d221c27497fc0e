"""Windows over long sequences in two levels, so that no task gets a whole key.

A sequence is ``keys`` in the order of one numeric column. It is cut into blocks of that column; rows
meet their neighbours inside a block, and what crosses a block's edge comes from one row per block.
A source with a third of all rows is spread over its blocks like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewords.session import settle

#: Positions in a block.
SIZE = 4_096
BLOCK = _BLOCK = "__block"


def with_block(df: DataFrame, order: str, size: int = SIZE) -> DataFrame:
    """``df`` with its block; a frame that has one already, from :func:`latest` or another step here, keeps its partitioning."""
    return df if _BLOCK in df.columns else df.withColumn(_BLOCK, F.floor(F.col(order) / size))


def latest(df: DataFrame, keys: list[str], order: str, by: str | None, *, size: int = SIZE) -> DataFrame:
    """One row per keys and ``order``: the one that landed last by column ``by``, of equals the greatest; with its block, by which the
    rows are shuffled and sorted, once for all steps here that follow with ``keep``."""
    rest = ([by] if by else []) + [c for c in df.columns if c not in (*keys, order, by)]
    df = with_block(df, order, size).repartition(*keys, _BLOCK)
    over = Window.partitionBy(*keys, _BLOCK, order).orderBy(*[F.col(c).desc_nulls_last() for c in rest])
    return df.withColumn("__r", F.row_number().over(over)).where("__r = 1").drop("__r")


def neighbours(df: DataFrame, keys: list[str], order: str, cols: list[str], *, size: int = SIZE, keep: bool = False) -> DataFrame:
    """``df`` with structs ``prev`` and ``next``: ``cols`` of the row before and after; null at the ends.

    ``order`` must be unique within keys; values may have holes of any width. With ``keep`` the block stays for a next step.
    """
    df = with_block(df, order, size)
    what = F.struct(*cols)
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    over = Window.partitionBy(*keys).orderBy(_BLOCK)
    edges = df.groupBy(*keys, _BLOCK).agg(F.min_by(what, order).alias("first"), F.max_by(what, order).alias("last"))
    edges = edges.select(*keys, _BLOCK, F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    df = df.select("*", F.lag(what).over(inside).alias("prev"), F.lead(what).over(inside).alias("next")).join(edges, [*keys, _BLOCK])
    return df.withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after")).drop("before", "after", *([] if keep else [_BLOCK]))


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, *, size: int = SIZE, highest: bool = False, keep: bool = False) -> DataFrame:
    """``df`` with ``name``, the sum (or with ``highest`` the maximum) of ``value`` over the rows up to and with this one."""
    agg = F.max if highest else F.sum
    df = with_block(df, order, size).withColumn(name, value)
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = agg("__s").over(before)
    sums = df.groupBy(*keys, _BLOCK).agg(agg(name).alias("__s")).select(*keys, _BLOCK, (carried if highest else F.coalesce(carried, F.lit(0))).alias("__carried"))
    df = df.withColumn(name, agg(name).over(inside)).join(sums, [*keys, _BLOCK])
    whole = F.greatest(name, "__carried") if highest else F.col(name) + F.col("__carried")
    return df.withColumn(name, whole).drop("__carried", *([] if keep else [_BLOCK]))


def numbered(df: DataFrame, keys: list[str], order: str, name: str, *, size: int = SIZE) -> DataFrame:
    """``df`` with ``name``, the row's number from 1 in order."""
    return running(df, keys, order, F.lit(1).cast("bigint"), name, size=size)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the row's number from 1 in the order of any columns.

    The rows are parted by range of keys and order, so a hot key lies in several partitions; the partitions, in order,
    are the blocks, and are written so that a task that runs again finds the same ones.
    """
    df = settle(df.repartitionByRange(*keys, *order).withColumn(_BLOCK, F.spark_partition_id()), "ranked")
    over = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, _BLOCK).agg(F.count("*").alias("__m")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(_BLOCK).alias("__b"), F.coalesce(F.sum("__m").over(over), F.lit(0)).alias("__start"))
    at = F.row_number().over(Window.partitionBy(*keys, _BLOCK).orderBy(*order))
    same = F.col(_BLOCK) == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = df.withColumn(name, at).join(counts, same).withColumn(name, F.col(name) + F.col("__start"))
    return out.drop("__b", "__start", _BLOCK, *[f"__{k}" for k in keys])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted batches as tables of whole groups, with the row each group begins at. Only the group at a batch's end is held."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None

    def made() -> tuple[pa.Table, list[int]]:
        table = pa.Table.from_batches(held)
        key = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
        return table, [i for i in range(len(key)) if not i or key[i] != key[i - 1]]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)  # noqa: E731, B023
        last = at(n - 1)
        if held and at(0) == last == held_key:
            held.append(batch)
            continue
        low, high = 0, n - 1  # where the last group begins
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if at(mid) == last else (mid + 1, high)
        if low:
            held.append(batch.slice(0, low))
        if held:
            yield made()
        held, held_key = [batch.slice(low)], last
    if held:
        yield made()


def fold(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """One pass of Python over each group's rows in order.

    ``fn`` gets a group's columns as lists and returns those of ``schema``. Groups come one after another
    out of a sorted partition, many to an Arrow batch; only the group at a batch's end is held.
    For groups that are bounded by what they are (a run without a pause, the last two pieces of a source).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            cols = table.to_pydict()
            out: dict[str, list] = {}
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                for c, v in fn({c: v[a:b] for c, v in cols.items()}).items():
                    out.setdefault(c, []).extend(v)
            yield pa.RecordBatch.from_pydict({f.name: out.get(f.name, []) for f in target}, schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: Copies of a looked-up table that rows of one key are spread over.
SALTS = 32


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], how: str = "left", *, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table``, which has few rows for each of ``keys``, such as one per source: the rows of a key are spread
    over ``salts`` by a hash of ``spread`` and the table is copied to each, so that a hot key's rows meet it in several tasks."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int").alias("__salt")
    copies = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    return rows.select("*", salt).join(copies, [*keys, "__salt"], how).drop("__salt")


#: Rows of a group that :func:`along` holds before it works off what it can.
HOLD = 100_000


def along(df: DataFrame, keys: list[str], order: list[str], numbers: list[str], fn: Callable[[dict[str, np.ndarray], bool], np.ndarray], name: str) -> DataFrame:
    """``df`` with ``name BIGINT``, which ``fn`` makes of the ``numbers`` of each group in order, arrays without nulls; one value a row.

    As :func:`fold`, but the rows go along, so nothing has to be joined back to them; and of a group of more than HOLD rows not
    all are held: ``fn`` then gets those at hand and false, gives values of as many leading rows as no later row can change,
    and sees the others again with more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        open_key: tuple | None = None
        most = HOLD

        def work(table: pa.Table, whole: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            key = [table.column(k).to_pylist() for k in keys]
            starts = [i for i in range(table.num_rows) if not i or any(c[i] != c[i - 1] for c in key)]
            cols = {c: table.column(c).to_numpy() for c in numbers}
            made = [fn({c: v[a:b] for c, v in cols.items()}, whole) for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True)]
            values = np.concatenate(made) if made else np.zeros(0, np.int64)
            done = table.slice(0, len(values))
            return done.append_column(name, pa.array(values, pa.int64())).to_batches(), table.slice(len(values))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)  # noqa: E731, B023
            last, low, high = at(n - 1), 0, n - 1
            while low < high:  # where the batch's last group begins
                mid = (low + high) // 2
                low, high = (low, mid) if at(mid) == last else (mid + 1, high)
            if not low and last == open_key:
                held.append(batch)
                if sum(b.num_rows for b in held) >= most:
                    out, rest = work(pa.Table.from_batches(held), False)
                    yield from out
                    held, most = rest.to_batches(), max(HOLD, 2 * rest.num_rows)
                continue
            if low:
                held.append(batch.slice(0, low))
            if held:
                yield from work(pa.Table.from_batches(held), True)[0]
            held, open_key, most = [batch.slice(low)], last, HOLD
        if held:
            yield from work(pa.Table.from_batches(held), True)[0]

    schema = StructType([*df.schema.fields, StructField(name, LongType())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

"""Several sources as one dataset: unique names, totals, the language they agree on, reuse of what is built."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewords.errors import SourceError
from tidewords.operators import blocks


def unique_names(df: DataFrame, base: str, order: str, name: str = "unique_name") -> DataFrame:
    """``df`` with ``name``: the base for its first row in ``order``, then ``base-2``, ``base-3`` ...

    Rows of one base are numbered; should a suffixed name be some row's own base, that row keeps it and the
    suffixed one takes the next number free among ``base-n`` of the table. Rows with a null base get null.
    """
    first = blocks.ranked(df, [base], [order], "__n")
    taken = df.where(F.col(base).rlike("-[0-9]+$")).select(F.regexp_extract(base, "^(.*)-[0-9]+$", 1).alias("__of"), F.regexp_extract(base, "-([0-9]+)$", 1).try_cast("bigint").alias("__t")).where(f"__t between 2 and {1 << 60}").distinct()
    # the n-th row takes the n-th number that no base has: the j-th used number moves on all rows from the (t - j + 1)-th
    moves = blocks.ranked(taken, ["__of"], ["__t"], "__j").select("__of", (2 * (F.col("__t") - F.col("__j") + 1)).alias("__at"), F.lit(1).cast("bigint").alias("__u"))
    rows = first.where(F.col(base).isNotNull() & (F.col("__n") > 1)).select(F.col(base).alias("__of"), (2 * F.col("__n").cast("bigint") + 1).alias("__at"), F.lit(0).cast("bigint").alias("__u"))
    moved = blocks.running(moves.unionByName(rows), ["__of"], "__at", F.col("__u"), "__k").where("__u = 0 and __k > 0").select("__of", ((F.col("__at") - 1) / 2).cast("bigint").alias("__m"), "__k")
    out = first.join(moved, (first[base] == moved["__of"]) & (first["__n"] == moved["__m"]), "left")
    number = F.col("__n").cast("bigint") + F.coalesce("__k", F.lit(0))
    return out.withColumn(name, F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), number.cast("string")))).drop("__n", "__of", "__m", "__k")


def clip_numbers(clips: DataFrame, order: str) -> DataFrame:
    """``clips`` with ``clip_id``, ``<source>_NNNN`` without holes, from 1, in ``order`` within each source."""
    out = blocks.numbered(clips, ["source_id"], order, "__n")
    text = F.col("__n").cast("string")
    return out.withColumn("clip_id", F.concat("source_id", F.lit("_"), F.when(F.length(text) >= 4, text).otherwise(F.lpad(text, 4, "0")))).drop("__n")


def totals(clips: DataFrame) -> DataFrame:
    """``source_id, clips, total_ms, oversized`` of each source and, with a null source, of all. Repeated ids count once."""
    one = clips.groupBy("id").agg(F.max(F.struct("source_id", "duration_s", "oversized")).alias("r")).where("id is not null")
    ms = F.round(F.col("r.duration_s") * 1000).cast("bigint")
    one = one.withColumn("source_id", F.col("r.source_id"))
    return one.rollup("source_id").agg(F.count("*").alias("clips"), F.coalesce(F.sum(ms), F.lit(0)).alias("total_ms"), F.count_if(F.coalesce("r.oversized", F.lit(False))).alias("oversized"), F.grouping("source_id").alias("g")).where("g = 1 or source_id is not null").select("source_id", "clips", "total_ms", "oversized")


def outcome(clips: DataFrame, drops: DataFrame, tried: DataFrame) -> DataFrame:
    """``source_id, clips, dropped, ok, error`` of every source tried (source_id, error). clips: source_id; drops: source_id.
    A source is ok if it has no error and any clips; one without either says so."""
    made = clips.groupBy("source_id").agg(F.count("*").alias("clips"))
    lost = drops.groupBy("source_id").agg(F.count("*").alias("dropped"))
    one = tried.groupBy("source_id").agg(F.max("error").alias("error"))
    out = one.join(made, "source_id", "left").join(lost, "source_id", "left").fillna(0, ["clips", "dropped"])
    error = F.coalesce("error", F.when(F.col("clips") == 0, "no clips"))
    return out.select("source_id", "clips", "dropped", error.isNull().alias("ok"), error.alias("error"))


def succeeded(outcomes: DataFrame) -> DataFrame:
    """One row: ``succeeded, failed, clips, dropped`` of :func:`outcome`."""
    return outcomes.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("clips"), F.lit(0)).alias("clips"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))


def language_vote(languages: DataFrame, language: str = "language") -> DataFrame:
    """One row: ``language``, what all agree on, else ``und``; ``votes``, the counts, commonest first. An empty table gives ``und``."""
    counts = languages.where(F.col(language).isNotNull()).groupBy(F.col(language).alias("lang")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang")))
    said = F.transform(ordered, lambda x: F.concat(x["lang"], F.lit(":"), (-x["m"]).cast("string")))
    return counts.agg(F.when(F.count("*") == 1, F.max("lang")).otherwise(F.lit("und")).alias("language"), F.array_join(said, " ").alias("votes"))


def fingerprint(config: object, *, without: tuple[str, ...] = ("token", "formats", "out_dir")) -> str:
    """SHA-1 of a config in canonical JSON; secrets and what changes index files only are left out."""
    plain = asdict(config) if is_dataclass(config) else dict(config)
    return hashlib.sha1(json.dumps({k: v for k, v in plain.items() if k not in without}, sort_keys=True, default=str).encode()).hexdigest()


def reusable(wanted: DataFrame, state: DataFrame, files: DataFrame, mark: str | Column, paths: DataFrame | None = None) -> DataFrame:
    """``source_id`` of the sources that need not be built again: built well under the same fingerprint, every file there.

    state: source_id, fingerprint, ok; paths: source_id, path, a row for each file, else state has paths ARRAY<STRING>; files: path.
    """
    good = state.where((F.col("fingerprint") == (F.lit(mark) if isinstance(mark, str) else mark)) & F.col("ok")).join(wanted.select("source_id").distinct(), "source_id", "left_semi")
    own = good.select("source_id", F.explode("paths").alias("path")) if paths is None else paths.select("source_id", "path").where("path is not null")
    missing = own.join(files.select("path").distinct(), "path", "left_anti").select("source_id").distinct()
    return good.select("source_id").distinct().join(missing, "source_id", "left_anti")


def owner(path: str) -> Column:
    """The source that a clip file, ``<source>_NNNN.wav``, is named after; empty for other files."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(.+)_\d{4}\.wav$", 1)


def orphans(files: DataFrame, clips: DataFrame, sources: DataFrame) -> DataFrame:
    """``path`` of clip files, ``<source>_NNNN.wav`` of a source at hand, that no clip refers to."""
    own = files.select("path", owner("path").alias("source_id")).where("source_id <> ''").join(sources.select("source_id").distinct(), "source_id", "left_semi")
    return own.join(clips.select(F.col("audio_path").alias("path")).where("path is not null").distinct(), "path", "left_anti").select("path").distinct()


def all_ids(*tables: DataFrame) -> DataFrame:
    """``source_id`` of every source that any of the tables has, such as those built now and those of a state."""
    out = tables[0].select("source_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("source_id"))
    return out.where("source_id is not null").distinct()


def clamped_limit(asked: object, *, usual: int = 5, most: int = 25) -> int:
    """A limit that a request asks for: ``usual`` if it is none or no number, else from 1 to ``most``."""
    try:
        n = int(asked or usual)
    except (TypeError, ValueError):
        return usual
    return max(1, min(n, most))


def picked(items: DataFrame, order: str, *, latest: bool = False, number: int | None = None, everything: bool = False, limit: int | None = None) -> DataFrame:
    """Which items of a listing to take: the one with a number from 1, else the first, else all up to a limit, else none. A number that
    no item has, and a limit under 1, are errors."""
    if limit is not None and limit < 1:
        raise SourceError(f"a limit of {limit} takes nothing", "Give 1 or more, or none to take all.")
    if number is not None:
        one = items.orderBy(order).offset(max(0, number - 1)).limit(1)
        if number < 1 or one.isEmpty():
            raise SourceError(f"no item has the number {number}", "Items are numbered from 1.")
        return one
    if latest:
        return items.orderBy(order).limit(1)
    if everything:
        return items if limit is None else items.orderBy(order).limit(limit)
    return items.limit(0)

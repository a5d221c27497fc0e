"""One pass over texts: languages, repetition and reading level of each row, where it lies.

The three operators share the tokens, which are looked up once. Nothing is shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewords.llm import language, level, repetition
from tidewords.llm.tokens import held, per_row


def _samples(labelled: DataFrame, label: str, most: int) -> list[tuple]:
    """Rows ``label, text`` in order, ``most`` at most: as many of each label as there is room for, chosen by hash."""
    rows = labelled.where(f"{label} is not null and text is not null").select(label, "text")
    over = Window.partitionBy(label).orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("__r", F.row_number().over(over)).where(F.col("__r") <= most)
    return sorted((r[0], r[1]) for r in rows.orderBy("__r", label).limit(most).collect())


def language_model(lang_samples: DataFrame, english: DataFrame | None = None) -> language.Model:
    """The field fitted on ``lang_samples (lang, text)`` and further ``english (text)``, language.MOST_SAMPLES texts of each
    at most. Its languages are those of the samples."""
    rows = _samples(lang_samples, "lang", language.MOST_SAMPLES)
    if english is not None:
        rows += _samples(english.select(F.lit("en").alias("lang"), "text"), "lang", language.MOST_SAMPLES)
    return language.fit(rows)


def level_model(level_samples: DataFrame) -> level.Model:
    """The regression fitted on ``level_samples (level, text)``, level.MOST_SAMPLES texts at most."""
    return level.fit(_samples(level_samples, "level", level.MOST_SAMPLES))


def repetition_field(samples: DataFrame) -> repetition.Field:
    """The field of :mod:`repetition`, fitted on texts of ``samples (lang, text)``, language.MOST_SAMPLES at most."""
    return repetition.fit([t for _, t in _samples(samples, "lang", language.MOST_SAMPLES)])


def _list(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(rows.ravel(), kind))


def profiled(df: DataFrame, keep: list[str], text: str = "text", *, lang: language.Model | None = None, grade: level.Model | None = None, repeats: repetition.Field | None = None, label: str | None = None, stretches: bool = False) -> DataFrame:
    """``keep`` columns of df and of each row's text:

    words BIGINT            tokens parted by white space
    forms, again BIGINT     words and repeated words after :mod:`repetition`, boiler DOUBLE, kept and repetitive BOOLEAN
    langs ARRAY<BIGINT>     words by language in the order of the model's; sure ARRAY<DOUBLE> their mean confidence
    levels ARRAY<BIGINT>    words by reading level
    code STRING             two-letter code of the label column, null where it says nothing
    stretches ARRAY<...>    runs of one language: first token, tokens, language, mean confidence

    A null or empty text has zeros and empty lists. What isn't asked for isn't computed: lang, grade
    (needs lang), repeats, label and stretches choose. Other columns of df are dropped; ``keep`` must
    not name a result.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((lang, grade, repeats))
    key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"
    fields = {"words": "bigint"}
    if repeats:
        fields |= {"forms": "bigint", "again": "bigint", "boiler": "double", "kept": "boolean", "repetitive": "boolean"}
    if lang:
        fields |= {"langs": "array<bigint>", "sure": "array<double>"}
    if grade:
        fields |= {"levels": "array<bigint>"}
    if label:
        fields |= {"code": "string"}
    if stretches:
        fields |= {"stretches": "array<struct<first:bigint,size:bigint,lang:string,sure:double>>"}

    def work(texts: list[str | None], batch: pa.RecordBatch) -> list[pa.Array]:
        lm, gm, field = sent.value
        table = held(key, lambda: ({"score": lm.scores, "ends": language.ends_sentence} if lm else {}) | (gm.columns() if gm else {}) | (repetition.columns() if field else {}))
        rows, lens = table.encode(texts)
        out: list[pa.Array] = [pa.array(lens)]
        form = table.column("form")[rows]
        if field:
            words, again, boiler = repetition.measure(field, form, table.column("ends")[rows], table.column("points")[rows], lens)
            out += [pa.array(words), pa.array(again), pa.array(boiler), pa.array(repetition.retained(boiler)), pa.array(repetition.repetitive(words, again, boiler))]
        if lm:
            ends = table.column("ends")
            mark, sure = language.decode(lm, table.column("score"), ends, rows, lens)
            doc = np.repeat(np.arange(len(lens)), lens)
            cells = len(lens) * len(lm.langs)
            cell = doc * len(lm.langs) + mark
            count = np.bincount(cell, minlength=cells).reshape(len(lens), -1)
            mean = np.bincount(cell, sure, minlength=cells).reshape(len(lens), -1) / np.maximum(count, 1)
            out += [_list(count, pa.int64()), _list(mean, pa.float64())]
        if gm:
            by = level.levels(gm, table.column("shape")[rows], ends[rows], form, mark != (lm.langs.index("en") if "en" in lm.langs else -1), lens)
            out.append(_list(by.astype(np.int64), pa.int64()))
        if label:
            code = lru_cache(maxsize=10_000)(language.label_code)
            out.append(pa.array([code(x) for x in batch.column(label).to_pylist()], pa.string()))
        if stretches:
            new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])]) if len(mark) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            size = np.diff([*at, len(mark)])
            conf = np.add.reduceat(sure, at) / size if len(at) else np.zeros(0)
            first = at - (np.cumsum(lens) - lens)[doc[at]] if len(at) else at
            runs = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(np.array(lm.langs, object)[mark[at]], pa.string()), pa.array(conf, pa.float64())], ["first", "size", "lang", "sure"])
            ends_at = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(lens)))])
            out.append(pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), runs))
        return out

    cols = list(dict.fromkeys([*keep, text, *([label] if label else [])]))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{k} {v}" for k, v in fields.items())])
    return df.select(*cols).mapInArrow(per_row(keep, text, list(fields), work), schema)


def large(langs: Column, names: tuple[str, ...], share: float = 0.2) -> Column:
    """Array of the languages, as structs of name and words, that make up at least ``share`` of the words."""
    total = F.aggregate(langs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    named = F.zip_with(F.array(*[F.lit(x) for x in names]), langs, lambda name, n: F.struct(name.alias("lang"), n.alias("n")))
    return F.filter(named, lambda x: (x["n"] > 0) & (x["n"] >= share * total))


def by_source(paragraphs: DataFrame, lang: language.Model) -> DataFrame:
    """``source_id, langs``: words by language of all paragraphs of each source, repeated rows counted once.

    The texts stay; only counts are shuffled, summed before, so that a hot source costs no more than others.
    """
    counts = profiled(paragraphs, ["source_id", "para_no"], lang=lang)
    counts = counts.groupBy("source_id", "para_no").agg(F.max(F.struct("words", "langs", "sure")).alias("r"))
    sums = [F.sum(F.col("r.langs")[i]).alias(f"n{i}") for i in range(len(lang.langs))]
    return counts.groupBy("source_id").agg(*sums).select("source_id", F.array(*[F.col(f"n{i}") for i in range(len(lang.langs))]).alias("langs"))


def level_of(levels: Column, scale: list[int]) -> Column:
    """The level that most words stand in, the lower of equals; null where no words count."""
    top = F.array_max(levels)
    return F.when(top > 0, F.element_at(F.array(*[F.lit(x) for x in scale]), F.array_position(levels, top).cast("int")))


def models(spark: SparkSession, read, *, grade: bool = False) -> tuple[language.Model, level.Model | None, repetition.Field]:
    """The models from the sample tables; ``read`` gives a table by name."""
    graded = read("level_samples")
    rows = _samples(read("lang_samples"), "lang", language.MOST_SAMPLES)
    english = _samples(graded.select(F.lit("en").alias("lang"), "text"), "lang", language.MOST_SAMPLES)
    return language.fit(rows + english), level_model(graded) if grade else None, repetition.fit([t for _, t in rows])

"""Raw text -> typed rows, with bad lines set aside instead of lost.

JSON and tab-separated lines go through the same two steps in batch and streaming:
parse once, then ``good`` / ``bad`` are two filters over the same parsed column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from lectern.functions import scalars as S
from lectern.sources.specs import (
    LEARN_INTS, LEARN_LONGS, LEARN_TEXTS, LogSpec, PAGE_FIELDS, QUESTION_FIELDS, REGISTER_FIELDS)

CORRUPT = "_corrupt_record"
PARSED = "_parsed"


def parse_json(lines: DataFrame, schema: T.StructType, line: str = "value") -> DataFrame:
    """Add one text column per member, in the struct :data:`PARSED`.

    Members are text so that quoted and bare numbers both survive. The parse is the input of a generator,
    which Spark neither duplicates nor moves filters through: every line is parsed once, whatever reads it.
    """
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(line), with_corrupt, {"columnNameOfCorruptRecord": CORRUPT})
    return lines.withColumn(PARSED, F.explode(F.array(parsed)))


def is_object() -> Column:
    """True for lines that are one JSON object (not an array, a scalar, ``null`` or broken text)."""
    return F.col(PARSED).isNotNull() & F.col(f"{PARSED}.{CORRUPT}").isNull()


def split_json(lines: DataFrame, schema: T.StructType, line: str = "value",
               observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: good rows keep the parsed struct, bad rows the raw line.

    ``observation`` receives the number of bad lines as ``bad`` when the good rows are computed.
    """
    parsed = parse_json(lines, schema, line)
    watched = parsed.observe(observation, F.count_if(~is_object()).alias("bad")) if observation else parsed
    return watched.where(is_object()), parsed.where(~is_object()).select(F.col(line).alias("line"))


def clean_json(lines: DataFrame, spec: LogSpec, on_bad: str = "quarantine", line: str = "value",
               observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows of ``spec`` and the quarantined lines.

    ``on_bad="fail"`` raises inside the job at the first malformed line.
    """
    good, bad = split_json(lines, spec.json_schema, line, observation)
    if on_bad == "fail":
        good = parse_json(lines, spec.json_schema, line).withColumn(
            PARSED, F.when(is_object(), F.col(PARSED)).otherwise(
                F.raise_error(F.concat(F.lit(f"{spec.file}: not a JSON object: "), F.col(line)))))
        if observation:
            good = good.observe(observation, F.count_if(~is_object()).alias("bad"))
    return good.select(*[field.read(PARSED) for field in spec.fields]), bad


def ingest_json(spark: SparkSession, path: str | list[str], spec: LogSpec,
                on_bad: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """:func:`clean_json` of text files."""
    return clean_json(spark.read.text(path), spec, on_bad)


def _fields(lines: DataFrame, line: str) -> DataFrame:
    """Add the array of tab-separated fields, split once; trailing empty fields are dropped."""
    parts = F.split(F.regexp_replace(F.col(line), r"\t+$", ""), r"\t")
    return lines.withColumn(PARSED, F.explode(F.array(parts)))


def split_tsv(lines: DataFrame, names: Iterable[str], line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows with exactly the named fields, and the lines of any other arity.

    Trailing empty fields do not count towards the arity.
    """
    names = list(names)
    keep = [c for c in lines.columns if c != line]
    parsed = _fields(lines, line)
    fits = F.coalesce(F.size(PARSED) == len(names), F.lit(False))
    good = parsed.where(fits).select(*keep, *[F.get(F.col(PARSED), F.lit(i)).alias(n) for i, n in enumerate(names)])
    return good, parsed.where(~fits).select(F.col(line).alias("line"))


def register_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registration log ``(rows, bad)``: platform code decoded to its name."""
    good, bad = split_tsv(lines, REGISTER_FIELDS)
    return good.withColumn("platform", S.platform_name(F.col("platform"))), bad


def question_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answer log ``(rows, bad)``; lines of another arity or with ids that are no numbers are bad."""
    ids = QUESTION_FIELDS[:4]
    typed = _fields(lines, "value").select("value", F.size(PARSED).alias("_n"), *[
        (F.get(F.col(PARSED), F.lit(i)).try_cast("int") if n in ids else F.get(F.col(PARSED), F.lit(i))).alias(n)
        for i, n in enumerate(QUESTION_FIELDS)])
    ok = F.col("_n") == len(QUESTION_FIELDS)
    for name in ids:
        ok = ok & F.col(name).isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return typed.where(ok).drop("value", "_n"), typed.where(~ok).select(F.col("value").alias("line"))


def flagged_pages(lines: DataFrame) -> DataFrame:
    """Every line with its page event (an absent field is the empty text) and ``ok``, whether it could be read."""
    parsed = parse_json(lines, T.StructType([T.StructField(n, T.StringType()) for n in PAGE_FIELDS]))
    return parsed.select("value", is_object().alias("ok"),
                         *[F.coalesce(F.col(f"{PARSED}.{n}"), F.lit("")).alias(n) for n in PAGE_FIELDS])


def page_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page events ``(rows, bad)``."""
    flagged = flagged_pages(lines)
    return (flagged.where("ok").select(*PAGE_FIELDS),
            flagged.where(~F.coalesce("ok", F.lit(False))).select(F.col("value").alias("line")))


def flagged_plays(lines: DataFrame) -> DataFrame:
    """Every line with its play, its ``seconds`` and ``ok``. Plays that end before they start, or lack a time stamp, are not."""
    names = LEARN_INTS + LEARN_LONGS + LEARN_TEXTS
    parsed = parse_json(lines, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    typed = parsed.select(
        F.col("value"), is_object().alias("_ok"),
        *[S.int_or_zero(F.col(f"{PARSED}.{n}")).alias(n) for n in LEARN_INTS],
        *[S.bigint_or_null(F.col(f"{PARSED}.{n}")).alias(n) for n in LEARN_LONGS],
        F.col(f"{PARSED}.sourceType").alias("sourcetype"))
    ok = F.coalesce(F.col("_ok") & (F.col("pe") >= F.col("ps")) & F.col("ts").isNotNull() & F.col("te").isNotNull(),
                    F.lit(False))
    return typed.withColumn("ok", ok).drop("_ok").withColumn("seconds", S.elapsed_seconds(F.col("ts"), F.col("te")))


def learn_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(plays, bad)``."""
    flagged = flagged_plays(lines)
    return flagged.where("ok").drop("value", "ok"), flagged.where("NOT ok").select(F.col("value").alias("line"))

"""Counts over activity logs: sliding windows, page funnel, question mastery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import scalars as S


def _seconds(interval: str) -> int:
    amount, unit = interval.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def sliding_count(rows: DataFrame, ts: str, key: str, length: str = "60 seconds", slide: str = "6 seconds",
                  name: str = "num", watermark: str | None = None, closed: bool = False) -> DataFrame:
    """Rows per key in windows of ``length`` that start every ``slide``.

    In batch, rows are first counted per slide-wide pane and only panes are spread over the windows
    they belong to; the rows themselves are never multiplied. On a stream one windowed aggregation
    does the work, with ``watermark`` bounding its state.

    ``closed`` windows (append mode) come once, when the watermark has passed their end. Then panes are counted in a first state
    and windows over panes in a second one, and only panes are multiplied. A row is late when its pane has ended by the
    watermark; it is then in no window, also not in those that end later.
    """
    if closed and not (rows.isStreaming and watermark):
        raise ValueError("closed windows need a stream and a watermark")
    if closed and _seconds(length) % _seconds(slide):
        raise ValueError(f"closed windows of {length} cannot be put together from panes of {slide}")
    if closed:
        panes = rows.withWatermark(ts, watermark).groupBy(F.window(ts, slide).alias("_pane"), key).agg(
            F.count(F.lit(1)).alias("_n"))
        windowed = panes.groupBy(F.window(F.window_time("_pane"), length, slide), key).agg(F.sum("_n").alias(name))
        return windowed.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                               key, name)
    if rows.isStreaming:
        if watermark:
            rows = rows.withWatermark(ts, watermark)
        windowed = rows.groupBy(F.window(ts, length, slide), key).agg(F.count(F.lit(1)).alias(name))
        return windowed.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                               key, name)
    span, step = _seconds(length), _seconds(slide)
    if span % step:
        windowed = rows.groupBy(F.window(ts, length, slide), key).agg(F.count(F.lit(1)).alias(name))
        return windowed.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                               key, name)
    pane = (F.floor(F.unix_micros(F.col(ts)) / F.lit(step * 1_000_000)) * step).cast("bigint")
    panes = rows.where(F.col(ts).isNotNull()).groupBy(pane.alias("_pane"), key).agg(F.count(F.lit(1)).alias("_n"))
    starts = F.explode(F.sequence(F.col("_pane") - (span - step), F.col("_pane"), F.lit(step).cast("bigint")))
    return (panes.select(starts.alias("_start"), key, "_n")
            .groupBy("_start", key).agg(F.sum("_n").alias(name))
            .select(F.timestamp_seconds("_start").alias("window_start"),
                    F.timestamp_seconds(F.col("_start") + span).alias("window_end"), key, name))


def running_count(rows: DataFrame, key: str, name: str = "num") -> DataFrame:
    """All-time rows per key; on a stream the running total."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def page_transitions(pages: DataFrame) -> DataFrame:
    return pages.groupBy("last_page_id", "page_id", "next_page_id").agg(F.count(F.lit(1)).alias("num"))


def page_views(pages: DataFrame) -> DataFrame:
    return running_count(pages, "page_id")


def funnel_rates(views: DataFrame, steps: Sequence[str] = ("1", "2", "3"), page: str = "page_id",
                 num: str = "num") -> DataFrame:
    """Views and conversion text of each funnel page against the page before it.

    One row of conditional sums is turned back into one row per step. The first page is ``100%``.
    """
    totals = views.agg(*[
        F.coalesce(F.sum(F.when(F.col(page) == s, F.col(num))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(steps)])
    rows = []
    for i, step in enumerate(steps):
        text: Column = F.lit("100%") if i == 0 else S.percent_text(F.col(f"n{i}"), F.col(f"n{i - 1}"))
        rows.append(F.struct(F.lit(step).alias(page), F.col(f"n{i}").alias(num), text.alias("jump_rate")))
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


POINT_KEYS = ("uid", "courseid", "pointid")


def question_totals(answers: DataFrame, keys: Sequence[str] = POINT_KEYS) -> DataFrame:
    """Attempts, right answers and first time per key and question."""
    return answers.groupBy(*keys, "questionid").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("isright") == "1").alias("rights"),
        F.min("createtime").alias("createtime"))


def question_mastery(answers: DataFrame, questions_per_point: int = S.QUESTIONS_PER_POINT,
                     keys: Sequence[str] = POINT_KEYS) -> DataFrame:
    """Attempts, distinct questions, right answers, correct rate and mastery per user, course and point.

    Two aggregations, the first per question, so neither a key nor a question gathers raw rows.
    """
    totals = question_totals(answers, keys).groupBy(*keys).agg(
        F.sum("attempts").alias("qz_sum"), F.count(F.lit(1)).alias("qz_count"), F.sum("rights").alias("qz_istrue"),
        F.min("createtime").alias("createtime"))
    return totals.select(
        *keys, "qz_sum", "qz_count", "qz_istrue",
        S.correct_rate(F.col("qz_istrue"), F.col("qz_sum")).alias("correct_rate"),
        S.mastery_rate(F.col("qz_count"), F.col("qz_istrue"), F.col("qz_sum"), questions_per_point)
        .alias("mastery_rate"), "createtime")

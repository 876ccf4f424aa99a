"""The five streaming jobs.

Each takes a stream of ``value`` lines (topic or watched directory), an output folder and a checkpoint
folder, and returns the started queries. Checkpoints hold the read positions; results are written per
batch id, so a batch that runs again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import scalars as S
from lectern.operators.activity import funnel_rates, page_transitions, page_views, running_count, sliding_count
from lectern.operators.grouping import sum_by_each, top_overall
from lectern.operators.intervals import fold_plays, video_time_after
from lectern.operators.ranges import count_by_range
from lectern.sinks.tables import ChangeLog, Published, VersionedTable
from lectern.sources.logs import (
    flagged_pages, flagged_plays, learn_records, page_records, question_records, register_records)
from lectern.sources.streams import run_id, start
from lectern.streaming.state import POINT_KEYS, VIDEO_KEYS, question_mastery_stream

#: Learning time is summed by each of these columns of a play.
LEARN_DIMS = ("chapterid", "cwareid", "edutypeid", "sourcetype", "subjectid")


TRANSITION_KEYS = ["last_page_id", "page_id", "next_page_id"]
PAGE_TABLES = ("page_views", "page_jump_rate", "province_clicks", "top_province")

#: Batches after which a change log folds its batch folders into one.
COMPACT_EVERY = 500
#: Folders by key of the watched intervals; a batch reads those its keys are in.
VIDEO_BUCKETS = 32

#: Called with the name of a table and the batch id after each write, for progress reports; what it raises fails the batch.
AfterWrite = Callable[[str, int], None]


def into_log(log: ChangeLog, compact_every: int | None = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """Sink function: one folder per batch, folded together every ``compact_every`` batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            log.compact(batch_id)
    return write


def _changes(df: DataFrame, path: str, keys: list[str], checkpoint: str, compact_every: int | None = COMPACT_EVERY,
             mode: str = "update", **run) -> StreamingQuery:
    log = ChangeLog(df.sparkSession, path, keys, run_id(df.sparkSession, checkpoint))
    return start(df.writeStream.outputMode(mode).foreachBatch(into_log(log, compact_every)), checkpoint, **run)


def register_total(lines: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """All-time registrations per platform."""
    records, _ = register_records(lines)
    return _changes(running_count(records, "platform"), f"{out}/register_total", ["platform"],
                    f"{checkpoint}/register_total", **run)


def register_sliding(lines: DataFrame, out: str, checkpoint: str, *, watermark: str | None,
                     event_time: bool = True, closed: bool = False, **run) -> StreamingQuery:
    """Registrations per platform in 60-second windows every 6 seconds.

    Windows go by the record's own time; ``event_time=False`` uses the processing time. The caller has to choose a
    ``watermark``: with None no record is too late and the state grows with time, with a delay the state is bounded and
    records later than it are left out (:func:`late_rows` counts them). ``closed`` writes a window once, when the watermark has
    passed it, instead of its growing count in every batch; its records are counted per six seconds first. Records whose time cannot be read are in no
    window; :func:`register_job` sets them aside.
    """
    records, _ = register_records(lines)
    ts = F.try_to_timestamp("register_time") if event_time else F.current_timestamp()
    timed = records.withColumn("ts", ts).where(F.col("ts").isNotNull())
    counts = sliding_count(timed, "ts", "platform", watermark=watermark, closed=closed)
    return _changes(counts, f"{out}/register_sliding", ["window_start", "platform"],
                    f"{checkpoint}/register_sliding", mode="append" if closed else "update", **run)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has left out in the batches whose progress the query still holds.

    Spark counts them where they reach the state: rows of one task with the same window and key are one by then.
    """
    return sum(state.get("numRowsDroppedByWatermark", 0) for progress in query.recentProgress
               for state in progress["stateOperators"])


def point_detail(lines: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Question correctness and mastery per user, course and point."""
    records, _ = question_records(lines)
    return _changes(question_mastery_stream(records), f"{out}/point_detail", POINT_KEYS,
                    f"{checkpoint}/point_detail", **run)


def transitions(lines: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Views per last, current and next page."""
    pages, _ = page_records(lines)
    return _changes(page_transitions(pages), f"{out}/page_transitions", TRANSITION_KEYS,
                    f"{checkpoint}/page_transitions", **run)


def funnel(lines: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Views per page and the conversion rates of the funnel pages; one row per page, rewritten per batch."""
    spark = lines.sparkSession
    pages, _ = page_records(lines)
    run_name = run_id(spark, f"{checkpoint}/funnel")
    views_table = VersionedTable(spark, f"{out}/page_views", run=run_name)
    rates_table = VersionedTable(spark, f"{out}/page_jump_rate", run=run_name)

    def write(views: DataFrame, batch_id: int) -> None:
        views_table.commit(views, batch_id)
        rates_table.commit(funnel_rates(views_table.read()), batch_id)

    return start(page_views(pages).writeStream.outputMode("complete").foreachBatch(write),
                 f"{checkpoint}/funnel", **run)


def provinces(lines: DataFrame, ranges: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Clicks per province so far and the top three; addresses in no range count under null.

    A batch is counted per address and then per province, and added to the totals under its batch id: a
    batch that runs again is not added twice.
    """
    spark = lines.sparkSession
    pages, _ = page_records(lines)
    numbered = pages.select(S.ip_number(F.col("ip")).alias("ip_num"))
    located = ranges.withColumn("province", S.region_part(F.col("region")))
    run_name = run_id(spark, f"{checkpoint}/province")
    totals = VersionedTable(spark, f"{out}/province_clicks", run=run_name)
    best = VersionedTable(spark, f"{out}/top_province", run=run_name)

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = count_by_range(batch, "ip_num", located, "start_ip", "end_ip", ["province"])
        totals.merge(counts, batch_id, ["province"], add=["num"])
        best.commit(top_overall(totals.read(), [F.col("num").desc(), F.col("province")], 3), batch_id)

    return start(numbered.writeStream.foreachBatch(write), f"{checkpoint}/province", **run)


def learn_time(lines: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Learning seconds by five keys of a play."""
    plays, _ = learn_records(lines)
    return _changes(sum_by_each(plays, LEARN_DIMS, "seconds", "totaltime"), f"{out}/learn_time", ["dim", "key"],
                    f"{checkpoint}/learn_time", **run)


def video_log(spark: SparkSession, out: str, run: str | None = None) -> ChangeLog:
    """Times and intervals per user and video, as :func:`video_detail` and :func:`learn_job` write them."""
    return ChangeLog(spark, f"{out}/video_detail", VIDEO_KEYS, run, VIDEO_BUCKETS)


def add_plays(log: ChangeLog, plays: DataFrame, batch_id: int) -> None:
    """Carry the watched intervals on by the plays of a batch; what they were before it is read from the log.

    Plays are taken in ``(ps, pe, ts, te)`` order within a batch, so effective time depends on which plays share one; total
    and completed time and the intervals do not.
    """
    folded = fold_plays(plays, VIDEO_KEYS).persist()
    try:
        log.write(video_time_after(folded, log.read(batch_id - 1, touching=folded), VIDEO_KEYS), batch_id)
        _fold(log, batch_id)
    finally:
        folded.unpersist()


def video_detail(lines: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Total, effective and completed seconds and the covered intervals per user and video."""
    spark = lines.sparkSession
    log = video_log(spark, out, run_id(spark, f"{checkpoint}/video_detail"))

    def write(batch: DataFrame, batch_id: int) -> None:
        add_plays(log, learn_records(batch)[0], batch_id)

    return start(lines.writeStream.foreachBatch(write), f"{checkpoint}/video_detail", **run)


def register_job(lines: DataFrame, out: str, checkpoint: str, bad: str | None = None, *, watermark: str | None,
                 **run) -> list[StreamingQuery]:
    """Both registration counts; lines that cannot be read, or whose time cannot, go to ``bad`` when given, as in the
    jobs below. The total counts records of unreadable time, the windows cannot."""
    return [register_total(lines, out, checkpoint, **run),
            register_sliding(lines, out, checkpoint, watermark=watermark, **run),
            *_set_aside(untimed_lines(lines), bad, checkpoint, **run)]


def untimed_lines(lines: DataFrame) -> DataFrame:
    """Registration lines of another arity, or without a readable time."""
    parsed = lines.select("value", F.split(F.regexp_replace("value", r"\t+$", ""), r"\t").alias("_f"))
    readable = (F.size("_f") == 3) & F.try_to_timestamp(F.get("_f", F.lit(2))).isNotNull()
    return parsed.where(~F.coalesce(readable, F.lit(False))).select(F.col("value").alias("line"))


def question_job(lines: DataFrame, out: str, checkpoint: str, bad: str | None = None, **run) -> list[StreamingQuery]:
    return [point_detail(lines, out, checkpoint, **run),
            *_set_aside(question_records(lines)[1], bad, checkpoint, **run)]


def page_job(lines: DataFrame, ranges: DataFrame, out: str, checkpoint: str, bad: str | None = None,
             after_write: AfterWrite = lambda table, batch_id: None, **run) -> list[StreamingQuery]:
    """Transitions, funnel and provinces from one stream that reads and parses each batch once.

    The tables are those of :func:`transitions`, :func:`funnel` and :func:`provinces`; the sums of a batch are added to
    the totals before it, under its batch id. :func:`page_tables` reads them as of the last batch that has reached all.
    """
    spark = lines.sparkSession
    name = run_id(spark, f"{checkpoint}/page")
    moves = ChangeLog(spark, f"{out}/page_transitions", TRANSITION_KEYS, name)
    views, rates, totals, best = (VersionedTable(spark, f"{out}/{table}", run=name) for table in PAGE_TABLES)
    located = ranges.withColumn("province", S.region_part(F.col("region")))
    published = Published(spark, f"{out}/page_job")

    def write(batch: DataFrame, batch_id: int) -> None:
        flagged = flagged_pages(batch).persist()
        try:
            pages = flagged.where("ok")
            moves.add(page_transitions(pages), batch_id, ["num"])
            _fold(moves, batch_id)
            after_write("page_transitions", batch_id)
            views.merge(page_views(pages), batch_id, ["page_id"], add=["num"])
            after_write("page_views", batch_id)
            rates.commit(funnel_rates(views.read()), batch_id)
            after_write("page_jump_rate", batch_id)
            clicks = count_by_range(pages.select(S.ip_number(F.col("ip")).alias("ip_num")), "ip_num", located,
                                    "start_ip", "end_ip", ["province"])
            totals.merge(clicks, batch_id, ["province"], add=["num"])
            after_write("province_clicks", batch_id)
            best.commit(top_overall(totals.read(), [F.col("num").desc(), F.col("province")], 3), batch_id)
            after_write("top_province", batch_id)
            _write_bad(flagged, bad, batch_id)
            published.publish(batch_id)
        finally:
            flagged.unpersist()

    return [start(lines.writeStream.foreachBatch(write), f"{checkpoint}/page", **run)]


def page_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of :func:`page_job`, all as of the same batch; empty before the first one."""
    through = Published(spark, f"{out}/page_job").last()
    if through is None:
        return {}
    return {"page_transitions": ChangeLog(spark, f"{out}/page_transitions", TRANSITION_KEYS).read(through),
            **{name: VersionedTable(spark, f"{out}/{name}").read(through) for name in PAGE_TABLES}}


def learn_job(lines: DataFrame, out: str, checkpoint: str, bad: str | None = None,
              after_write: AfterWrite = lambda table, batch_id: None, **run) -> list[StreamingQuery]:
    """Learning time, watched time and bad lines from one stream that reads and parses each batch once.

    :func:`learn_tables` reads the tables as of the last batch that has reached both.
    """
    spark = lines.sparkSession
    name = run_id(spark, f"{checkpoint}/learn")
    times = ChangeLog(spark, f"{out}/learn_time", ["dim", "key"], name)
    videos = video_log(spark, out, name)
    published = Published(spark, f"{out}/learn_job")

    def write(batch: DataFrame, batch_id: int) -> None:
        flagged = flagged_plays(batch).persist()
        try:
            plays = flagged.where("ok")
            times.add(sum_by_each(plays, LEARN_DIMS, "seconds", "totaltime"), batch_id, ["totaltime"])
            _fold(times, batch_id)
            after_write("learn_time", batch_id)
            add_plays(videos, plays, batch_id)
            after_write("video_detail", batch_id)
            _write_bad(flagged, bad, batch_id)
            published.publish(batch_id)
        finally:
            flagged.unpersist()

    return [start(lines.writeStream.foreachBatch(write), f"{checkpoint}/learn", **run)]


def learn_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of :func:`learn_job`, both as of the same batch; empty before the first one."""
    through = Published(spark, f"{out}/learn_job").last()
    if through is None:
        return {}
    return {"learn_time": ChangeLog(spark, f"{out}/learn_time", ["dim", "key"]).read(through),
            "video_detail": video_log(spark, out).read(through)}


def _fold(log: ChangeLog, batch_id: int) -> None:
    """Every :data:`COMPACT_EVERY` batches, fold all but the last: a replay of that one still finds its totals."""
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        log.compact(batch_id - 1)


def _write_bad(flagged: DataFrame, path: str | None, batch_id: int) -> None:
    if path:
        (flagged.where(~F.coalesce("ok", F.lit(False))).select("value").write.mode("overwrite")
         .text(f"{path.rstrip('/')}/batch={batch_id}"))


def _set_aside(rows: DataFrame, path: str | None, checkpoint: str, **run) -> list[StreamingQuery]:
    return [quarantine(rows, path, checkpoint, **run)] if path else []


def landing(lines: DataFrame, out: str, checkpoint: str, topic: str, **run) -> StreamingQuery:
    """Raw lines as snappy text below ``topic=<topic>/dt=<processing day>``; record keys are dropped."""
    rows = lines.select("value", F.lit(topic).alias("topic"), S.day_of(F.current_timestamp()).alias("dt"))
    writer = (rows.writeStream.outputMode("append").format("text").partitionBy("topic", "dt")
              .option("compression", "snappy").option("path", out))
    return start(writer, f"{checkpoint}/landing", **run)


def quarantine(bad: DataFrame, out: str, checkpoint: str, **run) -> StreamingQuery:
    """Lines the parsers set aside, as text."""
    return start(bad.writeStream.outputMode("append").format("text").option("path", out),
                 f"{checkpoint}/quarantine", **run)

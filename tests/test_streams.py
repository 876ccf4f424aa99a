import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lectern.operators.activity import funnel_rates, page_views, question_mastery, sliding_count
from lectern.operators.intervals import interval_merge, video_time
from lectern.sinks.tables import ChangeLog, VersionedTable
from lectern.sources.logs import learn_records, page_records, question_records, register_records
from lectern.sources.streams import file_lines, replay_to_dir
from lectern.streaming import jobs
from lectern.streaming.state import POINT_KEYS, VIDEO_KEYS


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


class Replay:
    """A watched directory, filled step by step; each drain starts the job anew from its checkpoint."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)

    def add(self, texts, files=2):
        replay_to_dir(lines(self.spark, texts), f"{self.root}/in", files)

    def drain(self, job, *args, max_files=1, **options):
        source = file_lines(self.spark, f"{self.root}/in", max_files)
        job(source, *args, f"{self.root}/out", f"{self.root}/cp", available_now=True, **options).awaitTermination()

    def log(self, name, keys):
        return ChangeLog(self.spark, f"{self.root}/out/{name}", keys).read()

    def table(self, name):
        return VersionedTable(self.spark, f"{self.root}/out/{name}").read()


@pytest.fixture
def replay(spark, tmp_path):
    return Replay(spark, tmp_path)


def answer_lines(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        uid = 1 if i % 3 == 0 else rng.randrange(2, 20)
        out.append(f"{uid}\t{rng.randrange(2)}\t{rng.randrange(3)}\t{rng.randrange(40)}\t{rng.randrange(2)}\t"
                   f"2019-07-12 11:{i % 60:02d}:00" + rng.choice(["", "", "\t\t"]))
    return out + ["1\t2\t3", "a\tb\tc\td\te\tf"]


def test_mastery_over_batches_and_restarts(spark, replay, rows):
    everything = []
    for seed in (1, 2):
        texts = answer_lines(seed)
        everything += texts
        replay.add(texts)
        replay.drain(jobs.point_detail)
    want = question_mastery(question_records(lines(spark, everything))[0])
    got = replay.log("point_detail", POINT_KEYS)
    assert rows(got, *want.columns) == rows(want)
    row = got.first()
    assert row.qz_count == len(row.questionids.split(","))


def learn_lines(seed, n=500):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ps, ts = rng.randrange(0, 120), rng.randrange(0, 10_000) * 100
        out.append(json.dumps({
            "uid": 1 if i % 3 == 0 else rng.randrange(2, 15), "cwareid": 1, "videoid": rng.randrange(2),
            "chapterid": rng.randrange(3), "edutypeid": rng.randrange(2), "subjectid": rng.randrange(4),
            "sourceType": rng.choice(["PC", "APP"]), "speed": 1, "ts": ts, "te": ts + rng.randrange(0, 90_000),
            "ps": ps, "pe": ps + rng.choice([0, 5, 30, rng.randrange(60)])}))
    return out + ["{broken", json.dumps({"uid": 1, "ps": 9, "pe": 3, "ts": 1, "te": 2})]


def test_video_time_in_one_batch_equals_batch_twin(spark, replay, rows):
    texts = learn_lines(1)
    replay.add(texts, 3)
    replay.drain(jobs.video_detail, max_files=None)
    want = video_time(learn_records(lines(spark, texts))[0])
    assert rows(replay.log("video_detail", VIDEO_KEYS), *want.columns) == rows(want)


def test_video_time_over_batches_keeps_order_free_totals(spark, replay, rows):
    everything = []
    for seed in (1, 2, 3):
        texts = learn_lines(seed, 200)
        everything += texts
        replay.add(texts)
        replay.drain(jobs.video_detail)
    want = video_time(learn_records(lines(spark, everything))[0])
    order_free = [*VIDEO_KEYS, "totaltime", "completetime"]
    got = replay.log("video_detail", VIDEO_KEYS)
    assert rows(got, *order_free) == rows(want, *order_free)
    covered = F.aggregate(F.split("play_interval", ","), F.lit(0), lambda a, i: a + F.substring_index(i, "-", -1).cast(
        "int") - F.substring_index(i, "-", 1).cast("int"))
    assert got.where(covered != F.col("completetime")).count() == 0


def test_tables_of_a_batch_appear_together(spark, replay):
    """A failure between two tables of a batch shows readers the batch before, and a restart takes new files along."""
    def fail(table, batch_id):
        if (table, batch_id) == ("learn_time", 1):
            raise RuntimeError("lost here")

    def drain(**options):
        source = file_lines(spark, f"{replay.root}/in", 1)
        for query in jobs.learn_job(source, f"{replay.root}/out", f"{replay.root}/cp", available_now=True, **options):
            query.awaitTermination()

    assert jobs.learn_tables(spark, f"{replay.root}/out") == {}
    texts = learn_lines(21, 80)
    replay.add(texts, 2)
    with pytest.raises(StreamingQueryException, match="lost here"):
        drain(after_write=fail)
    seen = jobs.learn_tables(spark, f"{replay.root}/out")
    sums = [seen["learn_time"].where("dim = 'chapterid'"), seen["video_detail"]]
    first, same = [df.agg(F.sum("totaltime")).first()[0] for df in sums]
    assert first == same
    more = learn_lines(22, 50)
    replay.add(more, 1)
    drain()
    plays = learn_records(lines(spark, texts + more))[0]
    tables = jobs.learn_tables(spark, f"{replay.root}/out")
    total = plays.agg(F.sum("seconds")).first()[0]
    assert total > first
    assert tables["video_detail"].agg(F.sum("totaltime")).first()[0] == total
    assert tables["learn_time"].where("dim = 'subjectid'").agg(F.sum("totaltime")).first()[0] == total
    merged = {tuple(r)[:3]: r.text for r in interval_merge(plays, VIDEO_KEYS).groupBy(*VIDEO_KEYS).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ps", "pe"))), lambda i: F.concat_ws("-", i["ps"], i["pe"])), ",").alias("text")).collect()}
    assert {tuple(r)[:3]: r.play_interval for r in tables["video_detail"].collect()} == merged


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["k"], buckets=4)
    every = spark.range(40).selectExpr("CAST(id AS int) AS k", "id AS num")
    log.write(every, 0)
    log.write(every.limit(0), 1)
    few = every.where("k < 2")
    touched = log.read(1, touching=few)
    assert touched.join(few, "k", "left_semi").count() == 2 and touched.count() < 40
    assert "_bucket" not in touched.columns
    log.write(few.selectExpr("k", "num + 100 AS num"), 2)
    log.compact(2)
    assert {r.k: r.num for r in log.read().collect()} == {k: k + 100 * (k < 2) for k in range(40)}


def test_whole_job_with_bad_lines_and_compaction(spark, replay, tmp_path):
    replay.add(learn_lines(9, 60), 4)
    source = file_lines(spark, f"{replay.root}/in", 1)
    for query in jobs.learn_job(source, f"{replay.root}/out", f"{replay.root}/cp", f"{replay.root}/bad",
                                available_now=True):
        query.awaitTermination()
    assert spark.read.text(f"{replay.root}/bad").count() == 2
    before = sorted(map(tuple, replay.log("learn_time", ["dim", "key"]).collect()))
    assert len(list((tmp_path / "out" / "learn_time").glob("batch=*"))) == 4
    ChangeLog(spark, f"{replay.root}/out/learn_time", ["dim", "key"]).compact(2)
    assert sorted(p.name for p in (tmp_path / "out" / "learn_time").glob("*=*")) == ["base=2", "batch=3"]
    assert sorted(map(tuple, replay.log("learn_time", ["dim", "key"]).collect())) == before


def test_compaction_while_running(spark, replay, tmp_path):
    texts = learn_lines(10, 60)
    replay.add(texts, 5)
    replay.drain(jobs.learn_time, compact_every=2)
    assert sorted(p.name for p in (tmp_path / "out" / "learn_time").glob("*=*")) == ["base=3", "batch=4"]
    plays, _ = learn_records(lines(spark, texts))
    want = {str(r.chapterid): r.s for r in plays.groupBy("chapterid").agg(F.sum("seconds").alias("s")).collect()}
    got = replay.log("learn_time", ["dim", "key"]).where("dim = 'chapterid'").collect()
    assert {r.key: r.totaltime for r in got} == want


def test_learn_time_by_five_keys(spark, replay):
    texts = learn_lines(4, 100)
    replay.add(texts)
    replay.drain(jobs.learn_time)
    plays, _ = learn_records(lines(spark, texts))
    total = plays.agg(F.sum("seconds")).first()[0]
    sums = {r.dim: r.s for r in replay.log("learn_time", ["dim", "key"]).groupBy("dim").agg(
        F.sum("totaltime").alias("s")).collect()}
    assert sums == {dim: total for dim in jobs.LEARN_DIMS}


def page_lines(seed, n=300):
    rng = random.Random(seed)
    return [json.dumps({"uid": str(i), "ip": f"{rng.choice([1, 1, 2, 3, 9])}.0.0.{rng.randrange(256)}",
                        "last_page_id": "0", "page_id": str(rng.choice([1, 1, 2, 3])), "next_page_id": "2"})
            for i in range(n)] + ["", "[]"]


@pytest.fixture(scope="module")
def ip_ranges(spark):
    return spark.createDataFrame([(i << 24, (i << 24) + 199, f"C|0|P{i}|x|y") for i in (1, 2, 3)],
                                 "start_ip bigint, end_ip bigint, region string")


def test_pages(spark, replay, rows, ip_ranges):
    everything = []
    for seed in (1, 2):
        texts = page_lines(seed)
        everything += texts
        replay.add(texts)
        replay.drain(jobs.transitions)
        replay.drain(jobs.funnel)
        replay.drain(jobs.provinces, ip_ranges)
    pages, _ = page_records(lines(spark, everything))
    assert rows(replay.table("page_views"), "page_id", "num") == rows(page_views(pages), "page_id", "num")
    assert rows(replay.table("page_jump_rate")) == rows(funnel_rates(page_views(pages)))
    assert sum(r.num for r in replay.log("page_transitions", ["last_page_id", "page_id", "next_page_id"]).collect()) == 600
    last = F.substring_index("ip", ".", -1).cast("int")
    province = F.when((last <= 199) & F.col("ip").rlike("^[123]"), F.concat(F.lit("P"), F.substring("ip", 1, 1)))
    want = pages.groupBy(province.alias("province")).agg(F.count(F.lit(1)).alias("num"))
    assert rows(replay.table("province_clicks"), "province", "num") == rows(want)
    best = [(r.province, r.num) for r in want.orderBy(F.col("num").desc(), "province").limit(3).collect()]
    assert sorted(best, key=repr) == rows(replay.table("top_province"), "province", "num")


def test_funnel_without_views(spark):
    views = spark.createDataFrame([("2", 5), ("7", 1)], "page_id string, num bigint")
    assert [tuple(r) for r in funnel_rates(views).collect()] == [("1", 0, "100%"), ("2", 5, "0%"), ("3", 0, "0%")]


def test_registrations(spark, replay, rows):
    rng = random.Random(6)
    texts = [f"{i}\t{rng.randrange(1, 4)}\t2024-01-01 00:{rng.randrange(3):02d}:{rng.randrange(60):02d}" for i in range(400)]
    replay.add(texts)
    replay.drain(jobs.register_total)
    replay.drain(jobs.register_sliding, watermark=None)
    records, _ = register_records(lines(spark, texts))
    assert rows(replay.log("register_total", ["platform"]), "platform", "num") == rows(
        records.groupBy("platform").count())
    want = sliding_count(records.withColumn("ts", F.to_timestamp("register_time")), "ts", "platform")
    assert rows(replay.log("register_sliding", ["window_start", "platform"]), *want.columns) == rows(want)
    plain = records.groupBy(F.window(F.to_timestamp("register_time"), "60 seconds", "6 seconds"), "platform").count()
    assert rows(want) == rows(plain.select("window.start", "window.end", "platform", "count"))


def test_window_that_is_no_multiple_of_its_slide(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:05", "a")], "t string, k string").withColumn("ts", F.to_timestamp("t"))
    starts = sliding_count(df, "ts", "k", "10 seconds", "4 seconds").select(
        (F.unix_timestamp("window_start") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).alias("s"))
    assert sorted(r.s for r in starts.collect()) == [-4, 0, 4]


def test_landing_and_quarantine(spark, replay, tmp_path):
    replay.add(["one", "two"], 1)
    replay.drain(jobs.landing, topic="t1")
    replay.add(["three"], 1)
    replay.drain(jobs.landing, topic="t1")
    landed = spark.read.text(f"{replay.root}/out")
    assert sorted(r.value for r in landed.collect()) == ["one", "three", "two"]
    day = landed.select("topic", F.col("dt").cast("string")).distinct().collect()
    assert [r.topic for r in day] == ["t1"] and len(day[0].dt) == 8
    assert list((tmp_path / "out" / "topic=t1").rglob("*.snappy"))
    _, bad = page_records(file_lines(spark, f"{replay.root}/in"))
    jobs.quarantine(bad, f"{replay.root}/bad", f"{replay.root}/cp2", available_now=True).awaitTermination()
    assert spark.read.text(f"{replay.root}/bad").count() == 3


def test_bad_times_and_late_rows_are_set_aside(spark, replay):
    ok = "a\t1\t2019-07-16 16:01:0%d"
    replay.add([ok % 1, ok % 2, "a\t1\tno time", "a\t1"], files=1)
    source = file_lines(spark, f"{replay.root}/in")
    for query in jobs.register_job(source, f"{replay.root}/out", f"{replay.root}/cp", f"{replay.root}/bad",
                                   watermark="10 minutes", available_now=True):
        query.awaitTermination()
        assert jobs.late_rows(query) == 0
    counted = replay.log("register_sliding", ["window_start", "platform"])
    assert counted.agg(F.max("num")).first()[0] == 2
    assert replay.log("register_total", ["platform"]).first()["num"] == 3
    assert sorted(r.value for r in spark.read.text(f"{replay.root}/bad").collect()) == ["a\t1", "a\t1\tno time"]


def test_closed_windows_come_once_and_leave_late_rows_out(spark, replay, rows):
    def at(i, second):
        return f"{i}\t1\t2024-01-01 00:{second // 60:02d}:{second % 60:02d}"

    def drain():
        query = jobs.register_sliding(file_lines(spark, f"{replay.root}/in"), f"{replay.root}/out", f"{replay.root}/cp",
                                      watermark="30 seconds", closed=True, available_now=True)
        query.awaitTermination()
        return jobs.late_rows(query)

    first = [at(i, second) for i, second in enumerate([0, 5, 61, 200, 200])]
    replay.add(first, 1)
    assert drain() == 0                                        # the watermark is at 170 seconds now
    in_time, late = [at(10, 168), at(11, 175)], [at(12, 3), at(13, 100), at(14, 167)]
    replay.add([*in_time, *late, at(15, 500)], 1)
    assert drain() == 3
    records, _ = register_records(lines(spark, [*first, *in_time, at(15, 500)]))
    whole = sliding_count(records.withColumn("ts", F.to_timestamp("register_time")), "ts", "platform")
    want = whole.where(F.col("window_end") <= F.lit("2024-01-01 00:07:50").cast("timestamp"))
    got = spark.read.parquet(f"{replay.root}/out/register_sliding/batch=*")
    assert rows(got, *want.columns) == rows(want)              # over all batches: no window twice
    with pytest.raises(ValueError, match="watermark"):
        sliding_count(records, "ts", "platform", closed=True)


def test_the_caller_chooses_the_watermark(spark, replay):
    with pytest.raises(TypeError, match="watermark"):
        jobs.register_sliding(None, "out", "cp")


def test_page_job_reads_each_batch_once(spark, replay, rows):
    ranges = spark.createDataFrame([(0, 2 ** 31, "0|A|x"), (2 ** 31, 2 ** 32 - 1, "0|B|x")],
                                   "start_ip bigint, end_ip bigint, region string")
    rng = random.Random(8)
    texts = [json.dumps({"uid": str(i), "last_page_id": "1", "page_id": str(rng.randrange(1, 4)), "next_page_id": "2",
                         "ip": f"{rng.randrange(256)}.1.1.1"}) for i in range(200)]
    for part in (texts[:120] + ["broken"], texts[120:]):
        replay.add(part)
        for query in jobs.page_job(file_lines(spark, f"{replay.root}/in", 1), ranges, f"{replay.root}/out",
                                   f"{replay.root}/cp", f"{replay.root}/bad", available_now=True):
            query.awaitTermination()
    pages, _ = page_records(lines(spark, texts))
    assert rows(replay.table("page_views"), "page_id", "num") == rows(page_views(pages))
    moves = pages.groupBy(*jobs.TRANSITION_KEYS).count()
    assert rows(replay.log("page_transitions", jobs.TRANSITION_KEYS), *jobs.TRANSITION_KEYS, "num") == rows(moves)
    assert replay.table("province_clicks").agg(F.sum("num")).first()[0] == 200
    assert [r.value for r in spark.read.text(f"{replay.root}/bad").collect()] == ["broken"]
    with pytest.raises(Exception, match="another checkpoint"):
        for query in jobs.page_job(file_lines(spark, f"{replay.root}/in", 1), ranges, f"{replay.root}/out",
                                   f"{replay.root}/cp-new", available_now=True):
            query.awaitTermination()


def test_log_totals_survive_a_replay(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["k"])
    one = spark.createDataFrame([("a", 1), (None, 2)], "k string, num bigint")
    log.add(one, 0, ["num"])
    for _ in range(2):
        log.add(one, 1, ["num"])
    log.compact(0)
    log.add(one, 1, ["num"])
    assert sorted(((r.k, r.num) for r in log.read().collect()), key=repr) == [("a", 2), (None, 4)]

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_pulse import CHECKS, DATA, SUMMARY, T0, at, datum, summary

from censora.plans import pulse
from censora.streaming import pulse_stream as S

EVENTS = "system string, datum string, at timestamp, source_latency_ms long"
COLUMNS = ["system", "datum", "since", "class", "w_ms"]


def write_files(df, folder, parts):
    """One file per value of ``parts``, written in that order so that the stream reads them so."""
    for number in range(parts):
        df.where(F.col("part") == number).drop("part").coalesce(1).write.mode("append").parquet(folder)


def test_stream_summaries_equal_batch(spark, frame, tmp_path):
    data = [("s", "ab"[i % 2], T0 + dt.timedelta(seconds=7 * i), i % 5 or None) for i in range(200)]
    df = frame(EVENTS, *data)
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    write_files(df.withColumn("part", F.floor((F.unix_seconds("at") - F.lit(int(T0.timestamp()))) / 500)), folder, 3)
    raw = S.event_stream(spark, folder, df.schema, "*.parquet", files=1)
    keys = ["system", "datum", "minute"]
    got = S.run_available(S.summary_stream(raw), store, keys)
    want = pulse.minute_summaries(df)
    assert rows(got.select(*want.columns)) == rows(want)
    assert spark.read.parquet(f"{store}/rows/n=*").count() > got.count()  # minutes on a file's edge were emitted more than once
    folded = S.compact(spark, store, got.schema, keys, str(tmp_path / "folded"))
    assert rows(folded.select(*want.columns)) == rows(want)


def test_first_seen_keeps_keys_for_good(spark, frame, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    late = T0 - dt.timedelta(days=3)
    df = frame("station string, t timestamp, part int", ("a", at(0), 0), ("a", at(0), 0), ("a", at(1), 0), ("b", at(0), 1), ("a", late, 1), ("a", at(0), 2), ("a", late, 2))
    write_files(df, folder, 3)
    raw = S.event_stream(spark, folder, df.drop("part").schema, "*.parquet", files=1)
    assert rows(S.first_seen_job(raw, ["station", "t"], store)) == rows(frame("station string, t timestamp", ("a", at(0)), ("a", at(1)), ("b", at(0)), ("a", late)))
    # A later run on the same store goes on.
    frame("station string, t timestamp", ("a", at(1)), ("c", at(1))).coalesce(1).write.mode("append").parquet(folder)
    raw = S.event_stream(spark, folder, df.drop("part").schema, "*.parquet", files=1)
    assert S.first_seen_job(raw, ["station", "t"], store).count() == 5


@pytest.fixture
def feed(spark, frame, tmp_path):
    """Reports of three and a half hours with a gap, their folder, and the log that one replay over all of them gives."""
    kept = [m for m in range(200) if not 90 <= m < 100]
    reports = frame(SUMMARY, *[summary(m, events=1, latency=5_000) if m == 30 else summary(m) for m in kept]).drop("on_time")
    data = frame(DATA, datum("event", declared=1_000))

    def replay(checks):
        summaries = pulse.with_punctuality(reports).drop("status")
        until = F.lit(at(200) + dt.timedelta(seconds=30) - dt.timedelta(minutes=pulse.GRACE_MIN, seconds=30))
        return rows(pulse.class_changes(pulse.classes_by_minute(summaries, data, checks, F.lit(at(0)), until)).select(*COLUMNS))

    return reports, data, str(tmp_path / "reports"), str(tmp_path / "store"), replay


def parts_at(reports, *edges):
    """The reports cut at minutes after the start."""
    passed = (F.unix_seconds("received") - F.lit(int(T0.timestamp()))) / 60
    part = F.lit(0)
    for edge in edges:
        part = part + F.when(passed >= edge, 1).otherwise(0)
    return reports.withColumn("part", part)


def run(spark, reports, folder, data, checks, store, files=1):
    stream = S.event_stream(spark, folder, reports.schema, "*.parquet", files=files)
    return rows(S.class_job(stream, lambda: data, checks, store).select(*COLUMNS))


@pytest.mark.parametrize("edges", [(70, 140), (3, 70, 71), (20, 40, 60, 80, 120, 160)], ids=["long", "three minutes first", "many"])
def test_class_job_in_batches_equals_one_replay(spark, frame, feed, edges):
    reports, data, folder, store, replay = feed
    write_files(parts_at(reports, *edges), folder, len(edges) + 1)
    empty = frame(CHECKS)
    got = run(spark, reports, folder, data, lambda: empty, store)
    assert got == replay(empty) and len(got) >= 3


def test_a_first_batch_without_accepted_reports(spark, frame, feed):
    reports, data, folder, store, replay = feed
    refused = reports.limit(5).withColumn("received", F.col("minute") + F.expr("INTERVAL 3 DAYS"))
    refused.coalesce(1).write.parquet(folder)
    write_files(parts_at(reports, 100), folder, 2)
    empty = frame(CHECKS)
    assert run(spark, reports, folder, data, lambda: empty, store) == replay(empty)


def test_stop_and_restart_on_the_same_store(spark, frame, feed):
    reports, data, folder, store, replay = feed
    empty = frame(CHECKS)
    cut = parts_at(reports, 50, 110, 150)
    write_files(cut.where("part < 2"), folder, 2)
    first = run(spark, reports, folder, data, lambda: empty, store)
    write_files(cut.where("part >= 2").withColumn("part", F.col("part") - 2), folder, 2)
    got = run(spark, reports, folder, data, lambda: empty, store)
    assert got == replay(empty) and set(first) < set(got)
    # The log is read for the last hours only: older folders may go.
    assert run(spark, reports, folder, data, lambda: empty, store) == got


def test_checks_that_arrive_between_batches_are_seen(spark, frame, feed, tmp_path):
    reports, data, folder, store, replay = feed
    failures = frame(CHECKS, *[("s", "d", at(m), "no-coincide") for m in (120, 130, 140)])
    place = str(tmp_path / "checks")
    frame(CHECKS).write.parquet(place)
    cut = parts_at(reports, 110)
    read = lambda: spark.read.schema(failures.schema).parquet(place)
    write_files(cut.where("part = 0"), folder, 1)
    run(spark, reports, folder, data, read, store)
    failures.write.mode("append").parquet(place)
    write_files(cut.where("part = 1").withColumn("part", F.lit(0)), folder, 1)
    got = run(spark, reports, folder, data, read, store)
    assert got == replay(failures) and got != replay(frame(CHECKS))

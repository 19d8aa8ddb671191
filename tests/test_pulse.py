import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from censora.plans import pulse

T0 = dt.datetime(2026, 3, 2, 11, 0, 0)
SUMMARY = (
    "system string, datum string, minute timestamp, refreshes long, first timestamp, last timestamp, max_gap_ms long, observations long,"
    " events long, source_latency_max_ms long, deliveries long, delivery_latency_max_ms long, received timestamp, on_time int"
)
DATA = "system string, datum string, source_kind string, source_clock_ms long, declared_latency_ms long, via string, check_url string"
CHECKS = "system string, datum string, at timestamp, result string"


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def summary(minute, first=5, last=5, gap=0, events=0, latency=None, deliveries=0, delivered=None, on_time=1, late=30, system="s", refreshes=1):
    end = at(minute + 1)
    return (
        system, "d", at(minute), refreshes, at(minute, first), at(minute, last), gap, 1, events, latency, deliveries, delivered,
        end + dt.timedelta(seconds=late), on_time,
    )


def datum(kind="calendar", clock=60_000, declared=None, via="poll", url="u"):
    return ("s", "d", kind, clock, declared, via, url)


@pytest.fixture
def grade(frame):
    def run(summaries, data=None, checks=(), start=60, end=60):
        df = pulse.classes_by_minute(
            frame(SUMMARY, *summaries), frame(DATA, data or datum()), frame(CHECKS, *checks), F.lit(at(start)), F.lit(at(end))
        )
        return {int((r.minute - T0).total_seconds() // 60): r for r in df.collect()}

    return run


def every_minute(low, high, **kw):
    return [summary(m, **kw) for m in range(low, high)]


def test_worst_gap_of_the_fixture(frame, grade):
    data = [
        summary(-1, 30, 30),
        summary(0, 10, 50, 40_000, refreshes=2),
        summary(1, 20, 20),
    ]
    assert grade(data)[60].w_ms == 3_520_000
    assert grade(data)[60]["class"] == "fuera-de-clase"
    one = pulse.worst_gap_at(frame(SUMMARY, *data), F.lit(at(0)), F.lit(at(60))).first()
    assert one.worst_ms == 3_520_000


def test_one_refresh_a_minute_is_minute_class(grade):
    got = grade(every_minute(-1, 60))[60]
    assert (got.w_ms, got["class"]) == (60_000, "DPM")


def test_no_summary_before_the_window(grade):
    got = grade(every_minute(0, 60))[60]
    assert (got.w_ms, got["class"]) == (None, "sin-ventana")


def test_late_summaries_do_not_count(grade):
    data = every_minute(-1, 60)
    data[30] = summary(29, on_time=0)
    assert grade(data)[60].w_ms == 120_000


def test_finer_source_clock_is_limited_by_refreshes(grade):
    assert grade(every_minute(-1, 60), datum(clock=1_000))[60]["class"] == "DPM"
    assert grade(every_minute(-1, 60), datum(clock=None))[60]["class"] == "fuera-de-clase"


def test_slow_events_raise_the_declared_latency_for_good(grade):
    data = every_minute(-1, 200)
    data[31] = summary(30, events=1, latency=90_000)
    got = grade(data, datum("event", declared=30_000), start=25, end=150)
    assert got[60].declared_ms == 90_000 and got[60]["class"] == "fuera-de-clase"
    # An hour later nothing is observed any more, but the declaration stays raised.
    assert got[140].declared_ms == 90_000 and got[140]["class"] == "fuera-de-clase"
    assert grade(data, datum("event", declared=None))[60]["class"] == "fuera-de-clase"


def test_three_failed_checks_put_out_of_class(grade):
    fails = [("s", "d", at(30 + 10 * i), "no-coincide") for i in range(3)]
    assert grade(every_minute(-1, 60), checks=fails)[60]["class"] == "fuera-de-clase"
    assert grade(every_minute(-1, 60), checks=[*fails, ("s", "d", at(60), "coincide")])[60]["class"] == "DPM"
    assert grade(every_minute(-1, 60), checks=fails[:2])[60]["class"] == "DPM"
    assert grade(every_minute(-1, 60), datum(url=None))[60]["class"] == "fuera-de-clase"


def test_delivery_path_falls_back_to_the_last_hour_with_deliveries(grade):
    data = [summary(m, deliveries=1, delivered=500 + m) for m in range(0, 30)] + every_minute(30, 300)
    got = grade(data, datum(via="push", clock=1_000), start=30, end=300)
    assert got[60].w_ms == 529 and got[60]["class"] == "DPS"
    assert got[300].w_ms == 529  # hours later the last hour with deliveries still counts


def test_sparse_history_equals_brute_force(grade):
    minutes = [0, 3, 4, 50, 51, 115, 116, 117, 180, 250]
    data = [summary(m, 10, 40, 20_000, refreshes=3) for m in minutes]
    got = grade(data, start=1, end=320)
    for t in range(1, 321):
        window = [m for m in minutes if t - 60 <= m < t]
        before = [m for m in minutes if m < t - 60]
        if not before:
            want = None
        else:
            prev, worst = before[-1] * 60 + 40, 0
            for m in window:
                worst, prev = max(worst, m * 60 + 10 - prev, 20), m * 60 + 40
            want = max(worst, t * 60 - prev) * 1000
        assert got[t].w_ms == want, t


@pytest.mark.parametrize("via", ["poll", "push"])
def test_a_later_start_grades_the_same(grade, via):
    minutes = [*range(0, 70), 75, 140, 141, 200, 205, 330, 331]
    data = [summary(m, 5, 35, 30_000, refreshes=2, deliveries=m % 3, delivered=(m * 37) % 900 if m % 3 else None, events=1, latency=m * 3) for m in minutes]
    checks = [("s", "d", at(10 * i), "no-coincide" if 3 <= i <= 6 or i >= 30 else "coincide") for i in (0, 1, 2, 3, 4, 5, 6, 9, 30, 31, 32)]
    whole = grade(data, datum(via=via), checks, start=0, end=420)
    for start in (1, 61, 130, 210, 265, 331, 400):
        part = grade(data, datum(via=via), checks, start=start, end=420)
        assert {t: (r.w_ms, r["class"]) for t, r in part.items()} == {t: (r.w_ms, r["class"]) for t, r in whole.items() if t >= start}


def test_punctuality(frame):
    df = frame(SUMMARY, summary(0, late=300), summary(1, late=360), summary(2, late=24 * 3600 + 1)).drop("on_time")
    got = pulse.with_punctuality(df).orderBy("minute").collect()
    assert [(r.status, r.on_time) for r in got] == [("on_time", 1), ("late", 0), ("rejected", 0)]


def test_a_replacement_never_regains_punctuality(frame):
    late = list(summary(0, refreshes=9, late=400, on_time=0))
    got = pulse.upsert_summaries(frame(SUMMARY, summary(0)), frame(SUMMARY, late)).first()
    assert (got.refreshes, got.on_time) == (9, 0)
    again = list(summary(0, refreshes=5, late=500, on_time=1))
    twice = pulse.upsert_summaries(frame(SUMMARY, late), frame(SUMMARY, again)).first()
    assert (twice.refreshes, twice.on_time) == (5, 0)


def test_intake_rules(frame):
    known = frame("system string, datum string, via string", ("s", "d", "poll"))
    good = summary(0, 10, 50, 25_000, refreshes=3)
    low = summary(1, 10, 50, 10_000, refreshes=3)  # 10 s × 2 < 40 s
    outside = summary(2, 10, 70, 0, refreshes=2)
    empty = summary(3, refreshes=0)
    other = summary(4, system="x")
    got = pulse.intake_rules(frame(SUMMARY, good, low, outside, empty, other), known).orderBy("minute").collect()
    assert [r.faults for r in got] == [
        [],
        ["gap-below-mean"],
        ["last-outside-minute", "gap-below-mean"],
        ["empty-summary", "no-refresh-outside-delivery"],
        ["unknown-datum"],
    ]


def test_minute_summaries(frame):
    schema = "system string, datum string, at timestamp, source_latency_ms long"
    df = frame(schema, ("s", "d", at(0, 1), 5), ("s", "d", at(0, 11), None), ("s", "d", at(0, 41), 7), ("s", "d", at(1, 0), None))
    got = rows(pulse.minute_summaries(df).select("minute", "refreshes", "max_gap_ms", "events", "source_latency_max_ms"))
    assert got == [(at(0), 3, 30_000, 2, 7), (at(1), 1, 0, 0, None)]


def test_adhesion_needs_seven_days_and_seven_empty_days(frame):
    def noon(day):
        return dt.datetime(2026, 3, 1, 18) + dt.timedelta(days=day)

    days = [*range(0, 7), 9]
    schema = "system string, datum string, minute timestamp, on_time int"
    df = frame(schema, *[("s", "d", noon(d), 1) for d in days], ("s", "d", noon(8), 0))
    first, last = F.lit(dt.date(2026, 3, 2)), F.lit(dt.date(2026, 3, 20))
    got = {r.day.day: r.state for r in pulse.adhesion(df, first, last).collect()}
    assert got[7] == "declarada"  # six complete days
    assert got[8] == "verificada"  # seven
    assert got[16] == "verificada"  # some of the last seven are empty: no change
    assert got[18] == "declarada"  # seven without any


def test_daily_users(frame):
    reports = frame("system string, day date, users long, data array<string>", ("s", dt.date(2026, 3, 2), 10, ["d", "e"]), ("s", dt.date(2026, 3, 4), 4, ["e"]), ("x", dt.date(2026, 3, 2), 7, ["d"]))
    states = frame("system string, day date, state string", ("s", dt.date(2026, 3, 2), "verificada"), ("s", dt.date(2026, 3, 4), "verificada"), ("x", dt.date(2026, 3, 2), "declarada"))
    log = frame("system string, datum string, since timestamp, class string", ("s", "d", dt.datetime(2026, 3, 2, 12), "DPM"), ("s", "d", dt.datetime(2026, 3, 2, 12, 1), "fuera-de-clase"))
    got = rows(pulse.daily_users(reports, states, log).select("system", "day", "counts", "reason"))
    assert got == [
        ("s", dt.date(2026, 3, 2), True, None),
        ("s", dt.date(2026, 3, 4), False, "no datum in class that day"),
        ("x", dt.date(2026, 3, 2), False, "system not verified"),
    ]


def test_class_carried_into_a_day_counts(frame):
    log = frame("system string, datum string, since timestamp, class string", ("s", "d", dt.datetime(2026, 3, 1, 12), "DPM"))
    reports = frame("system string, day date, users long, data array<string>", ("s", dt.date(2026, 3, 9), 10, ["d"]))
    states = frame("system string, day date, state string", ("s", dt.date(2026, 3, 9), "verificada"))
    assert pulse.daily_users(reports, states, log).first().counts is True


def test_seen_versus_reported(frame):
    face = "k string, last timestamp, n long"
    seen = frame(face, ("a", at(0), 10), ("b", at(0), 10), ("c", None, 0), ("d", at(0), 3))
    told = frame(face, ("a", at(4), 12), ("b", at(6), 10), ("d", at(0), 9))
    got = {r.k: r.result for r in pulse.seen_versus_reported(seen, told, ["k"]).collect()}
    assert got == {"a": "coincide", "b": "no-coincide", "c": "coincide", "d": "no-coincide"}


def test_states_do_not_depend_on_where_the_span_starts(frame):
    day = lambda n: F.lit(f"2024-01-{n:02d}").cast("date")
    kept = [("s", dt.datetime(2024, 1, d, 12), 1) for d in range(1, 10)] + [("s", dt.datetime(2024, 1, d, 12), 1) for d in (14, 18, 23)]
    summaries = frame("system string, minute timestamp, on_time int", *kept)
    whole = {r.day: r.state for r in pulse.adhesion(summaries, day(1), day(31)).collect()}
    first = pulse.adhesion(summaries, day(1), day(20))
    later = pulse.adhesion(summaries, day(21), day(31), first.where(F.col("day") == day(20)).select("system", "state"))
    assert {r.day: r.state for r in first.unionByName(later).collect()} == whole
    assert whole[dt.date(2024, 1, 24)] == "verificada" and whole[dt.date(2024, 1, 31)] == "declarada"


def test_a_face_that_does_not_answer_agrees_with_nothing(frame):
    seen = frame("id int, last timestamp, n long", (1, None, None), (2, None, 0), (3, None, 0))
    reported = frame("id int, last timestamp, n long", (3, T0, 4))
    got = {r.id: r.result for r in pulse.seen_versus_reported(seen, reported, ["id"]).collect()}
    assert got == {1: "sin-respuesta", 2: "coincide", 3: "no-coincide"}

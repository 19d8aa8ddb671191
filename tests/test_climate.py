import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from censora.operators import calendar as C
from censora.plans import air, climate, feeds

READING = "station string, instant timestamp, temp_c double, dew_c double, humidity_pct double, pressure_hpa double, wind_ms double, wind_dir double"
NOON = dt.datetime(2026, 3, 2, 18)


def reading(hours=0, temp=20.0, dew=15.0, humidity=73.0, pressure=1010.0, wind=3.0, direction=90.0, station="s"):
    return (station, NOON + dt.timedelta(hours=hours), temp, dew, humidity, pressure, wind, direction)


@pytest.fixture
def marks(frame):
    def run(*readings):
        records = frame("station string, month int, record_low double, record_high double", ("s", 3, 0.0, 40.0))
        got = climate.observation_marks(frame(READING, *readings), records).orderBy("instant").collect()
        return [r.marks for r in got]

    return run


def test_physical_marks(marks):
    assert marks(reading()) == [[]]
    assert marks(reading(temp=41.0, dew=36.0, humidity=77.0)) == [["fuera-de-record"]]
    assert marks(reading(dew=20.6)) == [["rocio-mayor"]]
    assert marks(reading(humidity=90.0)) == [["humedad-incongruente"]]
    assert marks(reading(temp=None)) == [["sin-temperatura"]]
    assert marks(reading(pressure=1090.0, wind=80.0)) == [["presion-fuera-de-rango", "viento-fuera-de-rango"]]


def test_step_marks(marks):
    jump = [reading(), reading(1, temp=32.0, dew=26.0, humidity=71.0)]
    assert marks(*jump)[1] == ["salto-temperatura"]
    assert marks(reading(), reading(2, temp=32.0, dew=26.0, humidity=71.0))[1] == []  # two hours allow 12 °C
    assert marks(reading(), reading(1))[1] == ["igual-a-la-hora-anterior"]
    assert marks(reading(), reading(1, temp=20.5, pressure=1017.0))[1] == ["salto-presion"]
    # The day ends between the two readings: the look-back crosses the block.
    assert marks(reading(5), reading(6))[1] == ["igual-a-la-hora-anterior"]


def test_witness_history_switches_at_48(frame):
    pairs = [("s", NOON + dt.timedelta(hours=i), float(i % 4)) for i in range(60)]
    got = climate.witness_check(frame("station string, instant timestamp, diff double", *pairs)).orderBy("instant").collect()
    assert (got[47].compared, got[47].typical, got[47].tolerance) == (47, 0.0, 6)
    history = sorted(p[2] for p in pairs[:48])
    assert (got[48].typical, got[48].tolerance) == (history[24], 4)


def test_runs_of_missing_hours(frame):
    letters = "FFLFFF"
    df = frame("k string, h int, gone boolean", *[("s", i, c == "F") for i, c in enumerate(letters)], ("t", 0, False))
    got = rows(C.worst_and_current_run(df, ["k"], "h", F.col("gone")))
    assert got == [("s", 3, 3), ("t", 0, 0)]


def test_completeness_strip(frame):
    hour = [NOON + dt.timedelta(hours=i) for i in range(5)]
    schema = "station string, hour timestamp, local_hour int, watched boolean, arrived boolean, marked boolean, delay_min double"
    df = frame(
        schema,
        ("s", hour[0], 12, True, True, False, 4.0),
        ("s", hour[1], 13, False, False, False, None),
        ("s", hour[2], 14, True, True, True, 8.0),
        ("s", hour[3], 15, True, False, False, None),
        ("s", hour[4], 16, True, False, False, None),
    )
    got = climate.completeness(df).first()
    assert (got.strip, got.watched, got.arrived, got.marked, got.missing) == ("L·MFF", 4, 2, 1, 2)
    assert (got.worst_run, got.current_run, got.median_delay_min, got.arrived_pct, got.missing_12) == (2, 2, 6.0, 50.0, 2)


HOURS = "station int, pollutant string, hour long, value double"


def series(pollutant, newest_first, newest=1000):
    return [(1, pollutant, newest - i, float(v)) for i, v in enumerate(newest_first) if v is not None]


def concentration(frame, pollutant, values):
    got = air.base_concentrations(frame(HOURS, *series(pollutant, values))).where("hour = 1000").first()
    return got.concentration


def test_weighted_concentration_of_the_fixture(frame):
    assert concentration(frame, "PM2.5", [30, 28, 26, 24, 22, 20, 18, 16, 14, 12, 10, 8]) == 19
    assert concentration(frame, "PM2.5", [40, None, 38, 36, 36, None, 34, 34, 33, 33, 32, 32]) == 26
    assert concentration(frame, "PM10", [40, None, None, 36, 36]) is None
    assert concentration(frame, "CO", [1, 2, 3, 4, 5]) is None
    assert concentration(frame, "CO", [1, 2, 3, 4, 5, 6]) == 3.5
    assert concentration(frame, "O3", [0.0584]) == 0.058


def test_index_takes_the_worst_fresh_pollutant(frame):
    data = series("PM2.5", [30, 28, 26, 24, 22, 20, 18, 16, 14, 12, 10, 8]) + series("O3", [0.05]) + series("CO", [9] * 8)
    grid = frame("station int, hour long", (1, 1000), (1, 1003), (1, 1004))
    got = {r.hour: r for r in air.index_by_hour(frame(HOURS, *data), grid).collect()}
    assert (got[1000].category, got[1000].pollutant, got[1000].quality) == (1, "PM2.5", "Aceptable")  # CO is stuck
    assert got[1003].category == 1 and got[1004].category is None  # older than three hours


def test_categories_are_inclusive(frame):
    df = frame("p string, c double", ("PM2.5", 15.0), ("PM2.5", 15.1), ("PM2.5", 131.0), ("CO", None))
    assert [r[0] for r in df.select(air.category(F.col("p"), F.col("c"))).collect()] == [0, 1, 4, None]


def test_climatology_equals_brute_force(frame):
    days = [dt.date(y, 1, 1) + dt.timedelta(days=i) for y in range(1999, 2004) for i in range(0, 365, 1)]
    data = [("s", d, float((d.toordinal() * 7) % 31), None) for d in days]
    df = frame("station string, day date, tmax double, tmin double", *data)
    normals = climate.climatology(df, half_window=3, min_years=4, min_reference=1, min_days=300, periods=((2000, 2003),))
    got = {r.date: r for r in normals.where("variable = 'tmax'").collect()}
    values = {d: v for _, d, v, _ in data}
    for label in ("01-01", "02-28", "02-29", "07-15", "12-31"):
        picked = []
        for y in range(2000, 2004):
            month, day = int(label[:2]), int(label[3:])
            if label == "02-29" and y % 4:
                day = 28
            centre = dt.date(y, month, day)
            picked += [values[c] for k in range(-3, 4) if (c := centre + dt.timedelta(days=k)) in values]
        picked.sort()
        assert got[label].n == len(picked), label
        for i in (0, 7, 20):
            position = (len(picked) - 1) * i / 20
            low = int(position)
            high = min(low + 1, len(picked) - 1)
            assert got[label].grid[i] == round(picked[low] + (picked[high] - picked[low]) * (position - low), 1)


def test_event_latency_ignores_what_was_there_before(frame):
    t = NOON
    s = dt.timedelta(seconds=1)
    items = frame(
        "id int, origin timestamp, seen timestamp",
        (1, t - 500 * s, t),
        (2, t + 10 * s, t + 20 * s),
        (2, t + 10 * s, t + 90 * s),
        (3, t + 10 * s, t + 40 * s),
    )
    got = feeds.event_latency(items, ["id"], "origin", "seen").first()
    assert (got.n, got.median_s, got.p90_s, got.max_s) == (2, 10.0, 10.0, 30.0)


def test_frozen_forecast(frame):
    data = [("s", NOON, NOON - dt.timedelta(hours=2), 10.0), ("s", NOON, NOON - dt.timedelta(hours=1), 12.0), ("s", NOON, NOON, 99.0)]
    got = climate.frozen_forecast(frame("station string, hour timestamp, consulted timestamp, temp_c double", *data)).first()
    assert got.temp_c == 12.0


def test_equal_readings_days_apart_are_no_stuck_sensor(frame):
    from censora.operators import calendar as C

    near = frame("s string, hour int, v double", *[("a", h, 5.0) for h in range(6)], *[("b", 24 * h, 5.0) for h in range(6)])
    got = {(r.s, r.hour): r.stuck for r in C.stuck(near, ["s"], "hour", "v", 15).collect()}
    assert got["a", 5] and not got["a", 4] and not got["b", 120]


def test_small_errors_are_not_rounded_away(frame):
    from censora.operators import aggregates as A

    got = A.error_stats(frame("k string, e double", ("a", 0.004), ("a", -0.004), ("a", 0.004)), ["k"], "e").first()
    assert (got.n, got.mae) == (3, 0.004) and abs(got.bias - 0.004 / 3) < 1e-12


def test_climatology_means_are_rounded_once(frame):
    import datetime as dt

    days = [("s", dt.date(y, 1, 1) + dt.timedelta(days=k), 10.04, 1.0) for y in (2001, 2002, 2003, 2004) for k in range(366) if (dt.date(y, 1, 1) + dt.timedelta(days=k)).year == y]
    daily = frame("station string, day date, tmax double, tmin double", *days)
    got = climate.climatology(daily, 7, 3, 2, 300, ((2001, 2004), (2001, 2004))).where("variable = 'tmax'")
    rows_ = {r.date: r for r in got.collect()}
    assert len(rows_) == 366 and {r["mean"] for r in rows_.values()} == {10.0}
    # Every window has 15 days a year, but for those cut off by the ends of the record.
    for label, r in rows_.items():
        want = 0
        for y in (2001, 2002, 2003, 2004):
            month, day = map(int, label.split("-"))
            centre = dt.date(y, 2, 28) if label == "02-29" and y != 2004 else dt.date(y, month, day)
            want += sum(2001 <= (centre + dt.timedelta(days=k)).year <= 2004 for k in range(-7, 8))
        assert r.n == want and r.years == 4, label


def test_witness_history_across_spans(frame):
    import datetime as dt

    start = dt.datetime(2024, 1, 3, 5)
    pairs = [("a", start + dt.timedelta(hours=h), float((h * 37) % 101)) for h in range(0, 24 * 75, 7)]
    got = {r.instant: r for r in climate.witness_history(frame("station string, instant timestamp, diff double", *pairs)).collect()}
    assert len(got) == len(pairs)
    for _, at, _ in pairs:
        before = sorted(d for _, t, d in pairs if at - dt.timedelta(days=30) <= t < at)
        assert got[at].compared == len(before)
        assert got[at].typical == (before[len(before) // 2] if len(before) >= climate.WITNESS_MIN else 0.0)

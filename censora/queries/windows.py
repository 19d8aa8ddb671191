"""Window and analytic operators (F) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.operators import aggregates as A
from censora.operators import calendar as C
from censora.operators import ordering as O
from censora.plans import air, climate, pulse
from censora.queries import Tables, query
from censora.queries import derive as D

PARTS_SQL = """agg AS (SELECT p_name, count(*) AS n, sum(round(p_retailprice * 100)::BIGINT)::BIGINT / (100 * count(*)) AS mean FROM part GROUP BY 1 HAVING count(*) >= 5)"""


def part_means(t: Tables):
    means = t.part.groupBy("p_name").agg(A.rows().alias("n"), A.money_mean("p_retailprice").alias("mean"))
    return means.where("n >= 5")


@query("f1_rank", f"WITH {PARTS_SQL} SELECT p_name, mean, rank() OVER (ORDER BY mean DESC) AS rank FROM agg")
def _(t: Tables):
    return O.ranked(part_means(t), "mean", ["p_name"]).select("p_name", "mean", "rank")


@query("f2_percent_rank", f"WITH {PARTS_SQL} SELECT p_name, mean, percent_rank() OVER (ORDER BY mean) AS percent_rank FROM agg")
def _(t: Tables):
    return O.ranked(part_means(t), "mean", ["p_name"]).select("p_name", "mean", "percent_rank")


@query(
    "f3_lag_gap",
    f"""WITH {PARTS_SQL} SELECT p_name, mean, mean - lag(mean) OVER (ORDER BY mean DESC, p_name) AS gap_vs_next FROM agg""",
)
def _(t: Tables):
    ranked = O.ranked(part_means(t), "mean", ["p_name"])
    return ranked.select("p_name", "mean", (F.col("mean") - F.col("prev_value")).alias("gap_vs_next"))


@query(
    "f4_vs_global_mean",
    """WITH agg AS (SELECT p_brand, sum(round(p_retailprice * 100)::BIGINT)::BIGINT AS c, count(*) AS n FROM part GROUP BY 1),
            g AS (SELECT sum(c)::BIGINT / (100 * sum(n)::BIGINT) AS global_mean FROM agg)
       SELECT p_brand, c / (100 * n) AS mean, (c / (100 * n) - global_mean) / global_mean * 100 AS vs_global_pct FROM agg, g""",
)
def _(t: Tables):
    means = t.part.groupBy("p_brand").agg(A.money_sum("p_retailprice").alias("c"), A.rows().alias("n"))
    overall = means.agg((F.sum("c") / (F.sum("n") * 100)).alias("m")).scalar()
    mean = F.col("c") / (F.col("n") * 100)
    return means.select("p_brand", mean.alias("mean"), ((mean - overall) / overall * 100).alias("vs_global_pct"))


@query(
    "f5_top_positions",
    """SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey)::INTEGER AS position FROM customer GROUP BY 1 ORDER BY position LIMIT 10""",
)
def _(t: Tables):
    counts = t.customer.groupBy("c_nationkey").agg(A.rows().alias("n"))
    top = counts.orderBy(F.desc("n"), "c_nationkey").limit(10)
    # Ten rows are left: their positions are the report itself.
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "c_nationkey", "n"))).alias("rows"))
    return listed.select(F.posexplode("rows")).select("col.c_nationkey", "col.n", (F.col("pos") + 1).alias("position"))


@query(
    "f6_worst_gap",
    """WITH m AS (SELECT event_type AS system, date_trunc('hour', ts) AS h, epoch_us(ts) // 1000 AS ms FROM events),
            g AS (SELECT system, h, ms, ms - lag(ms) OVER (PARTITION BY system ORDER BY ms) AS gap FROM m),
            w AS (SELECT system, max(gap) FILTER (h >= TIMESTAMP '2024-01-20 00:00:00' AND h < TIMESTAMP '2024-01-20 12:00:00') AS inner_gap,
                         max(ms) FILTER (h < TIMESTAMP '2024-01-20 12:00:00') AS last_ms FROM g GROUP BY 1)
       SELECT system, greatest(inner_gap, epoch_ms(TIMESTAMP '2024-01-20 12:00:00') - last_ms) AS worst_ms FROM w""",
)
def _(t: Tables):
    summaries = pulse.minute_summaries(
        t.events.select(
            F.col("event_type").alias("system"),
            F.lit("all").alias("datum"),
            F.col("ts").cast("timestamp").alias("at"),
        )
    )
    end = F.lit("2024-01-20 12:00:00").cast("timestamp")
    worst = pulse.worst_gap_at(summaries, F.lit("2024-01-20 00:00:00").cast("timestamp"), end)
    return worst.select("system", "worst_ms")


WEIGHTED_SQL = """w AS (SELECT a.station, a.pollutant, a.hour, (a.hour - b.hour) AS slot, floor(b.value * 1 + 0.5 + 1e-9) / 1 AS v
          FROM air_hours a JOIN air_hours b ON a.station = b.station AND a.pollutant = b.pollutant AND b.hour BETWEEN a.hour - 11 AND a.hour WHERE a.pollutant IN ('PM2.5', 'PM10')),
     s AS (SELECT station, pollutant, hour, CASE WHEN max(v) > 0 THEN 1 - (max(v) - min(v)) / max(v) ELSE 1 END AS ratio, count(*) FILTER (slot <= 2) AS recent FROM w GROUP BY 1, 2, 3),
     p AS (SELECT station, pollutant, hour, recent, CASE WHEN ratio > 0.5 THEN floor(ratio * 100 + 0.5 + 1e-9) / 100 ELSE 0.5 END AS weight FROM s),
     c AS (SELECT p.station, p.pollutant, p.hour, any_value(recent) AS recent, sum(v * power(weight, slot) ORDER BY slot) / sum(power(weight, slot) ORDER BY slot)
              * CASE p.pollutant WHEN 'PM2.5' THEN 0.694 ELSE 0.714 END AS raw FROM p JOIN w USING (station, pollutant, hour) GROUP BY 1, 2, 3)"""


@query(
    "f7_weighted_moving_average",
    f"""WITH {D.AIR_SQL}, {WEIGHTED_SQL}
        SELECT station, pollutant, hour, CASE WHEN recent >= 2 THEN floor(raw * 1 + 0.5 + 1e-9) / 1 END AS concentration FROM c""",
)
def _(t: Tables):
    base = air.base_concentrations(D.air_hours(t))
    return base.where(F.col("pollutant").isin("PM2.5", "PM10")).select("station", "pollutant", "hour", "concentration")


@query(
    "f8_rolling_mean_8h",
    f"""WITH {D.AIR_SQL} SELECT a.station, a.hour, CASE WHEN count(*) >= 6 THEN floor(sum(b.value ORDER BY b.hour DESC) / count(*) * 100 + 0.5 + 1e-9) / 100 END AS concentration
        FROM air_hours a JOIN air_hours b ON a.station = b.station AND b.pollutant = 'CO' AND b.hour BETWEEN a.hour - 7 AND a.hour WHERE a.pollutant = 'CO' GROUP BY 1, 2""",
)
def _(t: Tables):
    carbon = D.air_hours(t).where("pollutant = 'CO'")
    rolled = C.rolling_mean(carbon, ["station"], "hour", "value", 8, 6, "mean")
    return rolled.select("station", "hour", (F.floor(F.col("mean") * 100 + 0.5 + 1e-9).cast("double") / 100).alias("concentration"))


@query(
    "f9_stuck_sensor",
    """WITH d AS (SELECT o_orderpriority AS station, year(o_orderdate) * 12 + month(o_orderdate) AS month, count(*) // 60 AS value FROM orders WHERE (o_orderkey + month(o_orderdate)) % 4 <> 0 OR month(o_orderdate) % 5 <> 0 GROUP BY 1, 2)
       SELECT station, month::INTEGER AS month, count(value) OVER w = 6 AND min(value) OVER w = max(value) OVER w AND month - min(month) OVER w <= 6 AS stuck FROM d WHERE value <> 1 OR month % 7 <> 0
       WINDOW w AS (PARTITION BY station ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def _(t: Tables):
    # Months stand for hours; some are missing, so six equal readings may span more than the window.
    month = F.month("o_orderdate")
    kept = t.orders.where(((F.col("o_orderkey") + month) % 4 != 0) | (month % 5 != 0))
    number = (F.year("o_orderdate") * 12 + month).alias("month")
    monthly = kept.groupBy(F.col("o_orderpriority").alias("station"), number).agg(F.floor(F.count(F.lit(1)) / 60).alias("value"))
    return C.stuck(monthly.where("value <> 1 or month % 7 <> 0"), ["station"], "month", "value", 6).select("station", "month", "stuck")


GRID_SQL = """span AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events),
     slots AS (SELECT u.user_id, h.hour FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS hour FROM span) h),
     seen AS (SELECT DISTINCT user_id, lo + to_hours(((epoch_us(ts) - epoch_us(lo)) // 21600000000)::INTEGER * 6) AS hour FROM events, span),
     grid AS (SELECT s.user_id, s.hour, e.hour IS NOT NULL AS arrived FROM slots s LEFT JOIN seen e ON e.user_id = s.user_id AND e.hour = s.hour)"""


def six_hour_grid(t: Tables):
    """Six-hour slots of every user over the events' span, with whether the user was seen in the slot."""
    events = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    span = events.agg(
        F.struct(F.date_trunc("hour", F.min("ts")).alias("lo"), F.date_trunc("hour", F.max("ts")).alias("hi"))
    ).scalar()
    step = 6 * 3600
    since = F.unix_seconds(F.date_trunc("hour", "ts")) - F.unix_seconds(span["lo"])
    slot = F.timestamp_seconds(F.unix_seconds(span["lo"]) + F.floor(since / step) * step)
    seen = events.select("user_id", slot.alias("hour")).distinct().withColumn("arrived", F.lit(True))
    grid = C.densify(seen, ["user_id"], "hour", span["lo"], span["hi"], "6 HOURS")
    return grid.withColumn("arrived", F.coalesce("arrived", F.lit(False)))


@query(
    "f10_missing_runs",
    f"""WITH {GRID_SQL}, i AS (SELECT user_id, hour, arrived, row_number() OVER (PARTITION BY user_id ORDER BY hour) - row_number() OVER (PARTITION BY user_id, arrived ORDER BY hour) AS run FROM grid),
             r AS (SELECT user_id, arrived, run, count(*) AS length, max(hour) AS last FROM i GROUP BY 1, 2, 3)
        SELECT user_id, max(CASE WHEN arrived THEN 0 ELSE length END) AS worst_run, arg_max(CASE WHEN arrived THEN 0 ELSE length END, last) AS current_run FROM r GROUP BY 1""",
)
def _(t: Tables):
    return C.worst_and_current_run(six_hour_grid(t), ["user_id"], "hour", ~F.col("arrived"))


@query("f11_calendar_grid", f"WITH {GRID_SQL} SELECT user_id, hour, arrived FROM grid")
def _(t: Tables):
    return six_hour_grid(t).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


CLIMATE_ARGS = {"half_window": 7, "min_years": 5, "min_reference": 2, "min_days": 100, "periods": ((1996, 2000), (1995, 1999))}
CLIMATE_SQL = f"""{D.DAILY_SQL}, fy AS (SELECT station, year(day) AS y, count(tmax) AS days FROM daily GROUP BY 1, 2 HAVING count(tmax) >= 100),
     cnt AS (SELECT s.station, count(*) FILTER (y BETWEEN 1996 AND 2000) AS y0, count(*) FILTER (y BETWEEN 1995 AND 1999) AS y1 FROM (SELECT DISTINCT station FROM daily) s LEFT JOIN fy ON fy.station = s.station GROUP BY 1),
     lvl AS (SELECT station, CASE WHEN y0 >= 5 OR y1 >= 5 THEN 'normal' WHEN y0 >= 2 THEN 'reference' ELSE 'insufficient' END AS level, CASE WHEN y0 >= 5 OR y1 < 5 THEN 1996 ELSE 1995 END AS a,
                    CASE WHEN y0 >= 5 OR y1 >= 5 THEN 5 WHEN y0 >= 2 THEN 2 END AS needed FROM cnt),
     cal AS (SELECT strftime(DATE '2000-01-01' + i::INTEGER, '%m-%d') AS date FROM range(366) r(i)),
     ctr AS (SELECT l.station, l.level, l.needed, c.date, y.y::INTEGER AS y, CASE WHEN c.date = '02-29' AND y.y % 4 <> 0 THEN make_date(y.y, 2, 28) ELSE make_date(y.y, left(c.date, 2)::INTEGER, right(c.date, 2)::INTEGER) END AS centre
             FROM lvl l, cal c, range(1995, 2001) y(y) WHERE y.y BETWEEN l.a AND l.a + 4),
     long AS (SELECT station, day, 'tmax' AS variable, tmax AS value FROM daily UNION ALL SELECT station, day, 'tmin', tmin FROM daily),
     vals AS (SELECT c.station, c.date, c.level, c.needed, c.y, l.variable, l.value FROM ctr c JOIN long l ON l.station = c.station AND l.day BETWEEN c.centre - 7 AND c.centre + 7 WHERE l.value IS NOT NULL),
     stat AS (SELECT station, date, variable, level, needed, count(*) AS n, count(DISTINCT y) AS years, sum(value::DECIMAL(18, 6))::DOUBLE / count(*) AS mean,
                     list(value ORDER BY value) AS vs FROM vals GROUP BY 1, 2, 3, 4, 5)"""


def _interpolated(percent: int) -> str:
    """percentile_cont of the sorted list ``vs`` in SQL."""
    position = f"((n - 1) * {percent} / 100)"
    low, high = f"vs[1 + floor({position})::INTEGER]", f"vs[1 + ceil({position})::INTEGER]"
    return f"({low} + ({high} - {low}) * ({position} - floor({position})))"


@query(
    "f12_climatology",
    f"""WITH {CLIMATE_SQL} SELECT station, date, variable, level, n, years, CASE WHEN ok THEN format('{{:.1f}}', mean)::DOUBLE END AS mean,
            {", ".join(f"CASE WHEN ok THEN format('{{:.1f}}', {_interpolated(p)})::DOUBLE END AS p{p}" for p in (5, 50, 95))}
        FROM (SELECT *, years >= needed AND n >= 0.8 * 15 * needed AS ok FROM stat)""",
)
def _(t: Tables):
    normals = climate.climatology(D.daily(t), **CLIMATE_ARGS)
    grid = lambda i: F.get("grid", F.lit(i))
    return normals.select(
        "station", "date", "variable", "level", "n", "years", "mean",
        grid(1).alias("p5"), grid(10).alias("p50"), grid(19).alias("p95"),
    )


WITNESS_SQL = f"""{D.READINGS_SQL}, pairs AS (SELECT a.station, a.instant, floor((a.temp_c - (b.temp_c + 0.0065 * (length(a.station) * 100))) * 100 + 0.5) / 100 AS diff
         FROM readings a JOIN readings b ON b.station = 'view' AND b.instant = a.instant WHERE a.station <> 'view' AND a.temp_c IS NOT NULL AND b.temp_c IS NOT NULL),
     hist AS (SELECT a.station, a.instant, any_value(a.diff) AS diff, count(b.diff) AS compared, list(b.diff ORDER BY b.diff) FILTER (b.diff IS NOT NULL) AS ds FROM pairs a
              LEFT JOIN pairs b ON b.station = a.station AND b.instant >= a.instant - INTERVAL 30 DAY AND b.instant < a.instant GROUP BY 1, 2),
     wit AS (SELECT station, instant, diff, compared, CASE WHEN compared >= 48 THEN ds[1 + compared // 2] ELSE 0 END AS typical, CASE WHEN compared >= 48 THEN 4 ELSE 6 END AS tolerance FROM hist)"""


def witness_pairs(t: Tables):
    """Each station against the witness ``view`` of the same hour, brought to its height."""
    rows = D.readings(t).where("temp_c is not null")
    witness = rows.where("station = 'view'").select("instant", F.col("temp_c").alias("witness_c"))
    height = F.length("station") * 100
    joined = rows.where("station <> 'view'").join(witness, "instant")
    return joined.select("station", "instant", climate.witness_difference(F.col("temp_c"), F.col("witness_c"), height).alias("diff"))


@query(
    "f13_trailing_history",
    f"WITH {WITNESS_SQL} SELECT station, instant, diff, compared, typical, tolerance FROM wit",
)
def _(t: Tables):
    return climate.witness_history(witness_pairs(t))


STEPS_SQL = f"""{D.READINGS_SQL}, lagged AS (SELECT *, lag(instant) OVER w AS p_instant, lag(temp_c) OVER w AS p_temp, lag(dew_c) OVER w AS p_dew, lag(humidity_pct) OVER w AS p_hum, lag(pressure_hpa) OVER w AS p_pres
         FROM readings WINDOW w AS (PARTITION BY station ORDER BY instant)),
     gaps AS (SELECT *, (epoch_us(instant) - epoch_us(p_instant)) / 3600000000 AS h FROM lagged),
     steps AS (SELECT *, concat_ws(',', CASE WHEN h = 1 AND temp_c = p_temp AND dew_c = p_dew AND humidity_pct = p_hum THEN 'igual-a-la-hora-anterior' END,
         CASE WHEN h > 0 AND h <= 3 AND abs(temp_c - p_temp) > 8 + 2 * h THEN 'salto-temperatura' END, CASE WHEN h > 0 AND h <= 3 AND abs(pressure_hpa - p_pres) > 6 * h THEN 'salto-presion' END) AS step_marks FROM gaps)"""


@query("f14_step_checks", f"WITH {STEPS_SQL} SELECT station, instant, step_marks FROM steps")
def _(t: Tables):
    rows = climate.step_checks(D.readings(t))
    return rows.select("station", "instant", F.concat_ws(",", "step_marks").alias("step_marks"))


EXTREMES_SQL = f"""{D.READINGS_SQL}, loc AS (SELECT station, instant, temp_c, (instant - INTERVAL 6 HOUR) AS local FROM readings WHERE temp_c IS NOT NULL AND k % 10 <> 0),
     ext AS (SELECT station, local::DATE AS day, max(temp_c) FILTER (hour(local) >= 6) AS high, arg_max(instant, (temp_c, -epoch(local))) FILTER (hour(local) >= 6) AS high_at,
         min(temp_c) FILTER (hour(local) * 60 + minute(local) <= 600) AS low, arg_min(instant, (temp_c, epoch(local))) FILTER (hour(local) * 60 + minute(local) <= 600) AS low_at FROM loc GROUP BY 1, 2)"""


def marked_readings(t: Tables):
    rows = D.readings(t)
    return rows.withColumn("marks", F.array_compact(F.array(F.when(F.col("k") % 10 == 0, F.lit("suspect")))))


@query("f15_day_extremes", f"WITH {EXTREMES_SQL} SELECT * FROM ext")
def _(t: Tables):
    return climate.day_extremes(marked_readings(t))

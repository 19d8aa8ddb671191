"""The pulse (M1–M10, A10, E22) over the driver's events: system = event type, datum = user modulo 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.functions.scalars import json_field
from censora.plans import pulse
from censora.queries import Tables, query
from censora.session import materialise, shared_dir
from censora.streaming import pulse_stream as S

EV_SQL = """ev AS (SELECT event_id, event_type AS system, 'd' || (user_id % 4) AS datum, user_id, ts AS inst, date_trunc('minute', ts) AS minute, epoch_us(ts) // 1000 AS ms, ts + to_microseconds(round(value * 1000000)::BIGINT) AS received,
         CASE WHEN user_id % 4 < 2 THEN floor(value * 100)::BIGINT END AS src, CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k')::BIGINT * 20 END AS dlv FROM events),
     gap AS (SELECT system, datum, minute, max(g) AS max_gap_ms FROM (SELECT system, datum, minute, ms - lag(ms) OVER (PARTITION BY system, datum, minute ORDER BY ms) AS g FROM ev) GROUP BY 1, 2, 3),
     sums AS (SELECT e.system, e.datum, e.minute, count(*) AS refreshes, min(inst) AS first, max(inst) AS last, count(*) AS observations, count(src) AS events, max(src) AS source_latency_max_ms, count(dlv) AS deliveries, max(dlv) AS delivery_latency_max_ms,
         max(received) AS received, coalesce(any_value(max_gap_ms), 0) AS max_gap_ms FROM ev e JOIN gap USING (system, datum, minute) GROUP BY 1, 2, 3),
     summ AS (SELECT *, CASE WHEN received <= minute + INTERVAL 6 MINUTE THEN 'on_time' WHEN received <= minute + INTERVAL 1441 MINUTE THEN 'late' ELSE 'rejected' END AS status, (received <= minute + INTERVAL 6 MINUTE)::INTEGER AS on_time FROM sums)"""


def events(rows):
    """Driver events as feed events: lateness from the value, latencies from value and props."""
    at = F.col("ts").cast("timestamp")
    return rows.select(
        F.col("event_type").alias("system"),
        F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("datum"),
        at.alias("at"),
        F.timestamp_micros(F.unix_micros(at) + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("received"),
        F.when(F.col("user_id") % 4 < 2, F.floor(F.col("value") * 100)).alias("source_latency_ms"),
        F.when(F.col("event_type") == "purchase", json_field("props", "k", "bigint") * 20).alias("delivery_latency_ms"),
    )


def summaries(t: Tables):
    return pulse.with_punctuality(pulse.minute_summaries(events(t.events)))


def plain(df):
    """Instants without zone, as the checks have them."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if kinds[c] == "timestamp"})


@query("m1_minute_summaries", f"WITH {EV_SQL} SELECT system, datum, minute, refreshes, first, last, observations, events, source_latency_max_ms, deliveries, delivery_latency_max_ms, max_gap_ms FROM summ")
def _(t: Tables):
    return plain(pulse.minute_summaries(events(t.events).drop("received")))


@query(
    "m1_stream_minute_summaries",
    f"WITH {EV_SQL} SELECT system, datum, minute, refreshes, first, last, observations, events, source_latency_max_ms, deliveries, delivery_latency_max_ms, received, max_gap_ms FROM summ",
)
def _(t: Tables):
    store = S.fresh_store(t.spark, "summaries")
    return plain(deliveries(t, lambda raw: S.run_available(S.summary_stream(events(raw)), store, ["system", "datum", "minute"])))


def deliveries(t: Tables, run):
    """What ``run`` makes of the stream after the last of four deliveries of about eight days, each as many files as Spark writes.

    A tenth of the events comes up to twelve hours late, so that it falls into minutes of the delivery before. The stream goes
    on from its checkpoint when a delivery has arrived, and takes it as one micro-batch.
    """
    stored, folder = shared_dir(t.spark, "events"), shared_dir(t.spark, "deliveries")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_id") % 10 == 0, 12 * 3600).otherwise(0)
    part = F.floor((at + late - F.lit(1_704_067_200)) / (8 * 86_400))
    t.events.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(3), part))).write.partitionBy("part").parquet(stored)
    for number in range(4):
        t.spark.read.parquet(stored).where(F.col("part") == number).drop("part").write.mode("append").parquet(folder)
        result = run(S.event_stream(t.spark, folder, t.events.schema, "*.parquet", files=1_000_000))
    return result


@query("m2_punctuality", f"WITH {EV_SQL} SELECT system, datum, status, count(*) AS summaries, sum(refreshes)::BIGINT AS refreshes FROM summ GROUP BY 1, 2, 3")
def _(t: Tables):
    return summaries(t).groupBy(*pulse.KEYS, "status").agg(F.count(F.lit(1)).alias("summaries"), F.sum("refreshes").alias("refreshes"))


def described(rows):
    """``rows(system, datum)`` with what a catalogue declares of them."""
    datum = F.col("datum")
    return rows.select(
        "system",
        "datum",
        F.when(datum.isin("d0", "d1"), "event").otherwise("calendar").alias("source_kind"),
        F.when(datum == "d2", 60_000).when(datum == "d3", 1_000).cast("bigint").alias("source_clock_ms"),
        F.when(datum == "d0", 900).cast("bigint").alias("declared_latency_ms"),
        F.when(F.col("system") == "purchase", "push").otherwise("poll").alias("via"),
        F.when(F.col("system") != "signup", "https://example.org").alias("check_url"),
        F.when(datum != "d3", "custodiado").otherwise("servido").alias("mode"),
        F.when(datum != "d1", "sha256").alias("verified_at"),
    )


def catalogue(t: Tables):
    rows = t.events.select(F.col("event_type").alias("system"), F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("datum"))
    return described(rows.distinct())


def checks(t: Tables):
    k = json_field("props", "k", "int")
    rows = t.events.where(k % 10 < 3)
    return rows.select(
        F.col("event_type").alias("system"),
        F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("datum"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(k % 3 == 0, "coincide").otherwise("no-coincide").alias("result"),
    )


def graded(t: Tables):
    """Minute summaries as a stored table, the catalogue of their data, and the class of each datum at each minute.

    The events are read twice: for the summaries and for the checks.
    """
    stored = materialise(summaries(t), "summaries")
    ends = stored.agg(F.min("minute").alias("lo"), (F.max("minute") + F.expr("INTERVAL 5 MINUTES")).alias("hi")).first()
    data = materialise(described(stored.select(*pulse.KEYS).distinct()).drop("mode", "verified_at"), "catalogue")
    return stored, data, pulse.classes_by_minute(stored, data, checks(t), F.lit(ends.lo), F.lit(ends.hi))


def classes(t: Tables):
    return graded(t)[2]


CLASS_SQL = f"""{EV_SQL},
     data AS (SELECT DISTINCT system, datum, CASE WHEN datum IN ('d0', 'd1') THEN 'event' ELSE 'calendar' END AS kind, CASE datum WHEN 'd2' THEN 60000 WHEN 'd3' THEN 1000 END AS clock, CASE WHEN datum = 'd0' THEN 900 END AS declared, system = 'purchase' AS push, system <> 'signup' AS checked FROM ev),
     lim AS (SELECT date_trunc('minute', min(inst)) AS lo, date_trunc('minute', max(inst)) + INTERVAL 5 MINUTE AS hi FROM ev),
     ont AS (SELECT *, epoch_us(last) // 1000 AS last_ms, greatest(epoch_us(first) // 1000 - lag(epoch_us(last) // 1000) OVER (PARTITION BY system, datum ORDER BY minute), max_gap_ms) AS gap FROM summ, lim WHERE on_time = 1 AND minute < hi),
     begin AS (SELECT system, datum, min(minute) AS m0 FROM ont GROUP BY 1, 2),
     grid AS (SELECT d.*, g.minute FROM data d, (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS minute FROM lim) g),
     win AS (SELECT g.system, g.datum, g.minute, max(o.gap) AS gap, max(CASE WHEN o.deliveries > 0 THEN o.delivery_latency_max_ms END) AS push_now, max(CASE WHEN o.events > 0 THEN o.source_latency_max_ms END) AS src_now
             FROM grid g JOIN ont o ON o.system = g.system AND o.datum = g.datum AND o.minute >= g.minute - INTERVAL 60 MINUTE AND o.minute < g.minute GROUP BY 1, 2, 3),
     roll AS (SELECT a.system, a.datum, a.minute, max(CASE WHEN b.deliveries > 0 THEN b.delivery_latency_max_ms END) AS w, max(CASE WHEN b.events > 0 THEN b.source_latency_max_ms END) AS s
              FROM ont a JOIN ont b ON a.system = b.system AND a.datum = b.datum AND b.minute > a.minute - INTERVAL 60 MINUTE AND b.minute <= a.minute WHERE a.deliveries > 0 AND a.delivery_latency_max_ms IS NOT NULL GROUP BY 1, 2, 3),
     w0 AS (SELECT g.*, win.gap, push_now, src_now, l.last_ms, r.w AS push_last, r.s AS src_last, r.minute + INTERVAL 1 MINUTE AS roll_end, m0 < g.minute - INTERVAL 60 MINUTE AS covered
            FROM grid g LEFT JOIN win USING (system, datum, minute) LEFT JOIN begin USING (system, datum) ASOF LEFT JOIN ont l ON l.system = g.system AND l.datum = g.datum AND l.minute < g.minute
            ASOF LEFT JOIN roll r ON r.system = g.system AND r.datum = g.datum AND r.minute < g.minute),
     w1 AS (SELECT *, CASE WHEN push THEN coalesce(push_now, push_last) WHEN covered THEN greatest(gap, epoch_us(minute) // 1000 - last_ms) END AS w, CASE WHEN push AND push_now IS NULL THEN src_last ELSE src_now END AS src, CASE WHEN push AND push_now IS NULL AND push_last IS NOT NULL THEN roll_end END AS until FROM w0),
     w2 AS (SELECT *, CASE WHEN declared IS NOT NULL THEN greatest(declared, max(CASE WHEN w IS NOT NULL THEN src END) OVER (PARTITION BY system, datum ORDER BY minute)) END AS raised FROM w1),
     ord AS (SELECT *, CASE WHEN w IS NULL THEN NULL WHEN w <= 1 THEN 0 WHEN w <= 1000 THEN 1 WHEN w <= 60000 THEN 2 ELSE 3 END AS o1,
             CASE WHEN kind = 'event' AND declared IS NULL THEN NULL WHEN kind = 'event' THEN coalesce(src, raised) ELSE clock END AS bound FROM w2),
     chk AS (SELECT system, datum, inst, count(*) FILTER (bad) OVER (PARTITION BY system, datum ORDER BY inst ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS failing
             FROM (SELECT event_type AS system, 'd' || (user_id % 4) AS datum, ts AS inst, json_extract_string(props, '$.k')::INTEGER % 3 <> 0 AS bad FROM events WHERE json_extract_string(props, '$.k')::INTEGER % 10 < 3)),
     cm AS (SELECT system, datum, date_trunc('minute', inst) - INTERVAL 5 MINUTE AS t, arg_max(failing, inst) AS failing FROM chk GROUP BY 1, 2, 3),
     gr AS (SELECT o.*, coalesce(c.failing, false) AS failing, CASE WHEN w IS NULL THEN 4 ELSE greatest(o1, CASE WHEN bound IS NULL OR bound < 0 THEN 3 WHEN bound <= 1 THEN 0 WHEN bound <= 1000 THEN 1 WHEN bound <= 60000 THEN 2 ELSE 3 END) END AS o2
            FROM ord o ASOF LEFT JOIN cm c ON c.system = o.system AND c.datum = o.datum AND c.t <= o.minute),
     cls AS (SELECT system, datum, minute, until, w AS w_ms, raised AS declared_ms, CASE CASE WHEN o2 < 3 AND (NOT checked OR failing) THEN 3 ELSE o2 END WHEN 0 THEN 'DPMS' WHEN 1 THEN 'DPS' WHEN 2 THEN 'DPM' WHEN 3 THEN 'fuera-de-clase' ELSE 'sin-ventana' END AS class FROM gr)"""


@query(
    "m3_class_by_minute",
    f"WITH {CLASS_SQL} SELECT system, datum, class, count(*) AS minutes, sum(w_ms)::BIGINT AS sum_w_ms, max(w_ms) AS worst_ms, max(declared_ms) AS declared_ms FROM cls GROUP BY 1, 2, 3",
)
def _(t: Tables):
    graded = classes(t)
    return graded.groupBy(*pulse.KEYS, "class").agg(
        F.count(F.lit(1)).alias("minutes"),
        F.sum("w_ms").alias("sum_w_ms"),
        F.max("w_ms").alias("worst_ms"),
        F.max("declared_ms").alias("declared_ms"),
    )


@query(
    "m4_no_window",
    f"WITH {CLASS_SQL} SELECT system, datum, count(*) FILTER (w_ms IS NULL) AS minutes_without_window, min(minute) FILTER (w_ms IS NOT NULL) AS first_window FROM cls GROUP BY 1, 2",
)
def _(t: Tables):
    graded = classes(t)
    window = F.when(F.col("w_ms").isNotNull(), F.col("minute"))
    return plain(
        graded.groupBy(*pulse.KEYS).agg(
            F.count_if(F.col("w_ms").isNull()).alias("minutes_without_window"), F.min(window).alias("first_window")
        )
    )


@query(
    "m5_delivery_path",
    f"WITH {CLASS_SQL} SELECT datum, date_trunc('hour', minute) AS hour, count(*) AS minutes, count(w_ms) AS graded, sum(w_ms)::BIGINT AS sum_w_ms, count(until) AS stale, max(until) AS measured_until FROM cls WHERE system = 'purchase' GROUP BY 1, 2",
)
def _(t: Tables):
    rows = classes(t).where("system = 'purchase'").groupBy("datum", F.date_trunc("hour", "minute").alias("hour"))
    return plain(
        rows.agg(
            F.count(F.lit(1)).alias("minutes"),
            F.count("w_ms").alias("graded"),
            F.sum("w_ms").alias("sum_w_ms"),
            F.count("w_until").alias("stale"),
            F.max("w_until").alias("measured_until"),
        )
    )


@query(
    "m6_raised_declarations",
    f"WITH {CLASS_SQL} SELECT system, datum, minute AS since, from_ms, declared_ms AS to_ms FROM (SELECT *, coalesce(lag(declared_ms) OVER (PARTITION BY system, datum ORDER BY minute), CASE WHEN datum = 'd0' THEN 900 END)::BIGINT AS from_ms FROM cls) WHERE declared_ms > from_ms",
)
def _(t: Tables):
    _, data, rows = graded(t)
    return plain(pulse.raised_declarations(rows, data))


@query("m6_source_clock", f"WITH {CLASS_SQL} SELECT system, datum, max(declared_ms) AS declared_ms, count(*) FILTER (class IN ('DPM', 'DPS', 'DPMS')) AS in_class FROM cls GROUP BY 1, 2")
def _(t: Tables):
    return classes(t).groupBy(*pulse.KEYS).agg(
        F.max("declared_ms").alias("declared_ms"), F.count_if(F.col("class").isin(*pulse.IN_CLASS)).alias("in_class")
    )


@query("m7_failed_checks", f"WITH {CLASS_SQL} SELECT system, datum, t AS minute, failing FROM cm")
def _(t: Tables):
    rows = pulse.failing_checks(checks(t))
    return plain(rows.select(*pulse.KEYS, F.timestamp_seconds(F.col("t") * 60).alias("minute"), "failing"))


CHANGES_SQL = f"""{CLASS_SQL}, chg AS (SELECT system, datum, minute AS since, class, w_ms FROM (SELECT *, lag(class, 1, 'sin-ventana') OVER (PARTITION BY system, datum ORDER BY minute) AS before FROM cls) WHERE class <> before)"""


@query("m8_class_changes", f"WITH {CHANGES_SQL} SELECT *, lead(since) OVER (PARTITION BY system, datum ORDER BY since) AS until FROM chg")
def _(t: Tables):
    return plain(pulse.class_intervals(pulse.class_changes(classes(t)).drop("w_until")))


DUE_SQL = CHANGES_SQL.replace(
    "date_trunc('minute', max(inst)) + INTERVAL 5 MINUTE AS hi FROM ev", "date_trunc('minute', max(received)) - INTERVAL 5 MINUTE AS hi FROM ev"
)


@query("m8_stream_class_changes", f"WITH {DUE_SQL} SELECT system, datum, since, class, w_ms FROM chg")
def _(t: Tables):
    # Reports reach the stream in order of arrival, eight days per micro-batch of so many files.
    files = 4
    reports = summaries(t).where("status <> 'rejected'").drop("status", "on_time")
    folder, week = shared_dir(t.spark, "reports"), F.floor((F.dayofmonth("received") - 1) / 8)
    stored = materialise(reports.select("*", F.when(F.month("received") == 1, week).otherwise(3).alias("part")), "reports-all")
    for number in range(4):
        stored.where(F.col("part") == number).drop("part").repartition(files).write.mode("append").parquet(folder)
    stream = S.event_stream(t.spark, folder, reports.schema, "*.parquet", files=files)
    data = materialise(catalogue(t).drop("mode", "verified_at"), "catalogue")
    changed = S.class_job(stream, lambda: data, lambda: checks(t), S.fresh_store(t.spark, "classes"))
    return plain(changed.drop("w_until"))


USER_SQL = """us AS (SELECT user_id, date_trunc('minute', ts) AS minute, max(ts + to_microseconds(round(value * 1000000)::BIGINT)) AS received FROM events GROUP BY 1, 2),
     dys AS (SELECT DISTINCT 'u' || user_id AS system, (minute - INTERVAL 6 HOUR)::DATE AS day FROM us WHERE received <= minute + INTERVAL 6 MINUTE),
     cal AS (SELECT s.system, (DATE '2023-12-25' + i::INTEGER) AS day FROM (SELECT DISTINCT 'u' || user_id AS system FROM us) s, range(38) r(i)),
     wk AS (SELECT c.system, c.day, count(d.day) AS days FROM cal c LEFT JOIN dys d ON d.system = c.system AND d.day BETWEEN c.day - 7 AND c.day - 1 WHERE c.day >= DATE '2024-01-01' GROUP BY 1, 2),
     vd AS (SELECT *, CASE WHEN days >= 7 THEN 'verificada' WHEN days = 0 THEN 'declarada' END AS v FROM wk)"""


def user_summaries(t: Tables):
    at = F.col("ts").cast("timestamp")
    feed = t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("system"),
        F.lit("all").alias("datum"),
        at.alias("at"),
        F.timestamp_micros(F.unix_micros(at) + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("received"),
    )
    minute = F.date_trunc("minute", "at").alias("minute")
    return pulse.with_punctuality(feed.groupBy(*pulse.KEYS, minute).agg(F.max("received").alias("received")))


@query(
    "m9_adhesion",
    f"""WITH {USER_SQL}, sg AS (SELECT *, count(v) OVER (PARTITION BY system ORDER BY day) AS grp FROM vd) SELECT system, day, days AS days_on_time, coalesce(max(v) OVER (PARTITION BY system, grp), 'declarada') AS state FROM sg""",
)
def _(t: Tables):
    # The second half of the month goes on from the states at the end of the first.
    day = lambda n: F.lit(f"2024-01-{n:02d}").cast("date")
    rows = user_summaries(t)
    first = materialise(pulse.adhesion(rows, day(1), day(15)), "states")
    return first.unionByName(pulse.adhesion(rows, day(16), day(31), first.where(F.col("day") == day(15))))


TYPE_STATES_SQL = """tdy AS (SELECT DISTINCT system, (minute - INTERVAL 6 HOUR)::DATE AS day FROM summ WHERE on_time = 1),
     tcal AS (SELECT s.system, (DATE '2024-01-01' + i::INTEGER) AS day FROM (SELECT DISTINCT system FROM summ) s, range(31) r(i)),
     tst AS (SELECT c.system, c.day, CASE WHEN max(CASE WHEN n >= 7 THEN 1 ELSE 0 END) OVER (PARTITION BY c.system ORDER BY c.day) = 1 THEN 'verificada' ELSE 'declarada' END AS state
             FROM (SELECT c.system, c.day, count(d.day) AS n FROM tcal c LEFT JOIN tdy d ON d.system = c.system AND d.day BETWEEN c.day - 7 AND c.day - 1 GROUP BY 1, 2) c)"""


@query(
    "m10_daily_users",
    f"""WITH {CHANGES_SQL}, {TYPE_STATES_SQL}, iv AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY system, datum ORDER BY since), TIMESTAMP '9999-12-31') AS until FROM chg),
            rp AS (SELECT system, (inst - INTERVAL 6 HOUR)::DATE AS day, count(DISTINCT user_id) AS users FROM ev GROUP BY 1, 2),
            ic AS (SELECT r.system, r.day, bool_or(i.system IS NOT NULL) AS in_class FROM rp r LEFT JOIN iv i ON i.system = r.system AND i.class IN ('DPM', 'DPS', 'DPMS') AND i.since < r.day::TIMESTAMP + INTERVAL 30 HOUR AND i.until > r.day::TIMESTAMP + INTERVAL 6 HOUR GROUP BY 1, 2)
        SELECT r.system, r.day, users, coalesce(state = 'verificada', false) AND in_class AS counts, CASE WHEN NOT coalesce(state = 'verificada', false) THEN 'system not verified' WHEN NOT in_class THEN 'no datum in class that day' END AS reason
        FROM rp r JOIN ic USING (system, day) LEFT JOIN tst s ON s.system = r.system AND s.day = r.day""",
)
def _(t: Tables):
    rows, _, grades = graded(t)
    states = pulse.adhesion(rows, F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))
    civil = F.to_date(F.col("ts") - F.expr("INTERVAL 6 HOURS"))
    reports = t.events.groupBy(F.col("event_type").alias("system"), civil.alias("day")).agg(
        F.count_distinct("user_id").alias("users"),
        F.array(*[F.lit(f"d{i}") for i in range(4)]).alias("data"),
    )
    return pulse.daily_users(reports, states, pulse.class_changes(grades))


@query(
    "e22_throughput",
    f"""WITH {EV_SQL}, el AS (SELECT DISTINCT system, datum FROM ev WHERE datum NOT IN ('d1', 'd3') AND system <> 'error')
        SELECT coalesce(sum(observations), 0)::BIGINT AS observations, coalesce(sum(observations), 0)::BIGINT / 43200 AS per_minute FROM summ JOIN el USING (system, datum) WHERE minute >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY AND minute < TIMESTAMP '2024-01-31 00:00:00'""",
)
def _(t: Tables):
    states = t.events.select(F.col("event_type").alias("system")).distinct()
    states = states.withColumn("state", F.when(F.col("system") == "error", "declarada").otherwise("verificada"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return pulse.throughput(summaries(t), catalogue(t), states, now, 30 * 24 * 60)


@query(
    "a10_upsert_summaries",
    f"""WITH {EV_SQL}, nw AS (SELECT system, datum, minute, refreshes + 1 AS refreshes, received + INTERVAL 10 MINUTE AS received, 0 AS on_time FROM summ WHERE datum = 'd1')
        SELECT s.system, s.datum, s.minute, coalesce(n.refreshes, s.refreshes) AS refreshes, coalesce(n.received, s.received) AS received, least(s.on_time, coalesce(n.on_time, s.on_time))::INTEGER AS on_time FROM summ s LEFT JOIN nw n USING (system, datum, minute)""",
)
def _(t: Tables):
    stored = summaries(t).select(*pulse.KEYS, "minute", "refreshes", "received", "on_time")
    again = stored.where("datum = 'd1'").select(
        *pulse.KEYS,
        "minute",
        (F.col("refreshes") + 1).alias("refreshes"),
        (F.col("received") + F.expr("INTERVAL 10 MINUTES")).alias("received"),
        F.lit(0).alias("on_time"),
    )
    return plain(pulse.upsert_summaries(stored, again))

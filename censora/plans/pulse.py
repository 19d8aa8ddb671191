"""The pulse: minute summaries of feeds, punctuality, freshness classes minute by minute, adhesion and daily users.

Instants are UTC timestamps; durations are whole milliseconds. A summary row describes one minute of one datum of a system.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.functions.scalars import civil_date
from censora.operators.joins import in_class_on_days
from censora.operators.ordering import join_null_safe, with_previous
from censora.session import materialise

# Fixed values of the protocol: window, grace and latest arrival (minutes), civil days to become verified, checks that must
# fail in a row, class limits in milliseconds, class names from the finest to the coarsest.
WINDOW_MIN = 60
GRACE_MIN = 5
MAX_DELAY_MIN = 24 * 60
DAYS_TO_VERIFY = 7
FAILED_CHECKS = 3
CHECK_TOLERANCE_MS = 5 * 60_000
CLASS_LIMITS_MS = (1, 1_000, 60_000)
CLASSES = ("DPMS", "DPS", "DPM", "fuera-de-clase", "sin-ventana")
IN_CLASS = CLASSES[:3]
NO_WINDOW = CLASSES[4]

KEYS = ["system", "datum"]
# What grading remembers of a datum's past.
MEMORY = ("old_last", "old_first_t", "old_hour", "old_failing")
MEMORY_DDL = "old_last bigint, old_first_t bigint, old_hour struct<delivered:bigint,observed:bigint,last_t:bigint>, old_failing boolean"


def _minutes(n: int | Column) -> Column:
    return F.make_dt_interval(mins=F.lit(n) if isinstance(n, int) else n)


def _ms(instant: Column | str) -> Column:
    return F.unix_millis(F.col(instant) if isinstance(instant, str) else instant)


def grade_of(ms: Column) -> Column:
    """Grade of a period, 0 the finest; 3 beyond the limits and where no bound is declared (NULL or negative)."""
    fine, second, minute = CLASS_LIMITS_MS
    return F.when((ms < 0) | (ms > minute), 3).when(ms <= fine, 0).when(ms <= second, 1).when(ms <= minute, 2).otherwise(3)


def class_name(grade: Column) -> Column:
    names = F.lit(CLASSES[-1])
    for i, name in enumerate(CLASSES[:-1]):
        names = F.when(grade == i, name).otherwise(names)
    return names


# ------------------------------------------------------------------ minute summaries


def summary_columns(at: str = "at", extras: Sequence[str] = ()) -> list[Column]:
    """Aggregates of one minute for a stream, which allows one grouping and no look-back.

    The instants of a minute are kept as a set of milliseconds: at most 60,000 numbers however many rows a minute has, so a
    hot minute folds map-side. ``extras`` names the optional inputs that are present: ``source_latency_ms`` (set on events of
    the source), ``delivery_latency_ms`` (set on deliveries).
    """
    refresh = F.col("is_refresh") if "is_refresh" in extras else F.lit(True)
    columns = [
        F.count_if(refresh).alias("refreshes"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.collect_set(F.when(refresh, _ms(at))).alias("instants"),
        F.count(F.lit(1)).alias("observations"),
    ]
    for name, count in (("source_latency_ms", "events"), ("delivery_latency_ms", "deliveries")):
        present = F.col(name) if name in extras else F.lit(None).cast("long")
        worst = name.replace("_ms", "_max_ms")
        columns += [F.count(present).alias(count), F.max(present).alias(worst)]
    return columns


def with_inner_gap(summaries: DataFrame) -> DataFrame:
    """Replace the set of instants by the longest gap between consecutive ones (0 for a single refresh)."""
    ordered = F.array_sort("instants")
    size = F.size("instants")
    gaps = F.zip_with(F.slice(ordered, 2, F.greatest(size - 1, F.lit(0))), ordered, lambda later, earlier: later - earlier)
    longest = F.coalesce(F.array_max(F.filter(gaps, lambda g: g.isNotNull())), F.lit(0).cast("long"))
    return summaries.withColumn("max_gap_ms", longest).drop("instants")


def minute_summaries(events: DataFrame) -> DataFrame:
    """``events(system, datum, at, …)`` → one row per system, datum and minute; ``received``, if there, is the latest arrival.

    Rows of one millisecond fold first, map-side; the gaps of a minute are then a look-back over its distinct instants,
    60,000 at most. Gives what ``summary_columns`` gives in a stream.
    """
    have = set(events.columns)
    refresh = F.col("is_refresh") if "is_refresh" in have else F.lit(True)
    minute = [*KEYS, "minute"]
    latencies = [(n, c) for n, c in (("source_latency_ms", "events"), ("delivery_latency_ms", "deliveries"))]
    folded = [
        F.count_if(refresh).alias("refreshes"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
        F.count(F.lit(1)).alias("observations"),
    ]
    for name, count in latencies:
        present = F.col(name) if name in have else F.lit(None).cast("long")
        folded += [F.count(present).alias(count), F.max(present).alias(name.replace("_ms", "_max_ms"))]
    if "received" in have:
        folded.append(F.max("received").alias("received"))
    instants = events.groupBy(*KEYS, F.date_trunc("minute", "at").alias("minute"), _ms("at").alias("ms")).agg(*folded)
    refreshed = F.when(F.col("refreshes") > 0, F.col("ms"))
    earlier = F.last(refreshed, ignorenulls=True).over(
        W.partitionBy(*minute).orderBy("ms").rowsBetween(W.unboundedPreceding, -1)
    )
    gaps = instants.withColumn("gap", refreshed - earlier)
    return gaps.groupBy(*minute).agg(
        F.sum("refreshes").alias("refreshes"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("observations").alias("observations"),
        *[c for n, k in latencies for c in (F.sum(k).alias(k), F.max(n.replace("_ms", "_max_ms")).alias(n.replace("_ms", "_max_ms")))],
        *([F.max("received").alias("received")] if "received" in have else []),
        F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap_ms"),
    )


def with_punctuality(summaries: DataFrame) -> DataFrame:
    """``status``: on time up to five minutes after the minute's end, late (kept, never counted) up to 24 hours, rejected."""
    end = F.col("minute") + _minutes(1)
    status = (
        F.when(F.col("received") <= end + _minutes(GRACE_MIN), "on_time")
        .when(F.col("received") <= end + _minutes(MAX_DELAY_MIN), "late")
        .otherwise("rejected")
    )
    return summaries.withColumn("status", status).withColumn("on_time", (status == "on_time").cast("int"))


def intake_rules(summaries: DataFrame, known: DataFrame) -> DataFrame:
    """Every reported summary with ``faults``, the codes of the validity rules it breaks; accepted when there are none.

    ``known(system, datum, via)`` is the catalogue of declared data; ``received`` is the arrival of the report, and one
    arrival of a system is one report, in which a minute of a datum may stand once (``report``, if there, tells them apart).
    """
    report = ["system", "report" if "report" in summaries.columns else "received"]
    times = summaries.groupBy(*report, "datum", "minute").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = summaries.join(known.select(*KEYS, "via"), KEYS, "left")
    rows = join_null_safe(rows, times, [*dict.fromkeys([*report, "datum", "minute"])], "left")
    start, end = F.col("minute"), F.col("minute") + _minutes(1)
    received, gap, span = F.col("received"), F.col("max_gap_ms"), _ms("last") - _ms("first")
    refreshes, events, deliveries = F.col("refreshes"), F.coalesce("events", F.lit(0)), F.coalesce("deliveries", F.lit(0))
    by_subject = {
        "who": {"unknown-datum": F.col("via").isNull()},
        "when": {
            "minute-not-truncated": start != F.date_trunc("minute", "minute"),
            "minute-in-future": start > F.date_trunc("minute", received),
            "too-old": received > end + _minutes(MAX_DELAY_MIN),
            "minute-repeated": F.col("times").isNotNull(),
        },
        "instants": {
            "first-outside-minute": ~((F.col("first") >= start) & (F.col("first") < end)),
            "last-outside-minute": ~((F.col("last") >= start) & (F.col("last") < end)),
            "last-before-first": span < 0,
        },
        "counts": {
            "negative-count": F.least(refreshes, "observations", gap) < 0,
            "empty-summary": (refreshes == 0) & (deliveries == 0),
            "no-refresh-outside-delivery": (refreshes == 0) & (F.col("via") != "push"),
        },
        "gaps": {
            "single-with-span": (refreshes == 1) & (span != 0),
            "gap-without-pair": (refreshes < 2) & (gap != 0),
            "gap-exceeds-span": (refreshes > 1) & (gap > span),
            "gap-below-mean": (refreshes > 1) & (gap * (refreshes - 1) < span),
        },
        "latencies": {
            "events-without-latency": (events > 0) & F.col("source_latency_max_ms").isNull(),
            "deliveries-without-latency": (deliveries > 0) & F.col("delivery_latency_max_ms").isNull(),
        },
    }
    tests = [(code, test) for rules in by_subject.values() for code, test in rules.items()]
    faults = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests]))
    return rows.withColumn("faults", faults).drop("times")


def fold_reports(reports: DataFrame) -> DataFrame:
    """One summary per minute from all its reports: the latest one's values, but a replacement never regains punctuality."""
    rest = [c for c in reports.columns if c not in (*KEYS, "minute", "on_time")]
    merged = reports.groupBy(*KEYS, "minute").agg(
        F.max_by(F.struct(*rest), "received").alias("row"), F.min("on_time").alias("on_time")
    )
    return merged.select(*KEYS, "minute", "row.*", "on_time")


def upsert_summaries(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    return fold_reports(stored.unionByName(arrived))


# ------------------------------------------------------------------ freshness classes


def worst_gap_at(summaries: DataFrame, start: Column, end: Column) -> DataFrame:
    """Worst interval of each datum in [start, end): inside minutes, between them (from the last one before the window on)
    and up to ``end``. NULL without a summary before the window. One window per datum over the minutes of the window."""
    inside = summaries.where((F.col("minute") >= start) & (F.col("minute") < end))
    before = (
        summaries.where(F.col("minute") < start)
        .groupBy(*KEYS)
        .agg(F.max("minute").alias("minute"), F.max_by("last", "minute").alias("last"))
    )
    rows = inside.select(*KEYS, "minute", "first", "last", "max_gap_ms").unionByName(before, allowMissingColumns=True)
    since = _ms("first") - F.lag(_ms("last")).over(W.partitionBy(*KEYS).orderBy("minute"))
    gaps = rows.withColumn("gap", F.greatest(since, "max_gap_ms"))
    worst = gaps.groupBy(*KEYS).agg(
        F.max("gap").alias("gap"), F.max("last").alias("last"), F.count_if(F.col("first").isNull()).alias("covered")
    )
    return worst.select(*KEYS, F.when(F.col("covered") > 0, F.greatest("gap", _ms(end) - _ms("last"))).alias("worst_ms"))


def _sliding_hour(rows: DataFrame, along, columns: Sequence[str]) -> DataFrame:
    """Maximum of each column over the 60 rows that end at the current one, by doubling: 1, 2, 4 … 32 rows, then 32 + 28.

    A sliding frame would look at 60 rows for every row; this takes six look-backs of one row.
    """
    for back in (1, 2, 4, 8, 16, WINDOW_MIN - 32):
        rows = rows.withColumns({c: F.greatest(c, F.lag(c, back).over(along)) for c in columns})
    return rows


def minute_buckets(summaries: DataFrame) -> DataFrame:
    """What grading needs of the on-time summaries: the minute's number ``t`` and its figures."""
    return summaries.where(F.col("on_time") == 1).select(
        *KEYS,
        F.floor(F.unix_seconds("minute") / 60).alias("t"),
        _ms("first").alias("first_ms"),
        _ms("last").alias("last_ms"),
        "max_gap_ms",
        F.when(F.col("deliveries") > 0, F.col("delivery_latency_max_ms")).alias("delivered"),
        F.when(F.col("events") > 0, F.col("source_latency_max_ms")).alias("observed"),
    )


def classes_by_minute(
    summaries: DataFrame, data: DataFrame, checks: DataFrame, start: Column, end: Column, before: DataFrame | None = None
) -> DataFrame:
    """Class of every datum at every minute T in [start, end], from the on-time summaries of [T − 60 min, T).

    ``data(system, datum, source_kind, source_clock_ms, declared_latency_ms, via, check_url)`` declares the data;
    ``checks(system, datum, at, result)`` are the comparisons with the public face. Each datum is laid on the calendar of
    minutes, from two hours before ``start`` on, and every rule is a running aggregate or a look-back along it: partitions
    are as long as the evaluated span, whatever the number of refreshes. What is older comes in as one row per datum: from
    ``before``, the ``memory`` kept of earlier spans, and from the summaries that precede the calendar.

    The minute buckets are written once, as a table that grading reads several times; ``w_until`` is the end of the measured
    hour where that is not the current one (the delivery path without recent deliveries).
    """
    buckets = materialise(minute_buckets(summaries.where(F.col("minute") < end)), "buckets")
    first = F.floor(F.unix_seconds(start) / 60)
    origin, recent = first - 2 * WINDOW_MIN, first - WINDOW_MIN
    calendar = F.sequence(origin, F.floor(F.unix_seconds(end) / 60))
    failing = materialise(failing_checks(checks), "failing")
    grid = data.select(*KEYS).withColumn("t", F.explode(calendar))
    grid = grid.join(memory(buckets, failing, first, before), KEYS, "left")
    rows = grid.join(buckets, [*KEYS, "t"], "left").join(failing, [*KEYS, "t"], "left")
    along = W.partitionBy(*KEYS).orderBy("t")
    past = along.rowsBetween(W.unboundedPreceding, -1)
    seen_t = F.when(F.col("first_ms").isNotNull(), F.col("t"))
    rows = (
        rows.withColumn("prev_last", F.coalesce(F.last("last_ms", ignorenulls=True).over(past), "old_last"))
        .withColumn("first_t", F.least("old_first_t", F.min(seen_t).over(past)))
        .withColumn("failing", F.coalesce(F.last("failing", ignorenulls=True).over(along), "old_failing", F.lit(False)))
        .withColumn("gap", F.greatest(F.col("first_ms") - F.col("prev_last"), F.col("max_gap_ms")))
        .withColumn("delivers", F.col("delivered").isNotNull() & (F.col("t") >= recent))
        .drop("first_ms", "last_ms", "max_gap_ms", "old_last", "old_first_t", "old_failing")
    )
    rows = _sliding_hour(rows, along, ["gap", "delivered", "observed"])
    # Without deliveries in the hour, the last hour that had some counts, with the source latencies of that hour.
    hour = F.when(F.col("delivers"), F.struct("delivered", "observed", F.col("t").alias("last_t")))
    rows = rows.withColumns(
        {
            "gap": F.lag("gap").over(along),
            "push_now": F.lag("delivered").over(along),
            "source_now": F.lag("observed").over(along),
            "push_last": F.coalesce(F.last(hour, ignorenulls=True).over(past), "old_hour"),
        }
    ).drop("delivered", "observed", "delivers", "old_hour")
    rows = rows.where(F.col("t") >= first).join(data, KEYS)
    push = F.col("via") == "push"
    covered = F.col("first_t") < F.col("t") - WINDOW_MIN
    polled = F.when(covered, F.greatest("gap", F.col("t") * 60_000 - F.col("prev_last")))
    worst = F.when(push, F.coalesce("push_now", "push_last.delivered")).otherwise(polled)
    seen = F.when(push & F.col("push_now").isNull(), F.col("push_last.observed")).otherwise(F.col("source_now"))
    rows = rows.withColumn("w_ms", worst).withColumn("source_ms", seen)
    stale = F.when(push & F.col("push_now").isNull() & F.col("w_ms").isNotNull(), F.timestamp_seconds((F.col("push_last.last_t") + 1) * 60))
    rows = rows.withColumn("w_until", stale)
    # A source that is slower than declared raises the declaration for good.
    raised = F.max(F.when(F.col("w_ms").isNotNull(), F.col("source_ms"))).over(along)
    declared = F.when(F.col("declared_latency_ms").isNotNull(), F.greatest("declared_latency_ms", raised))
    rows = rows.withColumn("declared_ms", declared)
    # Of two grades the less fine one holds; an event source without a declared latency has no class.
    by_event = F.when(F.col("declared_latency_ms").isNull(), 3).otherwise(grade_of(F.coalesce("source_ms", "declared_ms")))
    bound = F.when(F.col("source_kind") == "event", by_event).otherwise(grade_of(F.col("source_clock_ms")))
    grade = F.greatest(grade_of(F.col("w_ms")), bound)
    unchecked = F.col("check_url").isNull() | F.col("failing")
    final = F.when(F.col("w_ms").isNull(), 4).when((grade < 3) & unchecked, 3).otherwise(grade)
    return rows.withColumn("grade", final).select(
        *KEYS, F.timestamp_seconds(F.col("t") * 60).alias("minute"), "w_ms", "w_until", "declared_ms", class_name(F.col("grade")).alias("class")
    )


def memory(buckets: DataFrame, failing: DataFrame, first: Column, before: DataFrame | None = None) -> DataFrame:
    """One row per datum with what grading from minute ``first`` on needs of the past, folded from the stored buckets and
    checks and from an earlier memory: last refresh, first minute and verdict of the checks (older than two hours), and the
    worst latencies of the last hour with deliveries (older than one)."""
    origin, recent = first - 2 * WINDOW_MIN, first - WINDOW_MIN
    old = F.col("t") < origin
    delivering = F.when((F.col("t") < recent) & F.col("delivered").isNotNull(), F.col("t"))
    folded = buckets.groupBy(*KEYS).agg(
        F.struct(F.max(F.when(old, F.col("t"))).alias("t"), F.max_by("last_ms", F.when(old, F.col("t"))).alias("ms")).alias("last"),
        F.min(F.when(old, F.col("t"))).alias("first_t"),
        F.max(delivering).alias("last_t"),
    )
    in_hour = (F.col("t") > F.col("last_t") - WINDOW_MIN) & (F.col("t") <= F.col("last_t"))
    hours = buckets.join(folded.where("last_t is not null").select(*KEYS, "last_t"), KEYS).where(in_hour)
    hours = hours.groupBy(*KEYS).agg(
        F.struct(F.max("delivered").alias("delivered"), F.max("observed").alias("observed"), F.max("last_t").alias("last_t")).alias("old_hour")
    )
    verdict = failing.where(old).groupBy(*KEYS).agg(F.max_by("failing", "t").alias("old_failing"))
    now = folded.join(hours, KEYS, "full_outer").join(verdict, KEYS, "full_outer")
    now = now.select(*KEYS, F.col("last.ms").alias("old_last"), F.col("first_t").alias("old_first_t"), "old_hour", "old_failing")
    if before is None:
        return now
    kept = before.select(*KEYS, *[F.col(c).alias(f"was_{c}") for c in MEMORY])
    both = now.join(kept, KEYS, "full_outer")
    return both.select(
        *KEYS,
        F.coalesce("old_last", "was_old_last").alias("old_last"),
        F.least("old_first_t", "was_old_first_t").alias("old_first_t"),
        F.coalesce("old_hour", "was_old_hour").alias("old_hour"),
        F.coalesce("old_failing", "was_old_failing").alias("old_failing"),
    )


def failing_checks(checks: DataFrame) -> DataFrame:
    """Per check (by the first minute T that sees it) whether it completes three failures in a row.

    A datum's checks are cut by day; a day hands the verdicts of its last checks on, so no datum is one task's work.
    """
    rows = checks.select(*KEYS, "at", "result", (F.col("result") != "coincide").alias("failed"))
    day, order = F.date_trunc("day", "at"), ["at", "result"]
    rows = with_previous(rows, KEYS, order, day, ["failed"], "one_")
    rows = with_previous(rows, KEYS, order, day, ["one_failed"], "two_")
    third = F.col("failed") & F.coalesce("one_failed", F.lit(False)) & F.coalesce("two_one_failed", F.lit(False))
    minute = (F.floor(F.unix_seconds("at") / 60) - GRACE_MIN).alias("t")
    return rows.withColumn("failing", third).groupBy(*KEYS, minute).agg(F.max_by("failing", F.struct("at", "result")).alias("failing"))


def raised_declarations(classes: DataFrame, data: DataFrame) -> DataFrame:
    """The log of raised declarations: each minute at which the declared latency of an event source grew, from what to what."""
    rows = classes.join(data.select(*KEYS, F.col("declared_latency_ms").alias("initial")), KEYS).where("initial is not null")
    earlier = F.lag("declared_ms").over(W.partitionBy(*KEYS).orderBy("minute"))
    rows = rows.withColumn("from_ms", F.coalesce(earlier, "initial"))
    return rows.where("declared_ms > from_ms").select(*KEYS, F.col("minute").alias("since"), "from_ms", F.col("declared_ms").alias("to_ms"))


def class_changes(classes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The change log: only the minutes at which the class differs from the one before.

    ``before(system, datum, class)`` is the class ahead of the first minute; without it there was no window.
    """
    earlier = F.lag("class").over(W.partitionBy(*KEYS).orderBy("minute"))
    rows = classes.withColumn("earlier", earlier)
    if before is not None:
        rows = rows.join(before.select(*KEYS, F.col("class").alias("initial")), KEYS, "left")
        rows = rows.withColumn("earlier", F.coalesce("earlier", "initial"))
    changed = rows.where(F.col("class") != F.coalesce("earlier", F.lit(NO_WINDOW)))
    return changed.select(*KEYS, F.col("minute").alias("since"), "class", "w_ms", "w_until")


def class_intervals(changes: DataFrame) -> DataFrame:
    """Change log → validity intervals; the open one ends at NULL."""
    until = F.lead("since").over(W.partitionBy(*KEYS).orderBy("since"))
    return changes.withColumn("until", until)


# ------------------------------------------------------------------ adhesion, users, throughput


def adhesion(summaries: DataFrame, start: Column, end: Column, before: DataFrame | None = None) -> DataFrame:
    """State of each system on each civil day in [start, end] (dates): verified after seven complete days with an on-time
    summary each, declared again after seven without any, otherwise as it was.

    ``before(system, state)`` are the states ahead of ``start``; a system without one begins as declared. The state is the
    last decisive day's verdict carried along the calendar: no state machine is needed.
    """
    first = F.date_sub(start, DAYS_TO_VERIFY)
    days = summaries.where("on_time = 1").select("system", civil_date("minute").alias("day")).where(F.col("day") >= first).distinct()
    systems = summaries.select("system")
    systems = (systems if before is None else systems.unionByName(before.select("system"))).distinct()
    grid = systems.withColumn("day", F.explode(F.sequence(first, end)))
    present = grid.join(days.withColumn("there", F.lit(1)), ["system", "day"], "left")
    along = W.partitionBy("system").orderBy("day")
    week = present.withColumn("week", F.count("there").over(along.rowsBetween(-DAYS_TO_VERIFY, -1))).where(F.col("day") >= start)
    verdict = F.when(F.col("week") >= DAYS_TO_VERIFY, "verificada").when(F.col("week") == 0, "declarada")
    carried = F.last(verdict, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0))
    rows = week.withColumn("carried", carried)
    if before is not None:
        rows = rows.join(before.select("system", F.col("state").alias("initial")), "system", "left")
    else:
        rows = rows.withColumn("initial", F.lit(None).cast("string"))
    return rows.select("system", "day", F.col("week").alias("days_on_time"), F.coalesce("carried", "initial", F.lit("declarada")).alias("state"))


def daily_users(reports: DataFrame, states: DataFrame, changes: DataFrame) -> DataFrame:
    """Reported users per system and civil day, with ``counts`` and the ``reason`` when they do not count.

    ``reports(system, day, users, data array)``; a report counts when its system is verified that day and at least one of
    its data was in class at some instant of the day.
    """
    asked = reports.select("system", "day", F.explode("data").alias("datum"))
    classed = in_class_on_days(changes, asked, KEYS, "since", "class", IN_CLASS, civil_date("since"))
    any_class = classed.groupBy("system", "day").agg(F.max("in_class").alias("in_class"))
    rows = reports.join(any_class, ["system", "day"], "left").join(states.select("system", "day", "state"), ["system", "day"], "left")
    verified = F.coalesce(F.col("state") == "verificada", F.lit(False))
    in_class = F.coalesce("in_class", F.lit(False))
    reason = F.when(~verified, "system not verified").when(~in_class, "no datum in class that day")
    return rows.select("system", "day", "users", (verified & in_class).alias("counts"), reason.alias("reason"))


def throughput(summaries: DataFrame, data: DataFrame, states: DataFrame, now: Column, minutes: int = 24 * 60) -> DataFrame:
    """Observations per minute over the last ``minutes``: only custodied and verified data of verified systems."""
    eligible = data.where("mode = 'custodiado' and verified_at is not null").join(
        states.where("state = 'verificada'").select("system"), "system", "left_semi"
    )
    recent = summaries.where((F.col("minute") >= now - _minutes(minutes)) & (F.col("minute") < now))
    total = recent.join(eligible.select(*KEYS), KEYS, "left_semi").agg(
        F.coalesce(F.sum("observations"), F.lit(0)).alias("observations")
    )
    return total.withColumn("per_minute", F.col("observations") / minutes)


def seen_versus_reported(seen: DataFrame, reported: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Public face against reports: the last refresh within five minutes and the counts within max(2, 20 %).

    ``seen(keys…, last, n)`` and ``reported(keys…, last, n)``; a face that says it saw nothing (``n`` = 0) agrees with a
    report of none, one that did not answer (``n`` NULL) with nothing.
    """
    rows = seen.select(*keys, F.col("last").alias("seen_last"), F.col("n").alias("seen_n")).join(
        reported.select(*keys, F.col("last").alias("reported_last"), F.col("n").alias("reported_n")), list(keys), "left"
    )
    told = F.coalesce("reported_n", F.lit(0))
    margin = F.greatest(F.lit(2), F.ceil(F.lit(0.2) * F.greatest(F.col("seen_n"), told)))
    close = F.abs(_ms("seen_last") - _ms("reported_last")) <= CHECK_TOLERANCE_MS
    agree = close & (F.abs(F.col("seen_n") - told) <= margin)
    silent = F.col("seen_last").isNull() & (F.col("seen_n") == 0)
    result = (
        F.when(F.col("seen_n").isNull(), "sin-respuesta")
        .when(F.when(silent, told == 0).otherwise(F.coalesce(agree, F.lit(False))), "coincide")
        .otherwise("no-coincide")
    )
    return rows.withColumn("margin", margin).withColumn("result", result)


def audit(log: DataFrame, pulse: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Two minute logs compared: equal, different, only in one; one row per verdict with its minutes."""
    left = log.select("minute", F.struct(*fields).alias("a"))
    right = pulse.select("minute", F.struct(*fields).alias("b"))
    verdict = (
        F.when(F.col("b").isNull(), "only_log").when(F.col("a").isNull(), "only_pulse").when(F.col("a") == F.col("b"), "equal")
    ).otherwise("different")
    return left.join(right, "minute", "full_outer").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("minutes"))


def punctual_share(summaries: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Minutes reported, those on time, and their share in percent."""
    rows = summaries.groupBy(*by).agg(F.count(F.lit(1)).alias("minutes"), F.count_if(F.col("on_time") == 1).alias("punctual"))
    return rows.withColumn("punctual_pct", 100 * F.col("punctual") / F.col("minutes"))

"""The pulse as a stream: minute summaries with a watermark, new-observation detection, and the class job per micro-batch.

Rules live in ``censora.plans.pulse``; the stream adds watermark, trigger, sink and checkpoint. A job keeps everything in the
store it is given, checkpoint included: a restarted driver that names the same store goes on from the last committed batch,
and a batch that is repeated replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censora.plans import pulse
from censora.session import shared_dir

# Fixed value: reports older than this are not accepted, so no state needs to be kept for longer.
LATEST = "24 hours"

STATE = f"system string, datum string, class string, declared_ms bigint, minute timestamp, {pulse.MEMORY_DDL}"
CHANGES = "system string, datum string, since timestamp, class string, w_ms bigint, w_until timestamp"


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str, files: int = 64) -> DataFrame:
    """Files of ``folder`` that match ``pattern`` as a stream, at most ``files`` per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def summary_stream(events: DataFrame) -> DataFrame:
    """``events(system, datum, at, …)`` → minute summaries, emitted when the watermark has passed their minute.

    The longest gap is exact, so an open minute keeps its distinct milliseconds (60,000 at most, however many events); update
    mode allows one grouping only, which rules out folding them by seconds first.
    """
    window = F.window("at", "1 minute").alias("w")
    grouped = (
        events.withWatermark("at", LATEST)
        .groupBy(*pulse.KEYS, window)
        .agg(*pulse.summary_columns(extras=events.columns), *([F.max("received").alias("received")] if "received" in events.columns else []))
    )
    keyed = grouped.select(*pulse.KEYS, F.col("w.start").alias("minute"), *[c for c in grouped.columns if c not in (*pulse.KEYS, "w")])
    return pulse.with_inner_gap(keyed)


def run_available(stream: DataFrame, store: str, keys: list[str] | None = None) -> DataFrame:
    """Process what is there, then stop: the sink's rows as a batch frame. ``store`` keeps rows and checkpoint.

    Append mode writes rows as they become final. With ``keys`` the sink is kept current in update mode: every micro-batch is
    written on its own, and the latest version of each row wins on reading; ``compact`` folds them.
    """
    spark, target = stream.sparkSession, f"{store}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True)
    if keys is None:
        writer.format("parquet").outputMode("append").option("path", target).start().awaitTermination()
        return read_written(spark, target, stream.schema)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/n={number}")

    writer.outputMode("update").foreachBatch(keep).start().awaitTermination()
    return latest_batch(read_written(spark, f"{target}/n=*", T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])), keys)


def compact(spark: SparkSession, store: str, schema: T.StructType, keys: list[str], into: str) -> DataFrame:
    """The current rows of an update-mode store as one stored table in the new folder ``into``."""
    versions = read_written(spark, f"{store}/rows/n=*", T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())]))
    latest_batch(versions, keys).write.parquet(into)
    return spark.read.schema(schema).parquet(into)


def read_written(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What a sink wrote; nothing when no batch ran."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every row of an update-mode sink."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return best.select(*keys, "row.*")


def first_seen_job(events: DataFrame, keys: list[str], store: str) -> DataFrame:
    """The first delivery of each observation; returns all that were seen. Keys are kept for good.

    Every micro-batch drops its own repeats and then those that earlier batches stored, by an anti-join on the keys.
    """
    spark, seen = events.sparkSession, f"{store}/seen"

    def keep(batch: DataFrame, number: int) -> None:
        known = read_written(spark, f"{seen}/batch=*", batch.schema)
        # A repeated batch must not find its own rows.
        earlier = known.where(F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1).cast("long") < number) if number and not known.isEmpty() else known.limit(0)
        batch.dropDuplicates(keys).join(earlier.select(*keys), keys, "left_anti").write.mode("overwrite").parquet(f"{seen}/batch={number}")

    writer = events.writeStream.option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return read_written(spark, f"{seen}/batch=*", events.schema)


def class_job(reports: DataFrame, data: Callable[[], DataFrame], checks: Callable[[], DataFrame], store: str) -> DataFrame:
    """Grade a stream of reported minute summaries; returns the change log it wrote below ``store``.

    Reports come in order of arrival. Every micro-batch adds its reports to a log by hour, folds the last hours of it with
    the upsert rule and grades the minutes that have come due: up to the latest arrival minus the grace. Minutes that were
    graded stay as they are. What is needed of the past (class, raised latency, last minute, the memory of older refreshes,
    deliveries and checks) is a state table with one row per datum, written by every batch; before the first graded minute it
    is empty. ``data`` and ``checks`` are read anew in every batch, so later checks and declarations are seen.
    """
    spark = reports.sparkSession
    log, states, changes = (f"{store}/{name}" for name in ("log", "state", "changes"))

    def handle(batch: DataFrame, number: int) -> None:
        arrived = pulse.with_punctuality(batch).where("status <> 'rejected'").drop("status")
        hour = F.date_format("minute", "yyyyMMddHH").alias("hour")
        stamped = arrived.select("*", hour, F.lit(number).alias("batch"))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(log)
        last = read_written(spark, f"{states}/batch={number - 1}", STATE) if number else spark.createDataFrame([], STATE)
        graded_to = last.agg(F.max("minute")).first()[0]
        everything = read_written(spark, log, T.StructType([*arrived.schema.fields, T.StructField("hour", T.StringType()), T.StructField("batch", T.IntegerType())]))
        ends = everything.where(F.col("batch") <= number).agg(
            F.date_trunc("minute", F.min("minute")).alias("lo"), F.date_trunc("minute", F.max("received")).alias("hi")
        )
        seen = ends.first() if graded_to is None else arrived.agg(F.lit(None).cast("timestamp").alias("lo"), F.date_trunc("minute", F.max("received")).alias("hi")).first()
        due = False
        if seen.hi is not None:
            until = F.lit(seen.hi) - F.make_dt_interval(mins=F.lit(pulse.GRACE_MIN))
            since = F.lit(seen.lo) if graded_to is None else F.lit(graded_to) + F.make_dt_interval(mins=F.lit(1))
            due = spark.range(1).select((since <= until).alias("due")).first().due
        if not due:
            last.write.mode("overwrite").parquet(f"{states}/batch={number}")
            return
        # The calendar begins two hours before the first minute that is due; older summaries are in the state.
        origin = since - F.make_dt_interval(mins=F.lit(2 * pulse.WINDOW_MIN))
        recent = everything.where((F.col("hour") >= F.date_format(origin, "yyyyMMddHH")) & (F.col("batch") <= number)).drop("hour", "batch")
        if graded_to is not None:
            recent = recent.where(F.col("minute") >= origin)
        summaries = pulse.fold_reports(recent)
        declared = data()
        raised = last.select(*pulse.KEYS, "declared_ms")
        known = declared.join(raised, pulse.KEYS, "left").withColumn("declared_latency_ms", F.greatest("declared_latency_ms", "declared_ms")).drop("declared_ms")
        memory = last.select(*pulse.KEYS, *pulse.MEMORY)
        path = f"{store}/graded/batch={number}"
        heard = checks()
        pulse.classes_by_minute(summaries, known, heard, since, until, memory).write.mode("overwrite").parquet(path)
        graded = spark.read.parquet(path)
        pulse.class_changes(graded, last).write.mode("overwrite").parquet(f"{changes}/batch={number}")
        tail = graded.groupBy(*pulse.KEYS).agg(F.max_by(F.struct("class", "declared_ms", "minute"), "minute").alias("row"))
        buckets = pulse.minute_buckets(summaries.where(F.col("minute") < until + F.make_dt_interval(mins=F.lit(1))))
        following = F.floor(F.unix_seconds(until) / 60) + 1
        kept = pulse.memory(buckets, pulse.failing_checks(heard), following, memory)
        state = tail.select(*pulse.KEYS, "row.*").join(kept, pulse.KEYS, "left")
        state.write.mode("overwrite").parquet(f"{states}/batch={number}")

    writer = reports.writeStream.option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(handle).start().awaitTermination()
    return read_written(spark, f"{changes}/batch=*", CHANGES)


def fresh_store(spark: SparkSession, label: str) -> str:
    """A new store below the shared folder, for a job that is not meant to go on later."""
    return shared_dir(spark, label)

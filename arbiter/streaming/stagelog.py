"""Stage events as Structured Streaming queries (X5, streaming forms): windowed roll-up and span pairing.

Events stream in from parquet files; an event-time watermark bounds state and
a tumbling window counts events and sums durations per stage.  Results go to
a parquet table in the cluster's checkpoint folder through ``foreachBatch``
(idempotent overwrite per batch, so a replayed batch after a lost executor
writes the same table), and the finished table is read back as a batch frame.

Spans are paired by a stream-stream outer join: the start and the end events
each carry a watermark, and an end may come at most ``max_span`` after its start, so the
state holds open spans of that time only.  A span without an end, or an end without a start,
comes out when the watermark passes.  A log that is closed gets a closing mark
in event time, which lets its last open spans out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.session import ensure_checkpoint_dir

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed_stage_counts(events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Per (window, stage): events, summed duration (ms) and errors; works on batch and streaming frames."""
    # Watermarks need an instant type: the wall-clock column is read in the
    # session time zone (UTC on the cluster) and windows are rendered back.
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", window).alias("w"), F.col("event_type").alias("stage"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum(F.round(F.col("value") * 1000)).alias("total_ms"),
            F.count_if(F.col("event_type") == "error").alias("n_errors"),
        )
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("w.end").cast("timestamp_ntz").alias("window_end"), "stage",
                F.col("n_events").cast("long"), F.col("total_ms").cast("double"), F.col("n_errors").cast("long"))
    )


def _event_stream(spark: SparkSession, events_path: str, schema: str) -> DataFrame:
    """The event files one by one; as a pattern the path may name one file or a folder of files."""
    name = events_path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{name[:-1]}[{name[-1]}]")


def run_stream(spark: SparkSession, events_path: str, window: str = "1 hour") -> DataFrame:
    """Drive the streaming roll-up over every available event file, then return its result table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex
    out_path = f"{base}/arbiter-stagelog-{run}/table"
    ckpt = f"{base}/arbiter-stagelog-{run}/checkpoint"
    stream = _event_stream(spark, events_path, EVENT_SCHEMA)
    agg = windowed_stage_counts(stream, window)

    def write(batch: DataFrame, epoch: int) -> None:
        # A replayed epoch writes its own folder again; nothing else is touched.
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = agg.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(write).trigger(
        availableNow=True
    ).start()
    q.awaitTermination()
    # Update mode: only changed windows are written, and state behind the watermark is dropped; the last epoch of a window holds.
    keys = ["window_start", "window_end", "stage"]
    table = spark.read.parquet(out_path)
    rest = [c for c in table.columns if c not in (*keys, "epoch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last")).select(*keys, "last.*")


SPAN = "run_id, stage, attempt, start_ts, end_ts, error_class, n_items, duration_ms".split(", ")


def paired_spans(starts: DataFrame, ends: DataFrame, max_span: str = "1 hour") -> DataFrame:
    """(run_id, stage, attempt, start_ts, end_ts, error_class, n_items, duration_ms) from two event streams.

    ``starts`` (run_id, stage, attempt, event_time) and ``ends`` (these, error_class,
    n_items) have watermarks on ``event_time``; attempts are unique in a run and stage.
    """
    s = starts.select("run_id", "stage", "attempt", F.col("event_time").alias("start_time"))
    e = ends.select(F.col("run_id").alias("r"), F.col("stage").alias("g"), F.col("attempt").alias("a"), F.col("event_time").alias("end_time"), "error_class", "n_items")
    same = (F.col("run_id") == F.col("r")) & (F.col("stage") == F.col("g")) & (F.col("attempt") == F.col("a"))
    in_time = (F.col("end_time") >= F.col("start_time")) & (F.col("end_time") <= F.col("start_time") + F.expr(f"INTERVAL {max_span}"))
    return s.join(e, same & in_time, "full_outer").select(
        F.coalesce("run_id", "r").alias("run_id"), F.coalesce("stage", "g").alias("stage"), F.coalesce("attempt", "a").alias("attempt"),
        F.col("start_time").cast("timestamp_ntz").alias("start_ts"), F.col("end_time").cast("timestamp_ntz").alias("end_ts"), "error_class", "n_items",
        ((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000.0).alias("duration_ms"),
    )


def run_span_stream(
    spark: SparkSession, events_path: str, derive: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    watermark: str = "10 minutes", max_span: str = "1 hour", schema: str = EVENT_SCHEMA, close: bool = True,
) -> DataFrame:
    """Pair the spans of every available event file; ``derive`` makes (start events, end events) of raw events, with ``ts``.

    With ``close`` the log is taken to be complete: the query then goes on from
    its checkpoint over one closing mark, beyond every event's time.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arbiter-spans-{uuid.uuid4().hex}"
    marks = "closes timestamp"
    spark.createDataFrame([], marks).write.parquet(f"{base}/marks")
    raw = _event_stream(spark, events_path, schema)
    closing = spark.readStream.schema(marks).parquet(f"{base}/marks").where("closes IS NOT NULL")

    def timed(side: DataFrame) -> DataFrame:
        known = side.withColumn("event_time", F.col("ts").cast("timestamp")).drop("ts").withColumn("mark", F.lit(False))
        mark = closing.select(F.col("closes").alias("event_time"), F.lit(True).alias("mark"))
        both = known.unionByName(mark, allowMissingColumns=True).withWatermark("event_time", watermark)
        # The mark moves the watermark and goes no further; the time in the condition keeps the filter behind the watermark.
        return both.where(F.when(F.col("event_time").isNotNull(), ~F.col("mark")))

    spans = paired_spans(*(timed(side) for side in derive(raw)), max_span)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/spans/epoch={epoch}")

    def drive() -> None:
        q = spans.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()

    drive()
    if close:
        last = spark.read.schema(schema).parquet(events_path).agg(F.max("ts").cast("timestamp").alias("t"))
        end = F.col("t") + F.expr(f"INTERVAL {max_span}") * 3 + F.expr(f"INTERVAL {watermark}")
        last.select(end.alias("closes")).where("closes IS NOT NULL").write.mode("append").parquet(f"{base}/marks")
        drive()
    return spark.read.parquet(f"{base}/spans").select(*SPAN)

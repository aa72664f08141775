"""Streaming jobs. Each takes a streaming DataFrame and returns the started query.

Sinks are idempotent: a batch that is run again after a failure writes the same
rows to the same place, keyed by the batch id.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mendwell.operators import diagnosis, incidents, remediation
from mendwell.operators.context import context_bundle
from mendwell.sources.files import write_partitions
from mendwell.streaming.state import StateLog

KEYS = ["year", "month"]


def file_stream(spark: SparkSession, root: str, schema: StructType, glob: str = "*.parquet", files: int = 1000) -> DataFrame:
    """Files as they appear below ``root``, at most ``files`` per batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files)
    return reader.parquet(root)


def _start(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace the batch's own folder, so a repeated batch leaves one copy."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")


def landing_stream(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Catch up on new partitioned files, once each, below ``root/batch_id=``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_partitions(batch.withColumn("batch_id", F.lit(batch_id)), root, ["batch_id", *KEYS], replace=True)

    return _start(stream, checkpoint, sink)


FOLD = StructType([StructField("run_id", StringType()), *[StructField(c, StructType([StructField("seq", LongType()), StructField("value", StringType())])) for c in incidents.FOLDED]])


def fold_state(spark: SparkSession, path: str) -> StateLog:
    """What the incident stream has folded so far, one row per run."""
    return StateLog(spark, path, FOLD, ("run_id",), incidents.merge_folds)


def incident_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold each batch of log lines to one row per run.

    A run may log over several batches, so its incident is only known from the
    merged folds, which are kept as compacted state: see :func:`streamed_incidents`.
    """
    state = fold_state(log.sparkSession, path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        state.write(incidents.partial_fold(batch), batch_id)

    return _start(log, checkpoint, sink)


def streamed_incidents(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """Incidents of everything the incident stream has written so far."""
    return incidents.incidents_of(runs, fold_state(spark, path).read())


def diagnosis_stream(
    opened: DataFrame,
    responses: DataFrame,
    flags: DataFrame,
    manifest: DataFrame,
    generated_at: datetime,
    path: str,
    checkpoint: str,
    gather: Callable[[DataFrame], DataFrame] = context_bundle,
) -> StreamingQuery:
    """Diagnose every newly opened incident once and write its report.

    ``gather`` adds the context to the incidents of a batch; by default there is none.
    A flag that an earlier batch cleared is not active for the later ones.
    """

    spark = opened.sparkSession
    cleared = cleared_flags(spark, path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        active = active_flags(flags, path, batch_id)
        _write_batch(diagnosed_reports(batch, responses, active, manifest, generated_at, gather), path, batch_id)
        written = spark.read.parquet(f"{path}/batch_id={batch_id}")
        cleared.write(written.select(F.col("cleared_flag").alias("flag")).dropna().distinct(), batch_id)

    return _start(opened, checkpoint, sink)


def cleared_flags(spark: SparkSession, path: str) -> StateLog:
    """The flags that batches have cleared; readers of the reports pass over the folder."""
    return StateLog(spark, f"{path}/_cleared", StructType([StructField("flag", StringType())]), ("flag",), lambda flags: flags.distinct(), buckets=1)


def active_flags(flags: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Flags that no batch before ``batch_id`` has cleared."""
    return flags.join(cleared_flags(flags.sparkSession, path).read(batch_id - 1), "flag", "left_anti")


def diagnosed_reports(
    opened: DataFrame,
    responses: DataFrame,
    flags: DataFrame,
    manifest: DataFrame,
    generated_at: datetime,
    gather: Callable[[DataFrame], DataFrame] = context_bundle,
) -> DataFrame:
    classified = incidents.classify(opened)
    diagnosed = diagnosis.diagnose(classified, responses, remediation.ALLOWLIST)
    decided = remediation.decide_actions(diagnosed, flags, manifest)
    return diagnosis.build_reports(gather(decided), generated_at, keep=["cleared_flag"])


def streamed_fixes(spark: SparkSession, path: str, last_seq: int) -> DataFrame:
    """State changes that stamp the fixes of all reports written so far, numbered after ``last_seq`` by batch."""
    at = F.get_json_object("report", "$.generated_at").cast("timestamp_ntz")
    return diagnosis.proposed_fixes(spark.read.parquet(path), F.col("batch_id").cast("bigint") + last_seq + 1, at)


def window_totals(
    events: DataFrame, labels: list[str], size: str, slide: str, value: Column | None = None, watermark: str = "7 days"
) -> DataFrame:
    """Sliding totals with late data accepted up to the watermark, each window once it is closed.

    Two aggregations in a row: events are summed into slide-wide windows, and only these sums are
    spread over the sliding windows they lie in. The watermark evicts the state of both.
    """
    # Watermarks need a zoned timestamp; the session zone is UTC.
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    amount = F.lit(1) if value is None else value
    steps = zoned.groupBy(F.window("ts", slide), *labels).agg(F.sum(amount).alias("part"))
    summed = steps.groupBy(F.window(F.window_time("window"), size, slide), *labels).agg(F.sum("part").alias("total"))
    return summed.select(*labels, F.col("window.start").cast("timestamp_ntz").alias("window_start"), "total")


def end_marker(events: DataFrame, after: str = "30 days") -> DataFrame:
    """One event without labels, so much later than all others that it closes their windows when it has passed through."""
    late = (F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts")
    return events.agg(late).select(*[F.col(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])


def metric_stream(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the windows that each batch closes, once each."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, path, batch_id)

    return _start(totals, checkpoint, sink)


def latest_windows(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """All windows closed so far."""
    return spark.read.parquet(path).select(*labels, "window_start", "total")


def lateness_stream(samples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Split arriving samples into accepted and rejected ones by their age on arrival."""
    from mendwell.operators.metrics import sample_lateness

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(sample_lateness(batch), path, batch_id)

    return _start(samples, checkpoint, sink)

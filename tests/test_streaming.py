from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mendwell.operators import incidents, metrics
from mendwell.plans import catalog
from mendwell.streaming import jobs
from mendwell.streaming.state import StateLog

EVENTS = "ts TIMESTAMP_NTZ, label STRING, year INT, month INT"


@pytest.fixture
def source(spark, tmp_path):
    """A folder that files can be added to, and a stream over it."""
    root = str(tmp_path / "in")

    def add(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        return root

    return add


def paths(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_landing_catches_up_once(spark, tmp_path, source):
    out, checkpoint = paths(tmp_path)
    root = source([(datetime(2024, 1, 1), "a", 2024, 1)], EVENTS)
    schema = spark.read.parquet(root).schema

    def poll():
        jobs.landing_stream(jobs.file_stream(spark, root, schema), out, checkpoint).awaitTermination()
        return spark.read.parquet(out).count()

    assert poll() == 1
    assert poll() == 1  # nothing new
    source([(datetime(2024, 2, 1), "a", 2024, 2)], EVENTS)
    assert poll() == 2


LOG = "run_id STRING, seq BIGINT, asset_key STRING, is_failure BOOLEAN, error_type STRING, error_message STRING, stack_trace STRING"


def test_incidents_of_runs_that_log_over_several_batches(spark, tmp_path, source):
    out, checkpoint = paths(tmp_path)
    lines = [
        [("r1", 1, "bronze/a", True, "First", "one", "s"), ("r2", 1, None, True, "X", "x", "x")],
        [("r1", 2, None, True, "Second", "", "s2"), ("r2", 2, "bronze/b", False, None, None, None)],
    ]
    runs = spark.createDataFrame(
        [("r1", "j", "FAILURE", None, datetime(2024, 1, 1)), ("r2", "j", "FAILURE", None, datetime(2024, 1, 1))],
        "run_id STRING, job_name STRING, status STRING, partition_key STRING, ended_at TIMESTAMP_NTZ",
    )
    for batch in lines:
        root = source(batch, LOG)
        stream = jobs.file_stream(spark, root, spark.read.parquet(root).schema)
        jobs.incident_stream(stream, out, checkpoint).awaitTermination()
    streamed = jobs.streamed_incidents(spark, out, runs).drop("recent_metadata")
    batch = incidents.capture_incidents(runs, spark.read.parquet(root)).drop("recent_metadata")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert {r.error_type for r in streamed.collect()} == {"Second", "X"}


def test_diagnosis_ticks_once_per_incident(spark, tmp_path, source):
    out, checkpoint = paths(tmp_path)
    schema = "incident_id STRING, created_at TIMESTAMP_NTZ, asset_key STRING, partition_key STRING, error_type STRING, error_message STRING"
    rows = [(i, datetime(2024, 1, 1), "bronze/tlc_yellow", "2024-01-01", "HTTPStatusError", "503") for i in ("a", "b", "c")]
    root = source(rows, schema)
    good = '{"category": "infra", "root_cause": "x", "proposed_fix": "retry-with-backoff", "confidence": 1, "can_auto_remediate": true}'
    # One reply is missing and one is invalid: both still get a report.
    responses = spark.createDataFrame([("a", good), ("b", "nonsense")], "incident_id STRING, response STRING")
    flags = spark.createDataFrame([("tlc_5xx",)], "flag STRING")
    manifest = spark.createDataFrame([], "dataset STRING, partition_key STRING, path STRING, rows BIGINT")
    for _ in range(2):
        stream = jobs.file_stream(spark, root, spark.read.parquet(root).schema)
        jobs.diagnosis_stream(stream, responses, flags, manifest, datetime(2024, 1, 2), out, checkpoint).awaitTermination()
    status = F.get_json_object("report", "$.proposed_action.status")
    found = {r.incident_id: r.s for r in spark.read.parquet(out).select("incident_id", status.alias("s")).collect()}
    assert found == {"a": "executed", "b": "skipped", "c": "skipped"}
    assert spark.read.parquet(out).count() == 3
    # A later tick no longer finds the flag that the first one cleared.
    source([("d", *rows[0][1:])], schema)
    more = responses.unionByName(spark.createDataFrame([("d", good)], responses.schema))
    stream = jobs.file_stream(spark, root, spark.read.parquet(root).schema)
    jobs.diagnosis_stream(stream, more, flags, manifest, datetime(2024, 1, 3), out, checkpoint).awaitTermination()
    cleared = {r.incident_id: r.cleared_flag for r in spark.read.parquet(out).collect()}
    assert cleared == {"a": "tlc_5xx", "b": None, "c": None, "d": None}


def test_streamed_reports_have_the_context_of_the_batch_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    counts = ["upstream_count", "recent_run_count", "similar_incident_count"]
    found = [F.get_json_object("report", f"$.context_summary.{c}").cast("bigint").alias(c) for c in counts]
    streamed = catalog._stream_reports(spark, sf_dir).select("incident_id", *found)
    batch = catalog.QUERIES["reports"](spark, sf_dir).select("incident_id", *counts)
    rows = sorted(map(tuple, streamed.collect()))
    assert rows == sorted(map(tuple, batch.collect()))
    assert all(sum(r[k] for r in rows) > 0 for k in (1, 2, 3))


def test_fixes_of_streamed_reports_are_stamped(spark, tmp_path):
    out, _ = paths(tmp_path)
    at = datetime(2024, 1, 2)
    for batch_id, row in enumerate([("a", '{"diagnosis":{"proposed_fix":"retry"},"generated_at":"2024-01-02T00:00:00"}'), ("b", '{"diagnosis":{},"generated_at":"2024-01-02T00:00:00"}')]):
        jobs._write_batch(spark.createDataFrame([row], "incident_id STRING, report STRING"), out, batch_id)
    fixes = jobs.streamed_fixes(spark, out, 7)
    assert sorted(map(tuple, fixes.collect())) == [("a", 8, "fix", at, "retry"), ("b", 9, "fix", at, "")]
    opened = spark.createDataFrame([("a",), ("b",), ("c",)], "incident_id STRING")
    waiting = incidents.undiagnosed(incidents.incident_state(opened, fixes))
    assert sorted(r.incident_id for r in waiting.collect()) == ["b", "c"]


def test_streamed_windows_equal_batch(spark, tmp_path, source):
    out, checkpoint = paths(tmp_path)
    days = [1, 2, 3]
    for day in days:
        rows = [(datetime(2024, 1, day, 0, m), "ab"[m % 2], 2024, 1) for m in range(10)]
        rows.append((datetime(2024, 1, 1, 0, 1), "a", 2024, 1))  # late, but within the watermark
        root = source(rows, EVENTS)
        stream = jobs.file_stream(spark, root, spark.read.parquet(root).schema)
        totals = jobs.window_totals(stream, ["label"], "5 minutes", "1 minute")
        jobs.metric_stream(totals, out, checkpoint).awaitTermination()
    closed = jobs.latest_windows(spark, out, ["label"])
    assert closed.isEmpty()  # All lie within the watermark.
    end = jobs.end_marker(spark.read.parquet(root))
    source([tuple(end.first())], EVENTS)
    stream = jobs.file_stream(spark, root, spark.read.parquet(root).schema)
    jobs.metric_stream(jobs.window_totals(stream, ["label"], "5 minutes", "1 minute"), out, checkpoint).awaitTermination()
    streamed = jobs.latest_windows(spark, out, ["label"])
    batch = metrics.sliding_sum(spark.read.parquet(root).filter("label IS NOT NULL"), ["label"], 300, 60)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_no_event_is_spread_over_windows(spark, tmp_path, source):
    root = source([(datetime(2024, 1, 1), "a", 2024, 1)], EVENTS)
    events = spark.read.parquet(root)
    text = jobs.window_totals(events, ["label"], "5 minutes", "1 minute")._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Expand") + 1 :] if "Expand" in text else text[text.rindex("Aggregate") + 1 :]
    assert "Aggregate" in text and text.count("Expand") <= 1 and ("Expand" not in text or "Aggregate" in below)


def test_late_samples_are_marked(spark, tmp_path, source):
    out, checkpoint = paths(tmp_path)
    root = source([(datetime(2024, 1, 1), datetime(2024, 1, 2)), (datetime(2024, 1, 1), datetime(2024, 2, 2))],
                  "ts TIMESTAMP_NTZ, arrived_at TIMESTAMP_NTZ")
    stream = jobs.file_stream(spark, root, spark.read.parquet(root).schema)
    jobs.lateness_stream(stream, out, checkpoint).awaitTermination()
    assert sorted(r.rejected for r in spark.read.parquet(out).collect()) == [False, True]


def test_state_reads_stay_constant_over_many_batches(spark, tmp_path):
    from pathlib import Path

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("key", StringType()), StructField("n", LongType())])
    log = StateLog(spark, str(tmp_path / "state"), schema, ("key",), lambda d: d.groupBy("key").agg(F.max("n").alias("n")), buckets=2, every=5)
    sizes, expected = [], {}
    for batch in range(50):
        rows = [(f"k{k}", batch * 10 + k) for k in range(3)]
        expected |= dict(rows)
        log.write(spark.createDataFrame(rows, schema).coalesce(1), batch)
        held = log._scan([p for _, p in log._snapshots().values()] + list(log._deltas(None).values()))
        sizes.append(sum(Path(f.removeprefix("file://")).stat().st_size for f in held.inputFiles()))
        if batch in (4, 5, 6, 12, 49):
            assert {r.key: r.n for r in log.read().collect()} == expected
            assert {r.n for r in log.read(batch - 1).collect()} == {(batch - 1) * 10 + k for k in range(3)}
    assert max(sizes[40:]) <= max(sizes[5:15]) * 1.05
    # A batch that is run again replaces its delta, whether or not those before it were compacted meanwhile.
    log.write(spark.createDataFrame([("k0", 1_000)], schema), 49)
    log.compact(48)
    log.write(spark.createDataFrame([("k0", 2_000)], schema), 49)
    assert {r.key: r.n for r in log.read().collect()} == {"k0": 2_000, "k1": 481, "k2": 482}

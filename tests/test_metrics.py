from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mendwell.operators import metrics, retries


@pytest.fixture
def events(spark):
    rows = [(datetime(2024, 1, 1, 0, m, s), "a", v) for m, s, v in [(0, 0, 1), (0, 59, 2), (4, 0, 3), (20, 0, 4)]]
    rows.append((datetime(1969, 12, 31, 23, 59, 59, 500000), "old", 1))
    return spark.createDataFrame(rows, "ts TIMESTAMP_NTZ, asset STRING, n INT")


@pytest.mark.parametrize(("size", "slide"), [(300, 60), (600, 300), (60, 60)])
def test_sliding_sums_equal_spark_windows(events, size, slide):
    ours = metrics.sliding_sum(events, ["asset"], size, slide, F.col("n"))
    window = F.window(F.col("ts"), f"{size} seconds", f"{slide} seconds")
    plain = events.groupBy("asset", window.alias("w")).agg(F.sum("n").alias("total"))
    plain = plain.select("asset", F.col("w.start").alias("window_start"), "total")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_window_must_be_a_multiple_of_the_slide(events):
    with pytest.raises(ValueError):
        metrics.sliding_sum(events, ["asset"], 100, 60)


def test_rate_divides_by_the_window(events):
    rates = metrics.rate(events.filter("asset = 'a'"), ["asset"], 300, 300)
    assert sorted(r.rate for r in rates.collect()) == [1 / 300, 3 / 300]


def test_events_are_summed_before_they_are_spread(events, plan):
    text = plan(metrics.sliding_sum(events, ["asset"], 300, 60))
    spread = text.index("Generate explode")
    assert "partial_sum" in text[spread:]


def test_histogram_and_quantile(spark):
    values = [0.5] * 10 + [3.0] * 80 + [50.0] * 10
    df = spark.createDataFrame([("s", v) for v in values] + [("big", 1000.0), ("one", 0.1)], "source STRING, seconds DOUBLE")
    buckets = metrics.bucket_counts(df, ["source"], "seconds")
    cumulative = [r.cumulative for r in buckets.filter("source = 's'").orderBy("bucket").collect()]
    assert cumulative == [10, 10, 10, 90, 90, 90, 100, 100, 100, 100]
    found = {r.source: r.quantile for r in metrics.histogram_quantile(buckets, ["source"], 0.95).collect()}
    assert found["s"] == pytest.approx(30 + 30 * 5 / 10)
    assert found["big"] == 300.0  # the open bucket gives the largest bound
    assert found["one"] == pytest.approx(0.475)


def test_pass_rate_and_top_failing(spark):
    rows = [("c1", "pass"), ("c1", "fail"), ("c2", "fail"), ("c2", "fail"), ("c3", "pass")]
    df = spark.createDataFrame(rows, "check_name STRING, result STRING")
    assert metrics.pass_rate(df, []).first().pass_rate == 0.4
    assert metrics.pass_rate(df.limit(0), []).first().pass_rate is None
    assert [tuple(r) for r in metrics.top_failing(df, 1).collect()] == [("c2", 2)]


def test_landing_totals_and_ticks(spark):
    df = spark.createDataFrame([("a", "ok", 5), ("a", "ok", 7), ("a", "skipped", None)], "asset STRING, status STRING, rows BIGINT")
    assert {tuple(r) for r in metrics.landing_totals(df).collect()} == {("a", "ok", 2, 12), ("a", "skipped", 1, None)}
    ticks = spark.createDataFrame([(False, "executed"), (False, "skipped"), (True, "skipped")], "failed BOOLEAN, action_status STRING")
    assert tuple(metrics.tick_summary(ticks, []).first()) == (2, 1, 1)


def test_error_lines_match_whole_container_names(spark):
    rows = [("worker-1", "ERROR x"), ("worker-1", "fine"), ("my-worker-1", "error"), ("worker-2", "an error")]
    df = spark.createDataFrame(rows, "container STRING, line STRING")
    assert metrics.error_lines(df, "worker.*").count() == 2


def test_lateness(spark):
    rows = [(datetime(2024, 1, 1), datetime(2024, 1, 8)), (datetime(2024, 1, 1), datetime(2024, 1, 8, 0, 0, 1))]
    df = spark.createDataFrame(rows, "ts TIMESTAMP_NTZ, arrived_at TIMESTAMP_NTZ")
    assert [r.rejected for r in metrics.sample_lateness(df).collect()] == [False, True]


def test_retryability(spark):
    rows = [("timeout", None), ("network", None), ("status", 500), ("status", 429), ("status", 404), ("other", None)]
    df = spark.createDataFrame(rows, "kind STRING, status INT")
    flags = [r.r for r in df.select(retries.fetch_retryable(F.col("kind"), F.col("status")).alias("r")).collect()]
    assert flags == [True, True, True, True, False, False]
    names = spark.createDataFrame([("RateLimitError",), ("AuthenticationError",), (None,)], "n STRING")
    assert [r.r for r in names.select(retries.model_retryable(F.col("n")).alias("r")).collect()] == [True, False, False]


def test_backoff_plan(spark):
    df = spark.createDataFrame([("q", i) for i in range(1, 8)], "request STRING, at INT")
    plan = retries.retry_plan(df, "request", "at", F.lit(True), 5, 30).orderBy("at").collect()
    assert [(r.attempt, r.wait_seconds, r.exhausted) for r in plan] == [
        (1, 2.0, False), (2, 2.0, False), (3, 4.0, False), (4, 8.0, False), (5, None, True),
        (6, None, True), (7, None, True),
    ]
    waits = spark.createDataFrame([(6,), (7,), (5000,)], "a INT")
    assert [r.w for r in waits.select(retries.backoff_seconds(F.col("a")).alias("w")).collect()] == [30.0, 30.0, 30.0]

"""One key holds more than a third of all rows: results stay whole, and top-n is cut before the shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mendwell.operators import context, incidents, metrics, quality, retries
from mendwell.sources import files

N = 30_000


@pytest.fixture(scope="module")
def rows(spark):
    """Row i belongs to key 0 for two of three i, else to one of 50 others."""
    key = F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 50 + 1)
    return spark.range(N, numPartitions=8).select(F.col("id").alias("seq"), key.cast("int").alias("key"))


def expected_key(i: int) -> int:
    return 0 if i % 3 else i % 50 + 1


def test_fold_of_a_hot_run(rows):
    log = rows.select(
        F.col("key").cast("string").alias("run_id"),
        "seq",
        F.concat(F.lit("asset"), F.col("seq") % 4).alias("asset_key"),
        (F.col("seq") % 5 == 0).alias("is_failure"),
        *[F.concat(F.lit(c), "seq").alias(c) for c in ("error_type", "error_message", "stack_trace")],
    )
    found = {int(r.run_id): (r.asset_key, r.error_type) for r in incidents.folded_values(incidents.partial_fold(log)).collect()}
    wanted = {}
    for i in range(N):
        asset, error = wanted.get(expected_key(i), (None, None))
        wanted[expected_key(i)] = (f"asset{i % 4}", f"error_type{i}" if i % 5 == 0 else error)
    assert found == wanted


def test_tail_of_a_hot_run(rows, plan):
    tails = context.log_tail(rows.withColumn("line", F.col("seq").cast("string")), "key", "seq", "line", 4)
    text = plan(tails)
    partial = text.index("row_number(), 4, Partial")
    assert "Exchange hashpartitioning" in text[:partial] and "Exchange" not in text[partial:]
    found = {r.key: r.log_lines for r in tails.collect()}
    for key in range(51):
        mine = [str(i) for i in range(N) if expected_key(i) == key]
        assert found.get(key, []) == mine[-4:]


def test_retry_plan_of_a_hot_request(rows):
    plan = retries.retry_plan(rows, "key", "seq", F.lit(True), 5, 30)
    assert plan.count() == N
    hot = plan.filter("key = 0").orderBy("seq").collect()
    assert [(r.attempt, r.seq) for r in hot] == [(k + 1, i) for k, i in enumerate(i for i in range(N) if i % 3)]
    assert [r.exhausted for r in hot[:6]] == [False] * 4 + [True] * 2 and all(r.exhausted for r in hot[4:])


def test_hot_duplicates_and_windows(rows):
    found = {r.key: r.n_rows for r in quality.duplicates(rows, ["key"]).collect()}
    assert found[0] == sum(1 for i in range(N) if i % 3)
    events = rows.withColumn("ts", F.timestamp_add("SECOND", F.col("seq") % 600, F.lit("2024-01-01").cast("timestamp_ntz")))
    total = metrics.sliding_sum(events, ["key"], 300, 60).agg(F.sum("total")).first()[0]
    assert total == 5 * N  # every event lies in five windows


def test_a_hot_partition_is_written_by_several_tasks(spark, rows, tmp_path):
    sized = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    for key, value in sized.items():
        spark.conf.set(key, value)
    try:
        files.write_partitions(rows, str(tmp_path / "out"), ["key"])
    finally:
        for key in sized:
            spark.conf.unset(key)
    assert len(list((tmp_path / "out" / "key=0").glob("*.parquet"))) > 1
    # A small key is split only if it shares a shuffle partition with the hot one.
    whole = [k for k in range(1, 51) if len(list((tmp_path / "out" / f"key={k}").glob("*.parquet"))) == 1]
    assert whole
    assert spark.read.parquet(str(tmp_path / "out")).count() == N

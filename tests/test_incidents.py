from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mendwell.operators import context, incidents
from mendwell.plans import surrogates as tables

LOG = "run_id STRING, seq BIGINT, asset_key STRING, is_failure BOOLEAN, error_type STRING, error_message STRING, stack_trace STRING"
RUNS = "run_id STRING, job_name STRING, status STRING, partition_key STRING, ended_at TIMESTAMP_NTZ"
T = datetime(2024, 1, 1)


@pytest.fixture
def log(spark):
    rows = [
        ("r1", 1, "bronze/tlc_yellow", True, "First", "one", "s1"),
        ("r1", 2, None, True, "HTTPStatusError", "503", "s2"),
        ("r1", 3, None, True, "", None, ""),  # empty fields keep the last non-empty ones
        ("r1", 4, None, False, "Ignored", "not a failure", None),
        ("r2", 1, None, True, "NoAsset", "x", "x"),
        ("r3", 1, "silver/x", True, None, None, None),
        ("r4", 1, "silver/x", False, None, None, None),
    ]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture
def runs(spark):
    rows = [(f"r{i}", "job", "SUCCESS" if i == 4 else "FAILURE", "2024-01-01", T) for i in range(1, 5)]
    return spark.createDataFrame(rows, RUNS)


def test_capture(runs, log):
    found = {r.run_id: r for r in incidents.capture_incidents(runs, log).collect()}
    assert set(found) == {"r1", "r3"}  # no asset, no incident; no failure, no incident
    assert (found["r1"].error_type, found["r1"].error_message, found["r1"].stack_trace) == ("HTTPStatusError", "503", "s2")
    assert (found["r3"].error_type, found["r3"].error_message) == ("Unknown", "")
    assert found["r1"].recent_metadata["run_id"] == "r1"


def test_capture_is_deterministic_and_appends_once(spark, runs, log):
    first = incidents.capture_incidents(runs, log)
    again = incidents.capture_incidents(runs, log)
    assert incidents.append_new(first, again).count() == 0
    assert incidents.append_new(first.limit(0), first.unionByName(again)).count() == 2


def test_partial_fold_keeps_the_line_numbers(log):
    row = incidents.partial_fold(log).filter("run_id = 'r1'").first()
    assert (row.error_type.seq, row.error_type.value) == (2, "HTTPStatusError")
    assert row.asset_key.seq == 1


def test_lines_of_one_number_and_runs_without_values(spark, log):
    more = [("r5", 1, None, True, "", "", None), ("r6", 7, "a", True, "A", "x", "s"), ("r6", 7, "b", True, "B", "", "t")]
    fold = {r.run_id: r for r in incidents.partial_fold(log.unionByName(spark.createDataFrame(more, LOG))).collect()}
    assert fold["r5"].asset_key is None and fold["r5"].error_type is None
    assert [fold["r6"][c].value for c in incidents.FOLDED] == ["b", "B", "x", "t"]


def test_folds_aggregate_by_hash(runs, log, state, plan):
    assert "SortAggregate" not in plan(incidents.capture_incidents(runs, log))
    assert "SortAggregate" not in plan(state)


@pytest.fixture
def state(spark):
    opened = spark.createDataFrame(
        [(i, datetime(2024, 1, n), "bronze/tlc_yellow", "2024-01-01", "E", "m") for n, i in enumerate("abcd", 1)],
        "incident_id STRING, created_at TIMESTAMP_NTZ, asset_key STRING, partition_key STRING, error_type STRING, error_message STRING",
    )
    changes = spark.createDataFrame(
        [
            ("a", 1, "fix", T, "x"),
            ("a", 2, "resolve", datetime(2024, 2, 1), None),
            ("a", 3, "fix", T, "y"),
            ("b", 1, "fix", T, "z"),
            ("b", 2, "fix", T, "z"),
            ("c", 1, "fix", T, ""),
        ],
        "incident_id STRING, seq BIGINT, kind STRING, changed_at TIMESTAMP_NTZ, proposed_fix STRING",
    )
    return incidents.incident_state(opened, changes)


def test_state_takes_the_last_change_per_column(state):
    rows = {r.incident_id: (r.status, r.proposed_fix) for r in state.collect()}
    assert rows == {"a": ("resolved", "y"), "b": ("open", "z"), "c": ("open", ""), "d": ("open", None)}


def test_state_after_later_changes(spark):
    """Folding only later changes into a state gives the state of the whole log."""
    opened = spark.createDataFrame([(i, T) for i in "abcde"], "incident_id STRING, created_at TIMESTAMP_NTZ")
    schema = "incident_id STRING, seq BIGINT, kind STRING, changed_at TIMESTAMP_NTZ, proposed_fix STRING"
    log = spark.createDataFrame([("a", 1, "fix", T, "x"), ("b", 2, "resolve", T, None), ("c", 3, "fix", T, "y"), ("d", 4, "resolve", T, None)], schema)
    later = spark.createDataFrame([("a", 5, "fix", T, "new"), ("b", 5, "fix", T, ""), ("c", 6, "resolve", T, None), ("d", 7, "resolve", None, None), ("gone", 8, "fix", T, "z")], schema)
    before = incidents.incident_state(opened, log)
    after, whole = incidents.state_after(before, later), incidents.incident_state(opened, log.unionByName(later))
    assert after.columns == before.columns
    assert sorted(after.collect(), key=str) == sorted(whole.select(*after.columns).collect(), key=str)


def test_lineage_and_incidents_parse_the_log_once(spark, sf_dir, plan):
    """The names that lineage is made of are few and stored, and no reader of the events repeats their JSON."""
    for df in tables.incident_lineage(spark, sf_dir):
        assert not any("events.parquet" in f for f in df.inputFiles()) and "SortAggregate" not in plan(df)
    assert "get_json_object" not in plan(tables.captured(spark, sf_dir))


def test_queues(state):
    assert [r.incident_id for r in incidents.open_incidents(state, 2).collect()] == ["d", "c"]
    assert sorted(r.incident_id for r in incidents.undiagnosed(state).collect()) == ["c", "d"]
    # Filtered before the limit: diagnosed newer ones do not push old ones out.
    assert [r.incident_id for r in incidents.diagnosis_queue(state.filter("incident_id <> 'd'"), 1).collect()] == ["c"]
    assert incidents.incident_by_id(state, "b").count() == 1
    assert incidents.summaries(state).columns == incidents.SUMMARY


def test_details_with_reports(spark, state):
    reports = spark.createDataFrame([("b", '{"ok": 1}'), ("c", "{broken")], "incident_id STRING, report STRING")
    full = state.withColumn("recent_metadata", F.create_map(F.lit("k"), F.lit("v")))
    found = {r.incident_id: r.incident_report for r in incidents.details(full, reports).collect()}
    assert found == {"a": None, "b": '{"ok": 1}', "c": None, "d": None}


@pytest.mark.parametrize(
    ("error_type", "message", "asset", "category"),
    [
        ("ChaosTriggered", "chaos:tlc_5xx", "bronze/tlc_yellow", "upstream_outage"),
        ("ChaosTriggered", "", "bronze/duckdb_lock", "infra"),
        ("DbtRuntimeError", "x", "m", "dbt_error"),
        ("dagsterdbtcliruntimeerror", "x", "m", "dbt_error"),
        ("AssertionError", "x", "stg_tlc_yellow", "data_quality"),
        ("AssertionError", "x", "fct", "unknown"),
        ("ValueError", "Weather payload", "m", "schema_drift"),
        ("RandomFoo", "x", "m", "unknown"),
        (None, None, None, "unknown"),
    ],
)
def test_classifier(spark, error_type, message, asset, category):
    df = spark.createDataFrame([(error_type, message, asset)], "error_type STRING, error_message STRING, asset_key STRING")
    assert incidents.classify(df).first().category_hint == category


def test_embedding_text(spark):
    df = spark.createDataFrame([("a", "", None, "fix"), ("a", "E", "m", "")], "a STRING, e STRING, m STRING, f STRING")
    text = incidents.embedding_text(*[F.col(c) for c in "aemf"])
    assert [r.t for r in df.select(text.alias("t")).collect()] == ["a\nprior fix: fix", "a\nE\nm"]


# --- context ------------------------------------------------------------------------


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame(
        [("model.s.silver", "silver"), ("source.raw.silver", "silver"), ("model.s.hub", "hub")], "node_id STRING, name STRING"
    )
    edges = [("model.s.silver", "source.raw.trips"), ("model.s.silver", "source.raw.weather"), ("model.s.gold", "model.s.silver")]
    edges += [(f"model.s.child{i:04d}", "model.s.hub") for i in range(50)]
    return nodes, spark.createDataFrame(edges, "child STRING, parent STRING")


def test_lineage(spark, graph):
    assets = spark.createDataFrame([("db/silver",), ("db.silver",), ("silver",), ("none",), (None,)], "asset_key STRING")
    found = context.lineage_neighbours(assets, *graph)
    lists = {r.asset_key: (r.upstream, r.downstream) for r in context.neighbour_lists(found).collect()}
    expected = (["source.raw.trips", "source.raw.weather"], ["model.s.gold"])
    assert lists == {"db/silver": expected, "db.silver": expected, "silver": expected}


def test_long_neighbour_lists_are_whole(spark, graph):
    assets = spark.createDataFrame([("hub",)], "asset_key STRING")
    found = context.lineage_neighbours(assets, *graph)
    assert found.count() == 50
    row = context.neighbour_lists(found).first()
    assert (row.downstream_count, row.upstream) == (50, [])
    assert row.downstream == sorted(r.neighbour for r in found.collect())


def test_recent_runs_per_asset(spark):
    rows = [(f"a{i}", "SUCCESS", ["a"], datetime(2024, 1, i)) for i in range(1, 6)]
    rows += [("everywhere", "FAILURE", [], datetime(2024, 1, 4, 12)), ("both", "SUCCESS", ["a", "b"], datetime(2023, 1, 1))]
    runs = spark.createDataFrame(rows, "run_id STRING, status STRING, asset_keys ARRAY<STRING>, created_at TIMESTAMP_NTZ")
    assets = spark.createDataFrame([("a",), ("b",), ("a",)], "asset_key STRING")
    ranked = context.recent_runs(assets, runs, 3)
    found = {a: [r.run_id for r in ranked.filter(F.col("asset_key") == a).orderBy("position").collect()] for a in "ab"}
    assert found == {"a": ["a5", "everywhere", "a4"], "b": ["everywhere", "both"]}
    none_shared = context.recent_runs(assets, runs.filter("size(asset_keys) > 0"), 3)
    assert none_shared.filter("asset_key = 'b'").count() == 1


def test_log_tail_keeps_order_and_limits_map_side(spark, plan):
    log = spark.createDataFrame([("r", i, f"line {i}") for i in range(30)] + [("s", 1, "only")], "run STRING, seq INT, line STRING")
    tails = context.log_tail(log, "run", "seq", "line", 3)
    assert {r.run: r.log_lines for r in tails.collect()} == {"r": ["line 27", "line 28", "line 29"], "s": ["only"]}
    assert "WindowGroupLimit" in plan(tails) and "Partial" in plan(tails)


def test_context_without_any_source(spark):
    df = spark.createDataFrame([("i", "a", "r")], "incident_id STRING, asset_key STRING, run_id STRING")
    row = context.context_bundle(df).first()
    assert (row.upstream, row.downstream, row.recent_runs, row.log_lines, row.similar_incidents) == ([], [], [], [], [])


def test_records_shuffle_no_shared_lists(spark, plan):
    captured = spark.createDataFrame([("i1", "a/x", "r1", {"run_id": "r1"}), ("i2", "a/x", "r2", {"run_id": "r2"})], "incident_id STRING, asset_key STRING, run_id STRING, recent_metadata MAP<STRING,STRING>")
    lineage = spark.createDataFrame([("a/x", ["u1", "u2"])], "asset_key STRING, upstream ARRAY<STRING>")
    tags = spark.createDataFrame([("r1", {"user": "7"})], "run_id STRING, tags MAP<STRING,STRING>")
    samples = spark.createDataFrame([("x", [{"k": "v"}])], "target STRING, sample_rows ARRAY<MAP<STRING,STRING>>")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        records = incidents.full_records(captured, lineage, tags, samples)
        # Only the tags of the runs meet the incidents by a shuffle.
        assert plan(records).count("SortMergeJoin") == 1
        found = {r.incident_id: (r.upstream_lineage, r.recent_metadata, r.sample_rows) for r in records.collect()}
    finally:
        spark.conf.unset(threshold)
    assert found["i1"] == (["u1", "u2"], {"run_id": "r1", "user": "7"}, [{"k": "v"}]) and found["i2"][1] == {"run_id": "r2"}

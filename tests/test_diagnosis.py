from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mendwell.operators import context, diagnosis, incidents, remediation

INCIDENT = "incident_id STRING, created_at TIMESTAMP_NTZ, asset_key STRING, partition_key STRING, error_type STRING, error_message STRING, run_id STRING"
T = datetime(2024, 1, 1)


def reply(**changes):
    body = {
        "category": "infra",
        "root_cause": "x",
        "proposed_fix": "retry-with-backoff",
        "confidence": 0.9,
        "can_auto_remediate": True,
    }
    return json.dumps({k: v for k, v in (body | changes).items() if v != "drop"})


CASES = {
    "plain": (reply(), None),
    "fenced": (f"```json\n{reply()}\n```", None),
    "extra field": (reply(more=[1]), None),
    "numbers as text": (reply(confidence="0.5", can_auto_remediate="yes"), None),
    "integer flag": (reply(can_auto_remediate=1, confidence=1), None),
    "none": (None, "no response"),
    "prose": ("I think it broke", "model returned non-JSON"),
    "cut off": ('{"category": "infra"', "model returned non-JSON"),
    "list": ("[1]", "model JSON did not match schema: category, root_cause, proposed_fix, confidence, can_auto_remediate"),
    "missing": (reply(root_cause="drop"), "model JSON did not match schema: root_cause"),
    "null": (reply(category=None), "model JSON did not match schema: category"),
    "wrong type": (reply(category=5), "model JSON did not match schema: category"),
    "too sure": (reply(confidence=1.5), "model JSON did not match schema: confidence"),
    "negative": (reply(confidence=-0.1), "model JSON did not match schema: confidence"),
    "no number": (reply(confidence="high"), "model JSON did not match schema: confidence"),
    "no flag": (reply(can_auto_remediate="maybe"), "model JSON did not match schema: can_auto_remediate"),
}


def test_response_validation(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "name STRING, response STRING")
    rows = {r.name: r for r in diagnosis.parse_responses(df).collect()}
    assert {k: r.error for k, r in rows.items()} == {k: v[1] for k, v in CASES.items()}
    assert (rows["numbers as text"].confidence, rows["numbers as text"].can_auto_remediate) == (0.5, True)
    assert rows["integer flag"].can_auto_remediate is True


@pytest.fixture
def opened(spark):
    rows = [
        ("ok", T, "bronze/tlc_yellow", "2024-02-01", "HTTPStatusError", "503", "r"),
        ("alien", T, "bronze/tlc_yellow", "2024-02-01", "HTTPStatusError", "503", "r"),
        ("offlist", T, "bronze/tlc_yellow", "2024-02-01", "HTTPStatusError", "503", "r"),
        ("silent", T, "m", None, "DbtRuntimeError", "bad sql", "r"),
        ("broken", T, "m", None, "RandomFoo", "?", "r"),
    ]
    return incidents.classify(spark.createDataFrame(rows, INCIDENT))


@pytest.fixture
def diagnosed(spark, opened):
    replies = [
        ("ok", reply()),
        ("alien", reply(category="aliens", can_auto_remediate=False)),
        ("offlist", reply(proposed_fix="rerun-dbt")),
        ("broken", "oops"),
    ]
    responses = spark.createDataFrame(replies, "incident_id STRING, response STRING")
    return diagnosis.diagnose(opened, responses, remediation.ALLOWLIST)


def test_diagnoses_and_fallbacks(diagnosed):
    rows = {r.incident_id: r for r in diagnosed.collect()}
    assert len(rows) == 5
    assert (rows["ok"].category, rows["ok"].can_auto_remediate) == ("infra", True)
    assert rows["alien"].category == "unknown"
    assert (rows["offlist"].can_auto_remediate, rows["offlist"].proposed_fix) == (False, "rerun-dbt")
    silent = rows["silent"]
    assert (silent.category, silent.confidence, silent.can_auto_remediate) == ("dbt_error", 0.0, False)
    assert silent.proposed_fix == diagnosis.FALLBACK_FIX
    assert silent.root_cause == "agent diagnose failed: no response"
    assert rows["broken"].diagnosis_error == "model returned non-JSON"


def test_prompts(spark, opened):
    hits = spark.createDataFrame(
        [("ok", i, f"s{i}", 0.5 + i / 8, "a", "E", "fix") for i in range(1, 5)],
        "incident_id STRING, rank INT, similar_id STRING, score DOUBLE, asset_key STRING, error_type STRING, prior_fix STRING",
    )
    logs = spark.createDataFrame([("r", [f"line {i}" for i in range(12)])], "run_id STRING, log_lines ARRAY<STRING>")
    lineage = spark.createDataFrame(
        [("bronze/tlc_yellow", 0, 2, [], ["x", "y"]), ("m", 0, 5000, [], [f"n{i}" for i in range(5000)])],
        "asset_key STRING, upstream_count BIGINT, downstream_count BIGINT, upstream ARRAY<STRING>, downstream ARRAY<STRING>",
    )
    bundle = context.context_bundle(opened, lineage, logs=logs, similar=context.similar_lists(hits))
    prompts = {r.incident_id: r.prompt for r in diagnosis.build_prompts(bundle).collect()}
    ok = prompts["ok"]
    assert ok.startswith("Heuristic category guess (you may override): upstream_outage\nINCIDENT\nasset_key: bronze/tlc_yellow\n")
    assert "downstream: ['x', 'y']" in ok
    assert "line 1\n" not in ok and "  line 2\n" in ok and "  line 11\n" in ok
    assert ok.count("- asset=a error_type=E score=") == 3 and "score=0.63 prior_fix=fix" in ok
    assert "SIMILAR PAST INCIDENTS\n(none)" in prompts["silent"]
    assert "partition_key: \n" in prompts["silent"]
    assert prompts["silent"].count("'n") == 5000


def test_reports(spark, diagnosed):
    flags = spark.createDataFrame([("tlc_5xx",)], "flag STRING")
    manifest = spark.createDataFrame([], "dataset STRING, partition_key STRING, path STRING, rows BIGINT")
    decided = remediation.decide_actions(diagnosed, flags, manifest)
    reports = diagnosis.build_reports(context.context_bundle(decided), T)
    rows = {r.incident_id: json.loads(r.report) for r in reports.collect()}
    ok = rows["ok"]
    assert list(ok) == sorted(ok)
    assert ok["proposed_action"]["status"] == "executed" and ok["errors"] == []
    assert ok["proposed_action"]["next_run"]["partition_key"] == "2024-02-01"
    assert ok["diagnosis"]["confidence"] == 0.9
    assert rows["silent"]["errors"] == ["no response"]
    assert rows["silent"]["context_summary"]["recent_run_count"] == 0
    stamped = diagnosis.proposed_fixes(reports, F.lit(1), F.lit(T))
    assert {r.incident_id: r.proposed_fix for r in stamped.collect()}["ok"] == remediation.RETRY

from __future__ import annotations

import math
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mendwell.operators import incidents, metrics, quality, similarity
from mendwell.plans import catalog
from mendwell.sources.keyed_store import KeyedStore

REPORTS = "incident_id STRING, at STRING, report STRING"


def reports(spark, rows):
    return spark.createDataFrame(rows, REPORTS)


def held(df):
    return sorted(tuple(r) for r in df.select("incident_id", "at", "report").collect())


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), reports(spark, []).schema, "incident_id", ("at", "report"), buckets=8)


def test_writing_twice_leaves_one_report_and_the_newest_wins(spark, store):
    rows = [(f"i{k:02d}", "2024-01-02", f"r{k}") for k in range(40)]
    assert held(store.read()) == []
    for _ in range(2):
        store.upsert(reports(spark, rows))
    assert held(store.read()) == rows
    store.upsert(reports(spark, [("i03", "2024-01-03", "new"), ("i03", "2024-01-02", "zz"), ("i05", "2024-01-01", "old"), ("x", "1", None)]))
    expected = [("i03", "2024-01-03", "new") if r[0] == "i03" else r for r in rows] + [("x", "1", None)]
    assert held(store.read()) == sorted(expected)


def test_lookups_read_one_bucket_and_writes_touch_theirs(spark, store, plan):
    store.upsert(reports(spark, [(f"i{k:02d}", "1", "r") for k in range(40)]))
    assert held(store.lookup("i07")) == [("i07", "1", "r")] and held(store.lookup("nobody")) == []
    text = plan(store.lookup("i07"))
    assert "PartitionFilters: [isnotnull(bucket" in text and "(bucket" in text
    before = {p: p.stat().st_mtime_ns for p in Path(store.root).rglob("*.parquet")}
    store.upsert(reports(spark, [("i07", "2", "changed")]))
    after = {p: p.stat().st_mtime_ns for p in Path(store.root).rglob("*.parquet")}
    changed = {p.parent.name for p, _ in set(before.items()) ^ set(after.items())}
    assert len(changed) == 1 and held(store.lookup("i07")) == [("i07", "2", "changed")] and store.read().count() == 40


def test_without_order_later_batches_replace(spark, tmp_path):
    vectors = spark.createDataFrame([(k, [float(k)]) for k in range(30)], "vec_id LONG, v ARRAY<FLOAT>")
    store = KeyedStore(spark, str(tmp_path / "v"), vectors.schema, "vec_id", buckets=4)
    store.upsert(vectors)
    store.upsert(vectors.filter("vec_id < 10").withColumn("v", F.array(F.lit(-1.0).cast("float"))))
    assert sorted((r.vec_id, r.v[0]) for r in store.read().collect()) == [(k, -1.0 if k < 10 else float(k)) for k in range(30)]
    assert store.lookup(3).first().v == [-1.0]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_quantiles(spark, q):
    rng = random.Random(4)
    series = {
        "hot": [rng.lognormvariate(0, 3) for _ in range(3_000)],
        "ties": [1.0] * 50 + [2.0] * 50,
        "one": [7.5],
        "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300, -3.0, 1e300],
        "tiny": [5e-324 * k for k in range(1, 30)],
        None: [float(k) for k in range(10)],
    }
    rows = [(s, v) for s, held_values in series.items() for v in held_values] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    found = {r.s: r.quantile for r in metrics.exact_quantile(spark.createDataFrame(rows, "s STRING, v DOUBLE"), ["s"], "v", q, parts=16).collect()}
    assert found == {s: sorted(v)[max(1, math.ceil(len(v) * q)) - 1] for s, v in series.items()}


def test_samples_are_the_same_however_rows_are_dealt(spark):
    rows = [(k, k % 10, None if k % 7 == 0 else float(k)) for k in range(500)] + [(3, 3, 3.0)] * 20
    df = spark.createDataFrame(rows, "id INT, g INT, v DOUBLE")
    checks = [quality.RowCheck("v_missing", "t", F.col("v").isNull()), quality.RowCheck("g_three", "t", F.col("g") == 3), quality.RowCheck("never", "t", F.col("id") < 0), quality.RowCheck("unknown", "t", F.col("v") > 495)]
    found = [{r.check_name: (r.failures, r.sample_rows) for r in quality.suite_samples(df.repartition(n), checks).collect()} for n in (1, 7)]
    assert found[0] == found[1]
    counts = {k: (n, len(sample)) for k, (n, sample) in found[0].items()}
    assert counts["v_missing"][0] == 72 and counts["g_three"][0] == 70 and counts["never"] == (0, 0)
    assert counts["unknown"][0] == 3 and all(1 <= counts[c][1] <= 3 for c in ("v_missing", "g_three", "unknown"))
    assert all(r["v"] is None for r in found[0]["v_missing"][1]) and all(r["g"] == "3" for r in found[0]["g_three"][1])
    none = {r.check_name: (r.failures, r.sample_rows) for r in quality.suite_samples(df.limit(0), checks).collect()}
    assert none == {c.name: (0, []) for c in checks}


def test_full_records(spark):
    captured = spark.createDataFrame(
        [("i1", "bronze/a", {"run_id": "r1", "job_name": "j"}, "r1", datetime(2024, 1, 1)), ("i2", None, {"run_id": "r2"}, "r2", datetime(2024, 1, 1))],
        "incident_id STRING, asset_key STRING, recent_metadata MAP<STRING,STRING>, run_id STRING, created_at TIMESTAMP_NTZ",
    )
    lineage = spark.createDataFrame([("bronze/a", ["x", "y"])], "asset_key STRING, upstream ARRAY<STRING>")
    tags = spark.createDataFrame([("r1", {"job_name": "other", "team": "t"})], "run_id STRING, tags MAP<STRING,STRING>")
    samples = spark.createDataFrame([("a", [{"k": "1"}]), ("a", [{"k": None}]), ("b", [{"k": "3"}])], "target STRING, sample_rows ARRAY<MAP<STRING,STRING>>")
    found = {r.incident_id: r for r in incidents.full_records(captured, lineage, tags, samples).collect()}
    assert found["i1"].upstream_lineage == ["x", "y"] and found["i1"].recent_metadata == {"run_id": "r1", "job_name": "j", "team": "t"}
    assert sorted(found["i1"].sample_rows, key=str) == [{"k": "1"}, {"k": None}]
    assert (found["i2"].upstream_lineage, found["i2"].sample_rows, found["i2"].recent_metadata) == ([], [], {"run_id": "r2"})


def test_index_of_repeated_ids_and_payload(spark):
    texts = spark.createDataFrame([("a", "x y y", 1), ("a", "x y y", 1), ("b", None, 2), ("c", " \t", 3), ("d", "q", 4)], "id STRING, text STRING, n INT")
    rows = {r.id: r for r in similarity.build_index(texts, "id", "text", 16).collect()}
    assert set(rows) == {"a", "d"} and rows["d"].n == 4 and len(rows["a"].vector) == 16
    assert sorted(v for v in rows["a"].vector if v) == pytest.approx([5**-0.5, 2 * 5**-0.5])


def test_reports_are_built_from_one_capture(spark, sf_dir, monkeypatch):
    """State, decisions and context share the parsed events, the runs and the captured incidents."""
    calls = []

    def counted(name, fn):
        monkeypatch.setattr(catalog.tables, name, lambda *a, **k: (calls.append(name), fn(*a, **k))[1])

    for name in ("events", "runs", "captured", "changes"):
        counted(name, getattr(catalog.tables, name))
    monkeypatch.setattr(catalog, "_similar", lambda *a, **k: spark.createDataFrame([], "incident_id STRING, similar_id STRING, score DOUBLE, rank INT, asset_key STRING, error_type STRING, prior_fix STRING"))
    state, written = catalog._reports(spark, sf_dir)
    assert sorted(calls) == ["captured", "changes", "events", "runs"]
    assert state.count() == written.select("incident_id").distinct().count() > 0

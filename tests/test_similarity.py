from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendwell.operators import nearest, similarity

SCHEMA = "id STRING, asset STRING, vector ARRAY<FLOAT>"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        # A third of all rows and more share one asset; some vectors repeat.
        asset = "hot" if i % 2 else f"a{i % 7}"
        asset = None if i in (4, 8) else asset
        rows.append((f"v{i:03d}", asset, rng.normal(size=8).round(2).tolist()))
    rows += [(f"w{i:03d}", "hot", rows[1][2]) for i in range(20)]
    return rows


def brute(queries, index, k, same_asset, exclude_self):
    found = set()
    for qid, qasset, q in queries:
        scored = []
        for vid, vasset, v in index:
            if (same_asset and qasset and vasset != qasset) or (exclude_self and vid == qid):
                continue
            a, b = np.float32(q).astype(float), np.float32(v).astype(float)
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), vid))
        found |= {(qid, vid, -s, rank) for rank, (s, vid) in enumerate(sorted(scored)[:k], 1)}
    return found


@pytest.mark.parametrize("same_asset", [True, False])
@pytest.mark.parametrize("path", ["scan", "cells"])
def test_top_k_equals_brute_force(spark, vectors, monkeypatch, same_asset, path):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 40)
    index = spark.createDataFrame(vectors, SCHEMA).repartition(5)
    queries = vectors if path == "cells" else vectors[:12]
    bound = 10 if path == "cells" else 100
    hits = similarity.similar_incidents(
        spark.createDataFrame(queries, SCHEMA), index, 5, same_asset, exclude_self=True, max_broadcast=bound
    )
    found = {(r.incident_id, r.similar_id, r.score, r["rank"]) for r in hits.collect()}
    assert found == brute(queries, vectors, 5, same_asset, True)


def test_scan_does_not_shuffle_the_index(spark, vectors, plan):
    df = spark.createDataFrame(vectors, SCHEMA)
    text = plan(similarity.similar_incidents(df.limit(3), df, 5))
    assert "Cartesian" not in text and "NestedLoop" not in text
    # The one exchange lies above the scoring.
    assert text.index("Exchange") < text.index("MapInPandas")


def test_self_and_empty_queries(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA)
    one = df.filter("id = 'v000'")
    assert similarity.similar_incidents(one, df, 1).first().similar_id == "v000"
    assert similarity.similar_incidents(df.limit(0), df, 5).count() == 0


def test_payload(spark):
    hits = spark.createDataFrame([("q", "x", 0.9, 1), ("q", "gone", 0.8, 2)], "incident_id STRING, similar_id STRING, score DOUBLE, rank INT")
    state = spark.createDataFrame([("x", "a", "E", None)], "incident_id STRING, asset_key STRING, error_type STRING, proposed_fix STRING")
    found = {r.similar_id: (r.asset_key, r.error_type, r.prior_fix) for r in similarity.with_payload(hits, state).collect()}
    assert found == {"x": ("a", "E", ""), "gone": ("", "", "")}


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    values = [r.c for r in df.select(similarity.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert values[0] == pytest.approx(2**-0.5) and values[1] is None


def test_index_of_texts(spark):
    texts = spark.createDataFrame([("a", "red red blue"), ("b", "  "), ("c", "BLUE red  red"), ("d", "green"), ("d", "green")], "id STRING, text STRING")
    index = similarity.build_index(texts, "id", "text", 64)
    rows = {r.id: np.array(r.vector) for r in index.collect()}
    assert set(rows) == {"a", "c", "d"}
    assert rows["a"] == pytest.approx(rows["c"])
    assert sorted(rows["a"][rows["a"] > 0]) == pytest.approx([5**-0.5, 2 * 5**-0.5])
    assert rows["a"] @ rows["d"] == pytest.approx(0)


def test_index_counts_texts_where_they_are_read(spark, plan):
    """Words and their counts aren't shuffled; only white space of ASCII parts words."""
    lines = ["a\tb\x0bc\x0cd\re\nA  b", "a\u00a0b \u2003 \x1c x\x85y", "\u0130 \u03a3\u03a3 \u00c9t\u00e9", "\U0001f600 \U0001f600", None, "\x0b\x0c"]
    texts = spark.createDataFrame(list(enumerate(lines)), "id LONG, text STRING")
    index = similarity.build_index(texts, "id", "text", 16)
    shown = plan(index)
    assert "Generate" not in shown and shown.count("ArrowEvalPython") == 1 and shown.count("Exchange") == 1
    rows = {r.id: np.array(r.vector) for r in index.collect()}
    assert set(rows) == {0, 1, 2, 3} and all(np.linalg.norm(v) == pytest.approx(1) for v in rows.values())
    for k, v in rows.items():
        low = texts.filter(F.col("id") == k).select(F.lower("text")).first()[0]
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", low) if w]
        counts = np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in words], minlength=16)
        assert v == pytest.approx(counts / np.linalg.norm(counts))


def test_places_are_the_same_beyond_the_words_that_are_kept(monkeypatch):
    monkeypatch.setattr(similarity, "KEPT_WORDS", 2)
    places = similarity._Places(64)
    text = b"a b c d a b c d a"
    assert similarity._counted(text, places) == pytest.approx(similarity._counted(text, similarity._Places(64)))
    assert len(places) <= 2 and similarity._counted(None, places) is None and similarity._counted(b" \x0b", places) is None


def test_upsert_replaces_by_id(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id STRING, v INT")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "id STRING, v INT")
    assert sorted(tuple(r) for r in similarity.upsert_index(old, new, "id").collect()) == [("a", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("same_asset", [True, False])
def test_cell_queries_from_the_index_itself(spark, same_asset):
    rows = [(f"v{k:03d}", f"a{k % 2}", [float(k % 7), float(k % 5), 1.0]) for k in range(40)]
    index = spark.createDataFrame(rows, "id STRING, asset STRING, vector ARRAY<FLOAT>")
    wanted = index.join(index.filter("id < 'v020'").select("id"), "id", "left_semi")
    by_cells = similarity.similar_incidents(wanted, index, 3, same_asset, exclude_self=True, max_broadcast=0)
    scanned = similarity.similar_incidents(wanted, index, 3, same_asset, exclude_self=True)
    key = lambda df: sorted((r.incident_id, r.similar_id, r.rank, round(r.score, 6)) for r in df.collect())
    assert key(by_cells) == key(scanned) and len(key(by_cells)) == 60


def test_cells_leave_out_what_cannot_reach_the_kth_score(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 16))
    rows = [(f"v{i:04d}", "hot", (centres[i % 30] + 0.05 * rng.normal(size=16)).tolist()) for i in range(3_000)]
    index = spark.createDataFrame(rows, SCHEMA)
    wanted = index.filter("substring(id, 5, 1) = '0'")
    hits = nearest.nearest_by_cells(wanted, index, 5, True).collect()
    found = {(r.incident_id, r.similar_id, r.score, r["rank"]) for r in hits}
    queries = [r for r in rows if r[0].endswith("0")]
    assert found == brute(queries, rows, 5, True, True)
    scored = sum({r.incident_id: r.scored for r in hits}.values())
    assert scored < 0.2 * len(queries) * len(rows)


def test_cells_with_a_hot_vector_zero_vectors_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 25)
    rng = np.random.default_rng(2)
    rows = [(f"h{i:03d}", "hot", [1.0, 2.0, 3.0]) for i in range(200)]
    rows += [(f"r{i:03d}", "hot", rng.normal(size=3).round(1).tolist()) for i in range(150)]
    zeros = [(f"z{i}", "hot", [0.0, 0.0, 0.0]) for i in range(8)]
    index = spark.createDataFrame([*rows, *zeros, ("n", "hot", None)], SCHEMA)
    hits = nearest.nearest_by_cells(index, index, 3, True).collect()
    by_query = {}
    for r in hits:
        by_query.setdefault(r.incident_id, []).append((r["rank"], r.similar_id, r.score))
    assert len(by_query) == 358 and all(len(v) == 3 for v in by_query.values())
    expected = brute(rows, rows, 3, True, True)
    for qid, _, _ in rows:
        mine = sorted((rank, sid, s) for q, sid, s, rank in expected if q == qid)
        # Zero vectors score 0 with all, less than three others do.
        assert sorted(by_query[qid]) == mine or mine[2][2] <= 0
    assert sorted(by_query["z0"]) == [(1, "h000", 0.0), (2, "h001", 0.0), (3, "h002", 0.0)]
    assert sorted(by_query["h000"])[0] == (1, "h001", 1.0)
    # The searches of 200 equal queries are one, and of 200 equal rows only the first ids are kept.
    assert len({r.scored for r in hits if r.incident_id.startswith("h")}) == 1 and max(r.scored for r in hits) <= 159


def test_cells_write_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"v{i:04d}", "hot", rng.normal(size=24).tolist()) for i in range(500)]
    index = spark.createDataFrame(rows, SCHEMA)
    sizes = {}

    def counted(df, name, write=nearest.stored):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(nearest, "stored", counted)
    hits = nearest.nearest_by_cells(index, index, 5, True).collect()
    assert {(r.incident_id, r.similar_id, r.score, r["rank"]) for r in hits} == brute(rows, rows, 5, True, True)
    # Such vectors lie in no clusters: nearly every query meets every cell, of which there are over 20.
    assert max(sizes.values()) <= 6 * len(rows)


def test_equal_vectors_are_grouped_by_hash_first(spark, plan, monkeypatch):
    """Sorts compare hashes, not vectors; vectors that share a hash stay apart, and zeros of both signs are one."""
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [1.0, -0.0]), ("b", "x", [1.0, 0.0]), ("c", "y", [1.0, 0.0]), ("d", "x", [0.0, 1.0]), ("e", "x", [1.0, 0.0])]
    index = spark.createDataFrame(rows, SCHEMA)
    sorts = [line for line in plan(nearest.first_ids(index, 2)).splitlines() if "Sort [" in line and "vector" in line]
    assert sorts and all(re.search(r"Sort \[_h#", line) for line in sorts)
    expected = {("x", (1.0, 0.0)): ["a", "b"], ("x", (0.0, 1.0)): ["d"], ("y", (1.0, 0.0)): ["c"]}
    found = lambda: {(r.asset, tuple(abs(x) for x in r.vector)): r.ids for r in nearest.first_ids(index, 2).collect()}
    hits = lambda: sorted(tuple(r) for r in nearest.nearest_by_cells(index.dropDuplicates(["id"]), index, 2, True).drop("scored").collect())
    assert found() == expected
    apart = hits()
    monkeypatch.setattr(nearest, "_by_hash", lambda df, vector: df.withColumn("_h", F.lit(1)))
    assert found() == expected and hits() == apart


def test_few_of_a_cells_vectors_are_scored_exactly(monkeypatch):
    """Ties, opposite vectors, and components that aren't finite; of a cell only what can be among the best is scored in double precision."""
    monkeypatch.setattr(nearest, "TILE", 2_000)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(600, 12))
    vectors[:40] = vectors[0]
    vectors[300:330] = -vectors[0]
    vectors[550] = np.nan
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    queries = np.r_[vectors[::3], -vectors[:1], np.full((1, 12), np.nan)]
    order, pairs = rng.permutation(600), []

    def counted(self, q, v, add=nearest.Best._add):
        pairs.append(len(q))
        add(self, q, v)

    monkeypatch.setattr(nearest.Best, "_add", counted)
    found = nearest.Best(queries, vectors, order, 5)
    for start in range(0, 600, 200):
        found.meet(np.arange(len(queries)), start, start + 200)
    scores = np.round(queries @ vectors.T, 6) + 0.0
    for k, row in enumerate(scores):
        keep = np.flatnonzero(~np.isnan(row))
        best = keep[np.lexsort((order[keep], -row[keep]))][:5]
        assert found.rows[k].tolist() == (best.tolist() if len(best) else [-1] * 5)
    assert (found.scored == 600).all() and sum(pairs) < 0.1 * scores.size

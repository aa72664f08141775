from __future__ import annotations

import math

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from mendwell.llm import hard_negatives as hn
from mendwell.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def brute(rows, anchors=lambda i: i % 3 == 0):
    """The result on plain values, every pair scored."""
    whole = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.setdefault(i, []).append((label, [math.floor(256 * float(np.float32(x))) for x in v]))
    whole = {i: min(held) for i, held in whole.items()}
    out = []
    for i, (label, v) in whole.items():
        if not anchors(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, own) for j, (own, w) in whole.items() if j != i)
        for minus, j, own in [s for s in scored if s[2] == label][:5]:
            fit = [(-m, n) for m, n, other in scored if other != label and -50 * minus <= -100 * m <= -95 * minus][:3]
            out += [(i, j, rank + 1, n, -minus, m) for rank, (m, n) in enumerate(fit)]
    return sorted(out)


def result(spark, rows):
    df = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 3 == 0)
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_sql(spark, sf_dir):
    assert differences(QUERIES["op13_hard_negatives"](spark, sf_dir), connect(sf_dir), ORACLES["op13_hard_negatives"]) == ""


@pytest.mark.parametrize("spread", [0.1, 3.0, 20_000.0])
def test_equals_brute_force_over_several_blocks_and_cells(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hn, "CELL_ROWS", 48)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 24))
    labels = rng.integers(0, 4, 300)
    vectors = (centres[labels] + rng.normal(size=(300, 24))) * spread
    rows = [(int(i), [float(x) for x in np.clip(v, -60_000, 60_000)], int(c)) for i, (v, c) in enumerate(zip(vectors, labels, strict=True))]
    got = result(spark, rows)
    assert got == brute(rows) and len(got) > 200


def test_ties_repeats_and_copies(spark):
    # A third of all rows are one vector, of two labels.
    rows = [(i, [0.5, 0.25, -0.5], i % 2) for i in range(40)] + [(i, [0.1 * (i % 7), 0.3, -0.2], i % 3) for i in range(40, 120)]
    assert result(spark, rows + rows[:30]) == brute(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.8, 0.8], 2), (3, None, 1), (4, [1.0, None], 1), (None, [1.0, 1.0], 1)]
    rows += [(5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [1.0, 1.0], None), (8, [0.7, 0.7], 2), (9, [], 2), (12, [1.0], 1), (15, [0.0, 0.0], 1)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert {r[3] for r in got} >= {2, 8} and not {r[1] for r in got} & {3, 4, 5, 7}
    huge = [*rows, (18, [1e30, 1.0], 1)]
    assert result(spark, huge) == got


def test_empty_table_and_clashing_columns(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    rows = [(0, [1.0], 1), (3, [0.9], 1), (4, [0.7], 2)]
    named = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("anchor_id"), F.lit("x").alias("score"), F.lit(2).alias("id"), F.lit(3).alias("vector"))
    assert sorted(tuple(r) for r in hn.hard_negatives(named, F.col("id") % 3 == 0).collect()) == brute(rows)


def test_scan_reads_columns_of_living_candidates_only():
    rng = np.random.default_rng(1)
    columns = rng.integers(-20, 21, (64, 1_000))
    columns[:8, ::50] += 2_000
    block = hn.Block(np.arange(1_000), np.zeros(1_000, np.int64), columns)
    anchor = np.ones(64, np.int64)
    anchor[:8] = 50
    asked = []

    def keep(scores, low, high):
        asked.append(len(scores))
        return scores + high >= hn._nth_largest(scores + low, 5)

    at, scores = hn.vertical_scan(block, anchor, np.ones(1_000, bool), keep)
    assert asked[0] == 1_000 and max(asked[1:]) <= 20
    exact = anchor @ columns
    assert (scores == exact[at]).all() and set(np.argsort(-exact)[:5]) <= set(at.tolist())

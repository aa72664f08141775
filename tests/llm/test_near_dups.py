from __future__ import annotations

import random

import numpy as np
import pytest
from brute import near_components

from mendwell.llm import graph, near_dups
from mendwell.llm.queries import QUERIES


def found_in(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs, **options).collect()}


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op3_near_dups"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_components(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_chains_and_families(make_docs):
    """Copies at all distances of one text: linked pairs hang together although most of a group isn't linked directly."""
    rng, rows = random.Random(3), []
    base = [f"w{k}" for k in range(300)]
    for k in range(60):
        words = list(base)
        for at in range(4 * k, 4 * k + 4):
            words[at % 300] = f"x{k}.{at}"
        base = words if k % 3 else base
        rows.append((k, " ".join(words)))
    for k in range(60, 120):
        words = [f"v{n}" for n in range(200)]
        for at in rng.sample(range(200), 9):
            words[at] = f"y{k}.{at}"
        rows.append((k, " ".join(words)))
    for block in (1000, 7):
        assert found_in(make_docs(rows), width=3, percent=85, block=block) == near_components(rows, 3, 85)


def test_many_copies_of_few_texts(make_docs):
    rows = [(k, "the same words again and again " * (1 + k % 3)) for k in range(900)] + [(900, "other words that stand alone here")]
    assert found_in(make_docs(rows), width=3, percent=85) == near_components(rows, 3, 85)


def test_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Two Words"), (5, "two words"), (6, "ÄB Ä c"), (7, "äb Ä c"), (8, "long " * 50_000 + "end")]
    found = found_in(make_docs(rows).withColumnRenamed("lang", "digest").withColumnRenamed("source", "kept"), width=3, percent=85)
    assert found == near_components(rows, 3, 85)
    assert found[1] == (0, 1) and found[4][1] == found[5][1] == 4 and found[7][1] == 7


def test_rows_without_or_with_one_id(make_docs):
    docs = make_docs([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "q r s t"), (3, "q r s t"), (9, "z"), (9, "z")])
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, None, True)] * 2 + [(7, 7, True), (7, 3, False), (3, 3, True), (9, 9, True), (9, 9, True)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in near_dups.without_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(None, "a b c d")] * 2 + [(7, "a b c d"), (3, "q r s t"), (9, "z")], key=str)


def test_nothing(make_docs):
    assert found_in(make_docs([])) == {}
    assert near_dups.without_near_duplicates(make_docs([])).collect() == []


def test_common_words_across_sets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(2))
        assert near_dups.common(a, b) == len(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(5, 3), (3, 5), (9, 5), (20, 21), (21, 22), (22, 20)]])
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}

from __future__ import annotations

import importlib
import sys

import pytest
from brute import near_components, words

import __spark_entry__ as contract
import corpus_pipeline
from mendwell.llm import toxicity
from mendwell.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and gave."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = corpus_pipeline.stored(stage(spark, given, SF), f"test-{name}")
        out[name] = (given, docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(steps):
    for name, (given, made) in steps.items():
        assert made.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if name == "token_files" else given.columns)


def test_toxic_documents_go(spark, steps):
    given, made = steps["toxicity"]
    scored = toxicity.scored(given, toxicity.train(given, table(spark, SF, "labels")))
    assert ids(made) == {r.doc_id for r in scored.filter("score < 0.3").collect()}
    clean = ids(table(spark, SF, "labels").filter("toxic = 0"))
    assert len(clean - ids(made)) <= 0.02 * len(clean)


def test_one_of_each_group_stays(steps):
    given, made = steps["near_dups"]
    groups = near_components([(r.doc_id, r.text) for r in given.collect()], 5, 80)
    assert ids(made) == {i for i, (_, root) in groups.items() if i == root}


def test_benchmark_documents_go(spark, steps):
    given, made = steps["decontaminate"]
    strip = lambda t: " ".join(w.strip(".,") for w in words(t)).lower()
    items = [strip(r.text) for r in table(spark, SF, "benchmark").collect()]
    gone = ids(given) - ids(made)
    whole = {r.doc_id for r in given.collect() if any(item in strip(r.text) for item in items)}
    assert whole and whole <= gone and len(gone) <= 1.2 * len(whole) + 2


def test_mix_and_files(steps):
    given, made = steps["mixing"]
    size = {r.doc_id: len(words(r.text)) for r in given.collect()}
    taken = {}
    for r in made.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    assert all(n <= 3 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(size.values())) < 0.02 * sum(size.values())
    rows = sorted(steps["token_files"][1].collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in made.collect()) == [r.doc_id for r in rows]


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str) == sorted(map(tuple, steps["token_files"][1].collect()), key=str)


def test_entry_without_the_subpackage(monkeypatch):
    assert "pipeline" in contract.queries() and "op1_html_text" in contract.queries()
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("mendwell.llm") else find(name, *a))
    assert "pipeline" not in contract.queries() and "trips_daily" in contract.queries()


@pytest.mark.parametrize("gone", ["corpus_pipeline", "mendwell.llm"])
def test_entry_with_an_emptied_folder(monkeypatch, gone):
    monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: object())
    assert "pipeline" not in contract.queries() and "trips_daily" in contract.queries() and "op7_line_rules" not in contract.oracle_sql()

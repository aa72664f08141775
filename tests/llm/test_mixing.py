from __future__ import annotations

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from mendwell.llm import mixing
from mendwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def targets(sizes, weights=(5, 2, 1), most=3):
    """Sources in order, null last, share by weight; what is above the most is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(w for s, w in weight.items() if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        more = {s for s in order if s not in full and out[s] > most * sizes[s]}
        if not more:
            return out
        full |= more


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 5}, {"z": 7}, {"a": 0, "b": 50}, {"b": 1, "ä": 1, "Z": 900, "é": 40}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert found == pytest.approx(targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutations(n):
    for salt in (1, 77):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, salt))) == list(range(n))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = {r.doc_id: r for r in QUERIES["op8_mixing"](spark, SF).collect()}
    again = {r.doc_id: r for r in QUERIES["op8_mixing"](spark, SF).collect()}
    assert rows == again and set(rows) == {d.doc_id for d in docs}
    sizes, taken = {}, {}
    for d in docs:
        r = rows[d.doc_id]
        assert r["size"] == len(words(d.text)) and 0 <= r.taken <= 3 * r["size"]
        sizes[d.source] = sizes.get(d.source, 0) + r["size"]
        taken[d.source] = taken.get(d.source, 0) + r.taken
    wanted = targets(sizes)
    for d in docs:
        assert rows[d.doc_id].source_size == sizes[d.source] and rows[d.doc_id].target == pytest.approx(wanted[d.source])
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)


def test_many_small_sources_meet_their_targets(make_docs):
    rows = [(k, " ".join(f"w{k}.{j}" for j in range(10)), f"source{k // 2:03d}") for k in range(400)]
    rows += [(1_000 + k, " ".join("xyz" for _ in range(130)), "zz") for k in range(3)]
    mix = mixing.Mix(make_docs(rows))
    taken, wanted = {}, {}
    for r in mix.taken().collect():
        source = "zz" if r.doc_id >= 1_000 else f"source{r.doc_id // 2:03d}"
        taken[source] = taken.get(source, 0) + r.taken
        wanted[source] = r.target
        assert r.taken <= 3 * r["size"]
    assert len(taken) == 201 and all(abs(taken[s] - wanted[s]) <= 0.5 for s in taken)


def test_slots_are_drawn_and_joined(make_docs):
    text = " ".join(f"w{k}" for k in range(500))
    docs = make_docs([(k, text, "abc"[k % 3]) for k in range(30)])
    mix = mixing.Mix(docs, block=16, shard=64)
    slots = mix.slots.collect()
    assert len({(s.shard, s.slot) for s in slots}) == len(slots) and max(s.slot for s in slots) < 64
    per_shard = {}
    for s in slots:
        per_shard.setdefault(s.shard, []).append(s.sid)
    # Counts differ between shards as draws do, and follow the targets over all.
    assert len({tuple(sorted(v)) for v in per_shard.values()}) > 1
    known = {r.sid: r.n_slots for r in mix.targets.collect()}
    assert {sid: sum(s.sid == sid for s in slots) for sid in known} == known
    blocks = mix.blocks().groupBy("shard", "slot").agg(F.sum("n_words").alias("n")).collect()
    assert all(b.n <= 16 for b in blocks) and sum(b.n == 16 for b in blocks) > 0.95 * len(blocks)


def test_texts_hold_what_is_taken(make_docs):
    rows = [(k, "\n".join(" ".join(f"d{k}.{i}.{j}" for j in range(9)) for i in range(40)), ["big", "small"][k == 0]) for k in range(12)] + [(50, None, "none"), (51, " \n", None)]
    docs = make_docs(rows)
    mix = mixing.Mix(docs, block=16)
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    out = mix.texts().collect()
    assert out and mix.texts().columns == docs.columns
    found = {}
    for r in out:
        own = words(rows[r.doc_id][1])
        got = words(r.text)
        found[r.doc_id] = found.get(r.doc_id, 0) + len(got)
        places = [own.index(w) for w in got]
        assert places == sorted(set(places))
        if len(got) == len(own):
            assert r.text == rows[r.doc_id][1]
    assert found == {k: n for k, n in taken.items() if n}
    # Sources without words leave their share to the others: 4,320 words by 5 to 1.
    assert taken[0] == 720


def test_repeated_rows_and_ids(make_docs):
    text = "a b c d e f g h i j"
    docs = make_docs([(1, text, "s"), (1, text, "s"), (1, text, "t"), (1, "other words here", "s"), (None, text, "s")]).withColumn("sid", F.lit(1)).withColumn("target", F.lit(2))
    mix = mixing.Mix(docs, block=4)
    found = mix.taken().collect()
    assert len(found) == 5 and all(r.taken <= 3 * r["size"] for r in found)
    assert sum(len(words(r.text)) for r in mix.texts().collect()) == sum(r.taken for r in found)


def test_nothing(make_docs):
    mix = mixing.Mix(make_docs([]))
    assert mix.taken().collect() == [] and mix.texts().collect() == []


def test_many_sources_are_drawn_in_groups(spark):
    counts = spark.range(2500).selectExpr("id AS sid", "id % 5 AS n_slots")
    drawn = mixing.drawn_counts(counts, shard=100).collect()
    assert sum(r.n for r in drawn) == 5000 and all(r.sid % 5 for r in drawn)

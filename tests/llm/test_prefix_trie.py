from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import connect, differences

from mendwell.llm import prefix_trie as pt
from mendwell.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING"


def brute(rows):
    """The nodes of (conv_id, turn, role, text) rows on plain values."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), role, told, text))
    seqs = {c: [(t[1], t[3]) for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c, seq in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(seqs.get(base, [])[:h] + seq[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if rebuilt[c] == path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(held), len(path), parent, len(held), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def chats(seed, n=160, ids=None):
    rng = random.Random(seed)
    texts = ["", "a", "bb", "ccc", "dddd", "\U0001f600é"]
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in (ids or range(n)) for t in range(rng.randint(1, 7))]


def test_query_equals_sql(spark, sf_dir):
    assert differences(QUERIES["op11_prefix_trie"](spark, sf_dir), connect(sf_dir), ORACLES["op11_prefix_trie"]) == ""


@pytest.mark.parametrize(("shard_turns", "merged_paths"), [(10**6, 10), (60, 1_000), (12, 4)])
def test_equals_brute_force_with_any_number_of_shards(spark, shard_turns, merged_paths):
    rows = chats(3) + [(c, t, "user", f"same {t}") for c in range(200, 290) for t in range(6)]
    convs = pt.with_shared_openings(pt.stored(pt.sequences(spark.createDataFrame(rows, SCHEMA)), "c"))
    assert result(pt.trie(convs, shard_turns, merged_paths)) == brute(rows)


def test_ties_repeats_nulls_and_negative_ids(spark):
    rows = chats(8, ids=[-7, -150, 0, 5, 100, 105, 199, 2**62]) + [(5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "assistant", "x"), (5, 1, "user", "a")]
    rows += [(7, None, None, None), (7, None, "user", "late"), (7, 3, None, "t"), (None, 0, "user", "x"), (107, None, "user", None)]
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_turnless_conversations_belong_to_the_root(spark):
    # No conversation 300: those with more leading turns than they have keep none.
    short = [c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 1][:5]
    rows = [(c, 0, "user", "x") for c in short]
    got = result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) == [(short[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]


def test_members_of_one_sequence_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 7)
    rows = [(c, 0, "user", "hello") for c in range(1_000, 1_900)]
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_empty_table_long_texts_and_clashing_columns(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(0, 0, "user", "long " * 100_000), (100, 0, "user", "y"), (0, 1, "user", "z")] + [(200, t, "user", "deep") for t in range(80)]
    named = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS seq", "2 AS chars", "3 AS digest", "4 AS least", "5 AS depth")
    assert result(pt.prefix_trie(named)) == brute(rows)


def test_tree_is_balanced_and_in_order():
    tree = pt.TernaryTree()
    for k in pt.medians_first(1_000):
        tree.insert([k], [1])
    deepest, todo = 0, [(tree.first[0], 1)]
    while todo:
        node, level = todo.pop()
        if node != pt.NONE:
            deepest = max(deepest, level)
            assert tree.low[node] == pt.NONE or tree.code[tree.low[node]] < tree.code[node]
            assert tree.high[node] == pt.NONE or tree.code[tree.high[node]] > tree.code[node]
            todo += [(tree.low[node], level + 1), (tree.high[node], level + 1)]
    assert deepest == 10 and sorted(pt.medians_first(1_000)) == list(range(1_000))

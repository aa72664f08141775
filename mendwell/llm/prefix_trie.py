"""A prefix trie of conversations over dictionary-encoded turns.

Equal sequences are counted first. The distinct ones are dealt by range into shards; each shard
keeps its sequences in a ternary search tree, balanced by inserting medians first, and sums up
members, leaves and savings from the leaves to the root. Nodes on the path of a shard's first or last
sequence may go on in its neighbours: their sums are handed on, one row per path, and merged
in the same way by a task for many shards, until one shard is left.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.llm.common import drop_stored, stored
from mendwell.session import broadcast_if_small

# Turns of the distinct sequences of one shard, and paths that one task merges.
SHARD_TURNS, MERGED_PATHS = 20_000, 2_000
# Conversation ids in one piece of a sequence's list of members.
CHUNK = 4_096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NONE = -1
# Stands for no member so far; also the largest id, so a minimum is right either way.
NOBODY = 2**63 - 1

# What a path hands on, for each of its nodes from the root down: members, smallest member, leaves, savings, children, digest of ends.
PATH = "seq ARRAY<LONG>, chars ARRAY<LONG>, members ARRAY<LONG>, least ARRAY<LONG>, leaves ARRAY<LONG>, saved ARRAY<LONG>, children ARRAY<LONG>, ends ARRAY<STRING>"
NODE = "conv_id LONG, depth LONG, parent_conv_id LONG, n_convs LONG, n_children LONG, n_leaves LONG, saved_tokens LONG, ends_sha256 STRING"
SUMS = ("members", "leaves", "saved", "children")


# --- sequences ---------------------------------------------------------------------


def _digest(role: Column, text: Column) -> Column:
    """Tells every (role, text) from every other."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def encoded(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, code, chars``: each distinct (role, text) has a number of its own."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    told = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    told = told.select("conv_id", "turn", "role", _digest(F.col("role"), F.col("text")).alias("digest"), F.length("text").cast("long").alias("chars"))
    distinct = stored(told.groupBy("digest").agg(F.first("chars").alias("chars")), "turns")
    dictionary = stored(distinct.select("digest", "chars", F.monotonically_increasing_id().alias("code")), "dictionary")
    return told.drop("chars").join(broadcast_if_small(dictionary), "digest")


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, chars``: the codes of each conversation in order of its turns, null first; ties by role, then digest."""
    held = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "code", "chars")))
    return encoded(turns).groupBy("conv_id").agg(held.alias("_t")).select(
        "conv_id", F.transform("_t", lambda t: t["code"]).alias("seq"), F.transform("_t", lambda t: t["chars"]).alias("chars")
    )


def with_shared_openings(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation behind the opening of its group's: its first crc32(id) % ``most`` turns are those of ``id - id % group``."""
    heads = convs.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_base"), F.slice("seq", 1, most - 1).alias("_seq"), F.slice("chars", 1, most - 1).alias("_chars")
    )
    keyed = convs.select("*", (F.col("conv_id") - F.col("conv_id") % group).alias("_base"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("_h"))
    none = F.array().cast("array<bigint>")

    def rebuilt(own: str, head: str) -> Column:
        rest = F.when(F.size(own) > F.col("_h"), F.slice(own, F.col("_h") + 1, F.greatest(F.size(own) - F.col("_h"), F.lit(0)))).otherwise(none)
        return F.concat(F.slice(F.coalesce(head, none), F.lit(1), F.col("_h")), rest).alias(own)

    return keyed.join(heads, "_base", "left").select("conv_id", rebuilt("seq", "_seq"), rebuilt("chars", "_chars"))


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of at most ``CHUNK`` ids of one sequence as text, from rows in order of sequence and id."""
    key, ids = None, []

    def row() -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "least": [ids[0]], "n": [len(ids)], "text": [",".join(map(str, ids))]})

    for frame in frames:
        for this, conv in zip(frame["key"], frame["conv_id"].tolist(), strict=True):
            if ids and (this != key or len(ids) == CHUNK):
                yield row()
                ids = []
            key = this
            ids.append(conv)
    if ids:
        yield row()


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per sequence from its chunks in order: members, the smallest one, and the digest of them all."""
    key, n, least, digest = None, 0, 0, None
    for frame in frames:
        done = []
        for r in frame.itertuples():
            if r.key != key:
                if digest is not None:
                    done.append((key, n, least, digest.hexdigest()))
                key, n, least, digest = r.key, 0, r.least, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(r.text.encode())
            n += r.n
        if done:
            yield pd.DataFrame(done, columns=["key", "n", "least", "ends"])
    if digest is not None:
        yield pd.DataFrame([(key, n, least, digest.hexdigest())], columns=["key", "n", "least", "ends"])


def distinct_paths(convs: DataFrame) -> DataFrame:
    """``PATH`` rows, one per distinct sequence; all its members stand at its last node.

    Members of one sequence are dealt by range of their ids, so a sequence of very many is
    written as text by many tasks; one task then digests the few chunks in order.
    """
    keyed = stored(convs.select("*", F.sha2(F.array_join(F.col("seq").cast("array<string>"), ","), 256).alias("key")), "sequences")
    n_convs = max(1, keyed.count())
    members = keyed.select("key", "conv_id").repartitionByRange(max(1, -(-n_convs // 100_000)), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = members.mapInPandas(_chunks, "key STRING, least LONG, n LONG, text STRING")
    ends = stored(chunks.repartition("key").sortWithinPartitions("key", "least").mapInPandas(_ends, "key STRING, n LONG, least LONG, ends STRING"), "ends", batch=256)
    one = keyed.join(ends.select("key", F.col("least").alias("conv_id"), "n", "ends"), ["key", "conv_id"])
    depth = F.size("seq")

    def at_end(value: Column, elsewhere: Column) -> Column:
        return F.concat(F.array_repeat(elsewhere, depth), F.array(value))

    zero = F.lit(0).cast("long")
    zeros = F.array_repeat(zero, depth + 1)
    return one.select(
        "seq",
        "chars",
        at_end(F.col("n"), zero).alias("members"),
        at_end(F.col("conv_id"), F.lit(NOBODY)).alias("least"),
        zeros.alias("leaves"),
        zeros.alias("saved"),
        zeros.alias("children"),
        at_end(F.col("ends"), F.lit("")).alias("ends"),
    )


# --- ternary search tree -----------------------------------------------------------


class TernaryTree:
    """Sequences of codes; every node but the root is one prefix.

    Nodes of one parent form a binary tree through ``low`` and ``high``; ``first`` leads to the
    children. A parent has a smaller number than its children, so sums go up by walking the numbers down.
    """

    def __init__(self) -> None:
        self.code, self.low, self.high, self.first, self.parent, self.depth, self.chars = (array("q", [v]) for v in (NONE, NONE, NONE, NONE, NONE, 0, 0))

    def __len__(self) -> int:
        return len(self.code)

    def _new(self, code: int, parent: int, chars: int) -> int:
        for column, value in ((self.code, code), (self.low, NONE), (self.high, NONE), (self.first, NONE), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.chars, chars)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, seq: list[int], chars: list[int]) -> list[int]:
        """The nodes of the sequence's prefixes, the root first; those missing are made."""
        at, path = 0, [0]
        for code, size in zip(seq, chars, strict=True):
            link, holder, node = self.first, at, self.first[at]
            while node != NONE and self.code[node] != code:
                link, holder = (self.low, node) if code < self.code[node] else (self.high, node)
                node = link[holder]
            if node == NONE:
                node = self._new(code, at, size)
                link[holder] = node
            at = node
            path.append(at)
        return path


def medians_first(n: int) -> Iterator[int]:
    """0 to ``n - 1``: the middle, then the middles of both halves, and so on."""
    spans = [(0, n)]
    for start, end in spans:
        if start < end:
            middle = (start + end) // 2
            yield middle
            spans += [(start, middle), (middle + 1, end)]


def prefix_keys(seq: list[int]) -> list[str]:
    """Tells the path of each prefix of a sequence from every other, the empty one's first."""
    digest = hashlib.sha256()
    keys = [digest.hexdigest()]
    for code in seq:
        digest.update(code.to_bytes(8, "big", signed=True))
        keys.append(digest.copy().hexdigest())
    return keys


def merged(paths: pd.DataFrame, first: bool, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Finished nodes, and what the paths of the first and last sequence hand on, of a shard's paths in order.

    With ``last`` there are no neighbours and every node is finished. A finished node whose parent
    isn't has the key of its parent's path instead of ``parent_conv_id``. After the ``first`` round all nodes
    were open before, so they carry their own key.
    """
    tree, nodes = TernaryTree(), [None] * len(paths)
    seqs, chars = [v.tolist() for v in paths["seq"]], [v.tolist() for v in paths["chars"]]
    for k in medians_first(len(paths)):
        nodes[k] = tree.insert(seqs[k], chars[k])
    n = len(tree)
    sums = {c: np.zeros(n, np.int64) for c in SUMS}
    least, ends = np.full(n, NOBODY), [""] * n
    for path, r in zip(nodes, paths.itertuples(), strict=True):
        for name in SUMS:
            sums[name][path] += getattr(r, name)
        least[path] = np.minimum(least[path], r.least)
        for node, digest in zip(path, r.ends, strict=True):
            ends[node] = ends[node] or digest
    open_nodes = set() if last else {*nodes[0], *nodes[-1]}
    members, leaves, saved, children = (sums[c] for c in SUMS)
    for node in range(n - 1, -1, -1):
        if node in open_nodes:
            continue
        if not children[node]:
            leaves[node] += 1
        saved[node] += (members[node] - 1) * tree.chars[node]
        parent = tree.parent[node]
        if parent != NONE:
            for name in ("members", "leaves", "saved"):
                sums[name][parent] += sums[name][node]
            least[parent] = min(least[parent], least[node])
            children[parent] += 1
    keyed = range(len(paths)) if not first else () if last else (0, len(paths) - 1)
    keys = {node: key for k in keyed for node, key in zip(nodes[k], prefix_keys(seqs[k]), strict=True)}
    done = [k for k in range(n) if k not in open_nodes]
    parents = [tree.parent[k] for k in done]
    finished = pd.DataFrame(
        {
            "conv_id": least[done],
            "depth": [tree.depth[k] for k in done],
            "parent_conv_id": pd.array([None if p == NONE or p in open_nodes else int(least[p]) for p in parents], dtype="Int64"),
            "n_convs": members[done],
            "n_children": children[done],
            "n_leaves": leaves[done],
            "saved_tokens": saved[done],
            "ends_sha256": [ends[k] or NO_ENDS for k in done],
            "parent_key": [keys[p] if p in open_nodes else None for p in parents],
            "own_key": [None if first else keys[k] for k in done],
        }
    )
    handed, told = [], set()
    for k in () if last else sorted({0, len(paths) - 1}):
        # A node on both paths hands on its sums once.
        fresh = [node not in told for node in nodes[k]]
        told |= set(nodes[k])
        row = {"seq": seqs[k], "chars": chars[k]}
        row |= {c: [int(sums[c][node]) if f else 0 for node, f in zip(nodes[k], fresh, strict=True)] for c in SUMS}
        row["least"] = [int(least[node]) if f else NOBODY for node, f in zip(nodes[k], fresh, strict=True)]
        row["ends"] = [ends[node] if f else "" for node, f in zip(nodes[k], fresh, strict=True)]
        handed.append(row)
    return finished, pd.DataFrame(handed, columns=_names(PATH))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


# --- shards ------------------------------------------------------------------------

_KEYS = "parent_key STRING, own_key STRING"


def _merger(first: bool, last: bool):
    names = _names(f"{NODE}, {_KEYS}, {PATH}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            for frame in merged(pd.concat(held, ignore_index=True), first, last):
                if len(frame):
                    yield frame.assign(**{c: None for c in names if c not in frame})[names]

    return run


def merge_round(paths: DataFrame, shards: int, first: bool) -> DataFrame:
    """Finished nodes (without ``seq``) and paths handed on (with it) of all shards; a single shard finishes all."""
    last = shards == 1
    dealt = paths.repartition(1) if last else paths.repartitionByRange(shards, "seq")
    ordered = dealt.sortWithinPartitions("seq")
    return stored(ordered.mapInPandas(_merger(first, last), f"{NODE}, {_KEYS}, {PATH}"), "trie-round", batch=1_000)


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS, merged_paths: int = MERGED_PATHS) -> DataFrame:
    """One row per node of the trie of ``conv_id, seq, chars``.

    A shard holds about ``shard_turns`` turns of distinct sequences, and each round of merging
    leaves two paths of a shard, so a last task reads a bounded number of paths.
    """
    paths = stored(distinct_paths(convs), "paths")

    def size(of: DataFrame) -> tuple[int, int]:
        n, turns = of.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("seq") + 1), F.lit(0))).first()
        return n, turns

    shards, rounds = max(1, -(-size(paths)[1] // shard_turns)), []
    while True:
        rounds.append(merge_round(paths, shards, not rounds))
        if shards == 1:
            break
        if len(rounds) == 1:
            drop_stored(paths)
        paths = rounds[-1].filter("seq IS NOT NULL").select(*_names(PATH))
        n, turns = size(paths)
        fewer = max(1, -(-n // merged_paths), -(-turns // (50 * shard_turns)))
        shards = fewer if fewer < shards else 1
    done = [r.filter("seq IS NULL").drop(*_names(PATH)) for r in rounds]
    nodes = done[0]
    for r in done[1:]:
        nodes = nodes.unionByName(r)
    plain = nodes.filter("parent_key IS NULL").select(*_names(NODE))
    if len(done) == 1:
        return plain
    opened = nodes.filter("own_key IS NOT NULL").select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    below = nodes.filter("parent_key IS NOT NULL").join(broadcast_if_small(opened), "parent_key").withColumn("parent_conv_id", F.col("_parent"))
    return plain.unionByName(below.select(*_names(NODE)))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, turn, role, text``; turns are ordered by number, null first, then by role and a digest
    of the text, and repeated rows are turns of their own. Null roles and texts are empty; rows without conversation take no part; other
    columns are ignored. Every conversation stands behind the opening of its group's first one
    (``with_shared_openings``). The root has depth 0, an empty table no node. ``saved_tokens`` are
    the code points that members share, each node's but for one of its members. A
    conversation is one row and so has to fit in a task.
    """
    convs = stored(sequences(turns), "conversations")
    return trie(with_shared_openings(convs))

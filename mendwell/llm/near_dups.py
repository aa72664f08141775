"""MinHash near-duplicates: many universal hash minima, banding, confirmation on full sets, connected components.

Documents with equal shingle sets are one class, and classes are what is compared. The minima of a
class are cut into bands; classes that agree in a band share a bucket. Not all pairs of a bucket are
listed. Each class is first compared with the smallest class it shares a bucket
with, then with the smallest of each bucket where they are still apart. Only buckets that
still hold classes of different components, the smallest aside, are compared pair by pair, in blocks,
until their classes are connected. Every link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwell.llm.common import stored
from mendwell.llm.graph import components
from mendwell.session import broadcast_if_small

BANDS, ROWS = 28, 5
SEED = 20240229
# Classes of a bucket that are compared in one block.
BLOCK = 1000
SKETCH = "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>, minima binary"


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of the whole sequence if it is shorter; none without words."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(width, len(found))
    odd = np.random.default_rng(SEED + size).integers(0, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    held = np.zeros(len(found) - size + 1, np.uint64)
    for k in range(size):
        held = (held ^ words[k : k + len(held)]) * odd[k]
        held ^= held >> np.uint64(31)
    return np.unique(held)


def minima(held: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest value of each hash ``a * x + b`` over a set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 512):
        np.minimum(least, (np.multiply.outer(multipliers, held[at : at + 512]) + offsets[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    return int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """Per row the size and digest of its shingle set, band keys and minima; no digest without words."""
    rng = np.random.default_rng(SEED)
    multipliers = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, bands * rows, np.uint64)
    mix = rng.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sizes, digests, keys, lows = [], [], [], []
                for text in batch.column("text").to_pylist():
                    held = shingles(text, width)
                    sizes.append(len(held))
                    if not len(held):
                        digests.append(None), keys.append(None), lows.append(None)
                        continue
                    low = minima(held, multipliers, offsets)
                    each = (low.reshape(bands, rows).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64)
                    each = (each ^ (each >> np.uint64(29))) * mix[0] + np.arange(bands, dtype=np.uint64)
                    digests.append(hashlib.blake2b(held.tobytes(), digest_size=16).digest())
                    keys.append(each.view(np.int64))
                    lows.append(low.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "keys", "minima"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return given.mapInArrow(sketch, SKETCH)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``u, v``) whose full sets are linked. Texts meet in plain joins, in which hot classes are split."""
    mine = texts.select(F.col("digest").alias("u"), F.col("text").alias("_left"))
    hubs = texts.select(F.col("digest").alias("v"), F.col("text").alias("_right"))
    met = pairs.join(mine, "u").join(hubs, "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                us, vs, found = batch.column("u").to_pylist(), batch.column("v").to_pylist(), []
                lefts, rights = batch.column("_left"), batch.column("_right")
                for k, v in enumerate(vs):
                    # Rows of one class follow one another after the join.
                    if last[0] != v:
                        last = (v, shingles(rights[k].as_py(), width))
                    found.append(linked(shingles(lefts[k].as_py(), width), last[1], percent))
                kept = [k for k, yes in enumerate(found) if yes]
                yield pa.RecordBatch.from_arrays([pa.array([us[k] for k in kept], pa.binary()), pa.array([vs[k] for k in kept], pa.binary())], names=["u", "v"])

    return met.mapInArrow(check, "u binary, v binary")


def in_blocks(members: DataFrame, texts: DataFrame, width: int, percent: int, n_hashes: int, block: int = BLOCK) -> DataFrame:
    """Links (``u, v``) that connect the classes of each bucket as far as their sets allow.

    ``members`` has ``key, digest, root, minima``. Buckets are cut into blocks of about
    ``block`` classes, and each task compares two blocks. Pairs already connected are
    passed over, and so are pairs whose minima agree five standard deviations less than
    linked sets do. A task returns at most one link for each of its classes.
    """
    share = percent / 100
    least = n_hashes * share - 5 * (n_hashes * share * (1 - share)) ** 0.5
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    placed = members.join(sizes, "key").withColumn("_mine", F.pmod(F.xxhash64("digest"), F.col("_blocks")).cast("int"))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("key", F.least("_mine", "_other").alias("_a"), F.greatest("_mine", "_other").alias("_b"), "digest", "root", "minima")

    def connect(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("digest")
        digests, lows = rows["digest"].tolist(), np.stack([np.frombuffer(x, "<u4") for x in rows["minima"]])
        sets = [shingles(text, width) for text in rows["text"]]
        group = pd.factorize(rows["root"])[0]
        found = []
        for k in range(1, len(digests)):
            agree = (lows[:k] == lows[k]).sum(axis=1)
            # Most alike first, so that the rest is soon connected.
            for j in np.argsort(-agree, kind="stable"):
                if agree[j] < least:
                    break
                if group[j] != group[k] and linked(sets[j], sets[k], percent):
                    found.append((digests[j], digests[k]))
                    group[group == group[k]] = group[j]
        return pd.DataFrame(found, columns=["u", "v"])

    return met.join(texts, "digest").groupBy("key", "_a", "_b").applyInPandas(connect, "u binary, v binary")


def labelled(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are what stands between white space, A-Z in lower case. Documents are
    linked if ``100 * intersection >= percent * union`` of their distinct
    ``width``-word shingles. Shorter documents have one shingle, null and blank texts none and no
    links. ``component_id`` is the smallest id reachable, ``kept`` marks the document of that id.
    Rows of equal text are linked, so a repeated row and its double are both marked. A row
    without id has no component and is kept; it links others only where a row with id has its words.
    Other columns are ignored.

    A pair at the threshold shares no band with probability ``(1 - s ** rows) ** bands``,
    1.5e-5 at 0.8 and 7e-8 at 0.85 with the defaults. The minima of a class take 560 bytes; no group is
    gathered whole.
    """
    sketch = stored(sketches(docs, id_col, text_col, width, bands, rows), "sketch", batch=1000)
    worded = sketch.filter(F.col("digest").isNotNull())
    banded = worded.select("digest", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("digest").alias("hub"), F.max("digest").alias("_top")).filter("hub <> _top").drop("_top")
    members = stored(banded.join(buckets, "key").filter("digest <> hub").distinct(), "members")

    # One text of each class that shares a bucket.
    wanted = members.select("digest").unionAll(members.select(F.col("hub").alias("digest"))).distinct()
    # Ids that repeat are told apart by their digests.
    holder = worded.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("_holder"))
    wanted = stored(wanted.join(holder, "digest"), "wanted")
    source = docs.select(F.col(id_col).cast("long").alias("_holder"), F.col(text_col).alias("text"))
    found = source.join(broadcast_if_small(wanted), "_holder").select("digest", "text")
    texts = stored(found.mapInArrow(_of_digest(width), "digest binary, text string").dropDuplicates(["digest"]), "texts", batch=1000)

    first = members.groupBy(F.col("digest").alias("u")).agg(F.min("hub").alias("v"))
    links = stored(confirmed(first, texts, width, percent), "links", batch=1000)
    roots = components(links)

    def rooted(df: DataFrame, column: str, name: str) -> DataFrame:
        near = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
        return df.join(near, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")

    pairs = members.select(F.col("digest").alias("u"), F.col("hub").alias("v")).distinct().join(first, ["u", "v"], "left_anti")
    apart = rooted(rooted(pairs, "u", "_ur"), "v", "_vr").filter("_ur <> _vr").select("u", "v")
    more = stored(confirmed(apart, texts, width, percent), "links", batch=1000)
    if not more.isEmpty():
        links = links.unionAll(more)
        roots = components(links)

    # Buckets whose classes, the smallest aside, are still in several components.
    at = rooted(members.select("key", "digest"), "digest", "root")
    mixed = at.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("key")
    rest = at.join(mixed, "key", "left_semi")
    lows = worded.select("digest", "minima").join(rest.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    last = stored(in_blocks(rest.join(lows, "digest"), texts, width, percent, bands * rows, block), "links")
    if not last.isEmpty():
        roots = components(links.unionAll(last))

    classes = rooted(worded.groupBy("digest").agg(F.min("doc_id").alias("_id")), "digest", "root")
    smallest = classes.groupBy("root").agg(F.min("_id").alias("_smallest"))
    named = classes.join(smallest, "root").select("digest", "_smallest")
    out = sketch.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_smallest", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``, see ``labelled``."""
    return labelled(docs, **options).drop("text_hash")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id, and all rows without id.

    Of rows that agree in id and text one stays. Only what goes is joined with the documents.
    """
    found = labelled(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept")
    found = stored(found.filter("_id IS NOT NULL"), "verdicts")
    gone = found.filter("NOT kept").select("_id", "_hash").distinct()
    own = docs.select("*", F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"))
    if not found.filter("kept").groupBy("_id", "_hash").count().filter("count > 1").isEmpty():
        named = own.filter("_id IS NOT NULL").dropDuplicates(["_id", "_hash"])
        own = named.unionByName(own.filter("_id IS NULL"))
    return own.join(broadcast_if_small(gone), ["_id", "_hash"], "left_anti").select(*docs.columns)


def _of_digest(width: int):
    """Rows whose text has the digest they name; the others stem from another row of the same id."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                right = [
                    hashlib.blake2b(shingles(text, width).tobytes(), digest_size=16).digest() == digest
                    for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True)
                ]
                yield batch.filter(pa.array(right))

    return check

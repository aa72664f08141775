"""Mixing sources to target weights by fixed-length blocks of words.

The words of a source form a stream of blocks. Output shards have a fixed number of
slots; for each, source counts are drawn from the multinomial law of the targets. The slots of a source are numbered
over all shards, and pseudorandom permutations map numbers to blocks, so that nothing is drawn twice and
nothing has to be remembered. Slots and blocks meet in a join by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.llm.common import stored, words

SEED = 7
WEIGHTS = (5, 2, 1)
MOST = 3
# Words of a block, and slots of an output shard.
BLOCK, SHARD = 64, 2048
# Parts that a source's documents are laid out in, and sources whose counts are drawn together.
LANES, GROUP = 1024, 1000


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, sid, source_size, weight, target`` from ``source, source_size``.

    Sources in code point order, null last, take the weights in turn and share all
    words by them. A target stops at ``most`` times its source's size, and what is over goes to the others by
    weight until none is above. Each pass sums over the sources, so that no list of
    them reaches the driver. Numbering the sources puts one row of each in order.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select("source", "source_size", (rank - 1).alias("sid"))
    ranked = stored(ranked.withColumn("weight", F.get(cycle, (F.col("sid") % len(weights)).cast("int"))), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    per_weight, full = 0.0, F.lit(False)
    before = -1
    while True:
        held = ranked.select("source_size", "weight", full.alias("full"))
        n_full, taken, open_weight = held.agg(
            F.count_if("full"), F.coalesce(F.sum(F.when(F.col("full"), most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0))
        ).first()
        if n_full == before or not open_weight:
            break
        before, per_weight = n_full, float(total - taken) / open_weight
        # A source that is full stays full: the share of the others only grows.
        full = F.lit(per_weight) * F.col("weight") > most * F.col("source_size")
    target = F.least(F.lit(per_weight) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return ranked.withColumn("target", target)


def block_counts(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``targets`` with ``n_blocks``, ``n_full``, ``n_slots``, ``last_words``: whole passes over a source take all its blocks, the rest as many as its words need.

    The last of ``n_slots`` takes only the ``last_words`` that remain of the target, so that every source meets it to the word.
    """
    size, target = F.col("source_size"), F.col("target")
    blocks = F.ceil(size / block)
    passes = F.when(size > 0, F.floor(target / size)).otherwise(0)
    rest = F.coalesce(F.round(target - passes * size).cast("long"), F.lit(0).cast("long"))
    extra = F.ceil(rest / block)
    return targets.select(
        "*",
        blocks.alias("n_blocks"),
        F.floor(size / block).alias("n_full"),
        (passes * blocks + extra).alias("n_slots"),
        F.when(extra > 0, rest - (extra - 1) * block).otherwise(block).cast("long").alias("last_words"),
    )


def permuted(at: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Pseudorandom permutations of ``range(size)``, one for each salt: four Feistel rounds, repeated while outside."""
    at, size, salt = at.astype(np.uint64), size.astype(np.uint64), salt.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    half = half.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = at.copy(), np.arange(len(at))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for k in range(4):
            mixed = (right + salt[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def drawn_counts(counts: DataFrame, shard: int = SHARD, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``shard, sid, n``: how many slots of each output shard each source gets.

    A shard's slots are first dealt to groups of ``group`` sources, then each group's to its
    sources, so that no task holds the weights of all sources. What a task is sent is one
    number for each group.
    """
    grouped = counts.filter("n_slots > 0").groupBy(F.floor(F.col("sid") / group).alias("_group")).agg(F.sort_array(F.collect_list(F.struct("sid", "n_slots"))).alias("_sources"), F.sum("n_slots").alias("_slots"))
    grouped = stored(grouped, "groups")
    shares = sorted((row[0], row[1]) for row in grouped.select("_group", "_slots").collect())
    n_slots = sum(n for _, n in shares)
    ids, law = np.array([g for g, _ in shares], np.int64), np.array([n for _, n in shares], float) / max(1, n_slots)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["shard"]:
                n = min(shard, n_slots - number * shard)
                dealt = np.random.default_rng([seed, int(number)]).multinomial(n, law)
                yield pd.DataFrame({"shard": number, "_group": ids[dealt > 0], "_n": dealt[dealt > 0]})

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, g, n, sources in frame[["shard", "_group", "_n", "_sources"]].itertuples(index=False):
                slots = np.array([s["n_slots"] for s in sources], float)
                dealt = np.random.default_rng([seed, int(number), int(g)]).multinomial(n, slots / slots.sum())
                yield pd.DataFrame({"shard": number, "sid": np.array([s["sid"] for s in sources], np.int64)[dealt > 0], "n": dealt[dealt > 0]})

    shards = grouped.sparkSession.range(-(-n_slots // shard)).withColumnRenamed("id", "shard")
    met = shards.mapInPandas(first, "shard long, _group long, _n long").join(grouped, "_group")
    return met.mapInPandas(second, "shard long, sid long, n long")


def slots(counts: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``shard, slot, sid, block, turn, last_words``: every output slot with its source's block and how often that was taken before.

    A pass over a source takes its full blocks in a pseudorandom order and then its short one. ``last_words`` is set for a source's last slot.

    Drawn counts miss a source's slots by chance. A pseudorandom choice of the slots that are too many goes to the sources
    that have too few, so that every source takes exactly ``n_slots``.
    """
    drawn = stored(drawn_counts(counts, shard, seed), "drawn")
    per_source = drawn.groupBy("sid").agg(F.sum("n").alias("_drawn"))
    own = ["n_slots", "n_blocks", "n_full", "last_words"]
    known = counts.select("sid", *own).join(per_source, "sid", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    over, under = F.greatest(F.col("_drawn") - F.col("n_slots"), F.lit(0)), F.greatest(F.col("n_slots") - F.col("_drawn"), F.lit(0))
    # One row for each source.
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    known = stored(known.select("*", F.coalesce(F.sum(over).over(before), F.lit(0)).alias("_over"), F.coalesce(F.sum(under).over(before), F.lit(0)).alias("_under")), "known")

    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    begun = drawn.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_from"), F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_at"))
    each = begun.select("shard", "sid", "_from", "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_k"))
    each = each.join(known, "sid").select("shard", (F.col("_at") + F.col("_k")).alias("slot"), "sid", (F.col("_from") + F.col("_k")).alias("_number"), "_drawn", *own, "_over")

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["_number"] = permuted(frame["_number"].to_numpy(), frame["_drawn"].to_numpy(), frame["sid"].to_numpy() * 2 + seed * 1_000_003)
            yield frame[["shard", "slot", "sid", "_number", *own, "_over"]]

    picked = each.mapInPandas(chosen, f"shard long, slot long, sid long, _number long, {', '.join(f'{c} long' for c in own)}, _over long")
    picked = stored(picked, "picked")
    fits = picked.filter("_number < n_slots").select("shard", "slot", "sid", "_number", *own)
    spare = picked.filter("_number >= n_slots").select("shard", "slot", (F.col("_over") + F.col("_number") - F.col("n_slots")).alias("_x"))
    short = known.filter("n_slots > _drawn").select("sid", *own, "_under", "_drawn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - F.col("_drawn") - 1)).alias("_k"))
    filled = spare.join(short.select("sid", *own, (F.col("_under") + F.col("_k")).alias("_x"), (F.col("_drawn") + F.col("_k")).alias("_number")), "_x")
    numbered = fits.unionByName(filled.drop("_x"))

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            number, size = frame["_number"].to_numpy(), frame["n_blocks"].to_numpy()
            place, full = number % size, frame["n_full"].to_numpy()
            inner = place < full
            block = place.copy()
            block[inner] = permuted(place[inner], full[inner], frame["sid"].to_numpy()[inner] * 2 + 1 + seed * 1_000_003)
            frame["block"], frame["turn"] = block, number // size
            frame["last_words"] = frame["last_words"].astype("Int64").where(frame["_number"] == frame["n_slots"] - 1)
            yield frame[["shard", "slot", "sid", "block", "turn", "last_words"]]

    return numbered.mapInPandas(mapped, "shard long, slot long, sid long, block long, turn long, last_words long")


def layout(sized: DataFrame, lanes: int = LANES) -> DataFrame:
    """``sized`` (``_doc, sid, _size``) with ``_at``, the words of its source before it, in an order given by hashes.

    A source is laid out in lanes, whose totals are summed before the documents of
    each, so that a large source is many groups.
    """
    placed = sized.withColumn("_lane", F.pmod(F.col("_order"), F.lit(lanes)))
    totals = placed.groupBy("sid", "_lane").agg(F.sum("_size").alias("_lane_size"))
    ahead = Window.partitionBy("sid").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("sid", "_lane", F.coalesce(F.sum("_lane_size").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("sid", "_lane").orderBy("_order", "_doc").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_within", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return own.join(bases, ["sid", "_lane"]).withColumn("_at", F.col("_base") + F.col("_within")).drop("_lane", "_base", "_within")


class Mix:
    """A mix of ``docs``: ``documents`` (one row each, with target), ``segments`` (words of documents in blocks) and ``slots``.

    Null text has no words; a null source is a source, the last. Rows that share an id are
    told apart by their texts and sources, and repeated rows are laid out once more each. An
    empty table gives empty results. Everything follows from the seed and the rows: reruns agree.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED):
        self.docs, self.id_col, self.text_col, self.source_col = docs, id_col, text_col, source_col
        rows = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("_size"), F.xxhash64(text_col, source_col).alias("_hash")
        )
        # Repeated rows are one row with a count from here on.
        rows = stored(rows.groupBy("doc_id", "source", "_hash", "_size").agg(F.count(F.lit(1)).alias("_copies")), "sizes")
        sizes = rows.groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("source_size"))
        self.targets = stored(block_counts(source_targets(sizes), block), "targets")
        named = rows.join(self.targets, rows["source"].eqNullSafe(self.targets["source"])).drop(self.targets["source"])
        order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_hash"))
        self.documents = stored(named.select("doc_id", "source", "_hash", "_size", "_copies", "sid", "source_size", "target", order.alias("_order")), "documents")
        copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
        each = self.documents.filter("_size > 0").withColumn("copy", copies).select("sid", "_size", "_order", F.struct("doc_id", "_hash", "copy").alias("_doc"))
        laid = layout(each)
        first, last = F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_size") - 1) / block)
        cut = laid.select("sid", "_doc", "_at", "_size", F.explode(F.sequence(first, last)).alias("block"))
        low = F.greatest(F.col("block") * block, F.col("_at"))
        high = F.least((F.col("block") + 1) * block, F.col("_at") + F.col("_size"))
        self.segments = cut.select("sid", "block", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc._hash").alias("_hash"), F.col("_doc.copy").alias("copy"), (low - F.col("_at")).alias("first_word"), (high - low).alias("n_words"), (low - F.col("block") * block).alias("_in_block"))
        self.slots = slots(self.targets, shard, seed)

    def blocks(self) -> DataFrame:
        """``shard, slot, sid, block, turn, doc_id, _hash, copy, first_word, n_words``: the mix, slot by slot."""
        most = F.coalesce(F.least("n_words", F.col("last_words") - F.col("_in_block")), "n_words")
        return self.slots.join(self.segments, ["sid", "block"]).withColumn("n_words", most).filter("n_words > 0").drop("last_words", "_in_block")

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` for every row of the documents, repeated ones included."""
        given = self.blocks().groupBy("doc_id", "_hash", "copy").agg(F.sum("n_words").alias("taken"))
        each = self.documents.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("d._hash").eqNullSafe(F.col("g._hash")) & (F.col("d.copy") == F.col("g.copy"))
        return each.alias("d").join(given.alias("g"), same, "left").select(
            "d.doc_id", F.col("d._size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )

    def texts(self) -> DataFrame:
        """The rows of ``docs`` as the mix takes them: one for each turn, with the words taken in it.

        A document taken whole keeps its text; of others the taken words stay, each with the white space behind it. Documents
        that nothing is taken of go. The words of a turn are a list of spans no longer than the document.
        """
        spans = self.blocks().groupBy("doc_id", "_hash", "copy", "turn").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_spans"), F.sum("n_words").alias("_taken"))
        # Copies are equal: any of them may stand for its turn.
        numbered = spans.drop("copy", "turn").withColumnRenamed("doc_id", "_mix_id").withColumnRenamed("_hash", "_mix_hash")
        keyed = self.docs.select("*", F.col(self.id_col).cast("long").alias("_own_id"), F.xxhash64(self.text_col, self.source_col).alias("_own_hash"))
        if not self.documents.filter("_copies > 1").isEmpty():
            keyed = keyed.dropDuplicates(["_own_id", "_own_hash"])
        met = keyed.join(numbered, F.col("_own_id").eqNullSafe(F.col("_mix_id")) & (F.col("_own_hash") == F.col("_mix_hash")))
        text = F.regexp_replace(F.col(self.text_col), r"^[\x20\x09-\x0D]+", "")
        pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
        cut = F.transform(F.array(pieces), lambda held: F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(held, (s["first_word"] + 1).cast("int"), s["n_words"].cast("int")))), ""))
        whole = F.when(F.col("_taken") == word_count(F.col(self.text_col)), F.col(self.text_col)).otherwise(cut[0])
        return met.withColumn(self.text_col, whole).drop("_own_id", "_own_hash", "_mix_id", "_mix_hash", "_spans", "_taken")

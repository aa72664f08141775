"""Hard negatives for contrastive training by a vertical scan (BOND) of blocks of vectors.

Vectors lie in blocks, one integer column per dimension, each with its smallest and largest
value. An anchor reads the columns in descending order of its own components. What the columns
not yet read can still add at least and at most bounds every candidate's score; candidates whose
bounds rule them out leave the bitmap, and the rest of the columns is read only for those left.
Everything is an integer, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.llm.common import bound, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
# A negative's score lies between these hundredths of its positive's.
FROM_PERCENT, TO_PERCENT = 50, 95
# Components beyond this could overflow a 64-bit inner product of 32,768 dimensions.
LARGEST = 2**24

# Rows of a block, anchors of a block, and rows that one task scans for one block of anchors.
BLOCK_ROWS, ANCHOR_ROWS, CELL_ROWS = 4_096, 256, 16_384
# Columns that are read between two looks at the bounds.
STEP = 8

_BLOCK = "block LONG, ids BINARY, labels BINARY, columns BINARY, dims INT, n INT"


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, null for a vector with a component that is null, not finite or too large."""
    raised = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    usable = F.forall(raised, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))
    return bound(raised, lambda v: F.when(usable, F.transform(v, lambda x: F.floor(x).cast("long"))))


def usable_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id, label, vector`` of the rows that take part, one for each id: that of the smallest label and vector."""
    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole_components(F.col(vector_col), scale).alias("vector"))
    taking = whole.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return taking.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("_row")).select("id", "_row.label", "_row.vector")


# --- blocks ------------------------------------------------------------------------


@dataclass
class Block:
    """Rows laid out by dimension; ``columns[d]`` holds component ``d`` of every row."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray

    def __post_init__(self) -> None:
        none = np.zeros(len(self.columns), np.int64)
        self.low = self.columns.min(axis=1).astype(np.int64) if self.columns.size else none
        self.high = self.columns.max(axis=1).astype(np.int64) if self.columns.size else none
        self.peak = int(max(self.high.max(initial=0), -self.low.min(initial=0)))
        self._typed: dict = {}

    def typed(self, kind: type) -> np.ndarray:
        if kind not in self._typed:
            self._typed = {kind: self.columns.astype(kind)}
        return self._typed[kind]


def _joined(blocks: list[Block]) -> Block:
    dims = max(len(b.columns) for b in blocks)
    padded = [np.pad(b.columns, ((0, dims - len(b.columns)), (0, 0))) for b in blocks]
    return Block(np.concatenate([b.ids for b in blocks]), np.concatenate([b.labels for b in blocks]), np.concatenate(padded, axis=1))


def _packer(most: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of at most ``most`` rows, shorter vectors padded with zeros."""
        for frame in _runs(frames, most):
            lengths = frame["vector"].map(len)
            dims = int(lengths.max())
            if lengths.min() == dims:
                columns = np.stack(frame["vector"].to_list()).T.astype(np.int64)
            else:
                columns = np.stack([np.pad(v, (0, dims - len(v))) for v in frame["vector"]]).T.astype(np.int64)
            if dims and columns.max() < 2**15 and columns.min() >= -(2**15):
                columns = columns.astype(np.int16)
            yield pd.DataFrame(
                {
                    "block": [int(frame["id"].iloc[0])],
                    "ids": [frame["id"].to_numpy(np.int64).tobytes()],
                    "labels": [frame["label"].to_numpy(np.int64).tobytes()],
                    "columns": [np.ascontiguousarray(columns).tobytes()],
                    "dims": [dims],
                    "n": [len(frame)],
                }
            )

    return pack


def _runs(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for frame in frames:
        while len(frame):
            part, frame = frame.iloc[: most - n], frame.iloc[most - n :]
            held.append(part)
            n += len(part)
            if n == most:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _unpacked(ids: bytes, labels: bytes, columns: bytes, dims: int, n: int) -> Block:
    wide = np.int64 if len(columns) == 8 * dims * n else np.int16
    return Block(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(columns, wide).reshape(dims, n))


def _packed(rows: DataFrame, n_rows: int, most: int, name: str) -> DataFrame:
    dealt = rows.select("id", "label", "vector").repartition(max(1, -(-n_rows // most)), "id")
    return stored(dealt.mapInPandas(_packer(most), _BLOCK), name, batch=most)


# --- the scan ----------------------------------------------------------------------


def exact_type(peak_a: int, peak_b: int, dims: int) -> type:
    """A number type in which inner products of such components are exact; floating point is fast."""
    most = peak_a * peak_b * max(dims, 1)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def vertical_scan(block: Block, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the rows of ``alive`` that the bounds don't rule out.

    ``keep(scores so far, least rest, most rest)`` tells which candidates stay; it is asked
    after every ``STEP`` columns.
    """
    dims = min(len(anchor), len(block.columns))
    anchor = anchor[:dims]
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block.low[:dims], anchor * block.high[:dims]])[:, order]
    rest_low = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
    rest_high = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
    kind = exact_type(int(np.abs(anchor).max(initial=0)), block.peak, dims)
    columns, weights = block.typed(kind), anchor.astype(kind)
    bitmap = alive.copy()
    at = np.flatnonzero(bitmap)
    scores = np.zeros(len(at), np.int64)
    for k in range(0, dims, STEP):
        if not len(at):
            break
        read = order[k : k + STEP]
        part = columns[read] if len(at) == columns.shape[1] else columns[np.ix_(read, at)]
        scores += (weights[read] @ part).astype(np.int64)
        done = min(k + STEP, dims)
        stays = keep(scores, int(rest_low[done]), int(rest_high[done]))
        if not stays.all():
            bitmap[at[~stays]] = False
            at, scores = np.flatnonzero(bitmap), scores[stays]
    return at, scores


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` by descending score, then ascending id."""
    if len(scores) > 4 * n:
        reached = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        reached = np.arange(len(scores))
    return reached[np.lexsort((ids[reached], -scores[reached]))][:n]


class Top:
    """The running first ``n`` of one anchor over several blocks."""

    def __init__(self, n: int) -> None:
        self.n, self.scores, self.ids = n, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int | None:
        """The score that a row has to reach; None while there are too few."""
        return int(self.scores[-1]) if len(self.scores) == self.n else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = _first(scores, ids, self.n)
        self.scores, self.ids = scores[first], ids[first]


def _nth_largest(values: np.ndarray, n: int) -> int | None:
    return int(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else None


class PositiveSearch:
    """The first rows of the anchor's own label."""

    schema = "anchor_id LONG, other_id LONG, score LONG"

    def __init__(self, row, vector: np.ndarray, n: int) -> None:
        self.id, self.label, self.vector, self.top = row.id, row.label, vector, Top(n)

    def scan(self, block: Block) -> None:
        def keep(scores: np.ndarray, low: int, high: int) -> np.ndarray:
            floors = [f for f in (self.top.floor(), _nth_largest(scores + low, self.top.n)) if f is not None]
            return scores + high >= max(floors) if floors else np.ones(len(scores), bool)

        alive = (block.labels == self.label) & (block.ids != self.id)
        at, scores = vertical_scan(block, self.vector, alive, keep)
        self.top.add(scores, block.ids[at])

    def rows(self) -> Iterator[tuple]:
        for other, score in zip(self.top.ids.tolist(), self.top.scores.tolist(), strict=True):
            yield self.id, other, score


class NegativeSearch:
    """The first rows of other labels within a window of scores for each distinct score of a positive."""

    schema = "anchor_id LONG, other_id LONG, score LONG, positive_score LONG"

    def __init__(self, row, vector: np.ndarray, n: int, from_percent: int, to_percent: int) -> None:
        self.id, self.label, self.vector = row.id, row.label, vector
        # 100 * score between from_percent * positive and to_percent * positive, in whole scores.
        self.windows = [
            (-(-from_percent * positive // 100), to_percent * positive // 100, positive, Top(n)) for positive in sorted({int(p) for p in row.positives})
        ]

    def scan(self, block: Block) -> None:
        def keep(scores: np.ndarray, low: int, high: int) -> np.ndarray:
            least, most = scores + low, scores + high
            wanted = np.zeros(len(scores), bool)
            for start, end, _, top in self.windows:
                inside = least[(least >= start) & (most <= end)]
                floors = [start, *[f for f in (top.floor(), _nth_largest(inside, top.n)) if f is not None]]
                wanted |= (most >= max(floors)) & (least <= end)
            return wanted

        at, scores = vertical_scan(block, self.vector, block.labels != self.label, keep)
        ids = block.ids[at]
        for start, end, _, top in self.windows:
            inside = (scores >= start) & (scores <= end)
            top.add(scores[inside], ids[inside])

    def rows(self) -> Iterator[tuple]:
        for _, _, positive, top in self.windows:
            for other, score in zip(top.ids.tolist(), top.scores.tolist(), strict=True):
                yield self.id, other, score, positive


def _scanner(search):
    """Runs over the cells of a partition: a cell's anchors come first, then its blocks, one after another."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, searches, held = None, [], []
        names = [f.split()[0] for f in search.schema.split(", ")]

        def run() -> None:
            if held:
                block = _joined(held) if len(held) > 1 else held[0]
                held.clear()
                for each in searches:
                    each.scan(block)

        def found() -> pd.DataFrame:
            run()
            return pd.DataFrame([r for each in searches for r in each.rows()], columns=names)

        for frame in frames:
            for row in frame.itertuples():
                if row.cell != cell:
                    if cell is not None:
                        yield found()
                    cell, searches = row.cell, []
                if row.anchor:
                    searches.append(search(row, np.array(row.vector, np.int64)))
                    continue
                held.append(_unpacked(row.ids, row.labels, row.columns, int(row.dims), int(row.n)))
                if sum(len(b.ids) for b in held) >= BLOCK_ROWS:
                    run()
        if cell is not None:
            yield found()

    return scan


def _scan_cells(anchors: DataFrame, n_anchors: int, blocks: DataFrame, n_rows: int, search, schema: str) -> DataFrame:
    """Every anchor against every block: cells of about ``ANCHOR_ROWS`` anchors and ``CELL_ROWS`` rows.

    Anchors are a stated set of queries that meets all rows in blocks. Each is sent once to each
    group of blocks, and each block once to each group of anchors; a cell is streamed, so a task
    holds its anchors, their first few rows and about one block.
    """
    anchor_groups, row_groups = max(1, -(-n_anchors // ANCHOR_ROWS)), max(1, -(-n_rows // CELL_ROWS))
    cells = F.col("_a") * row_groups + F.col("_g")
    sent = anchors.select(
        F.pmod(F.xxhash64("id"), F.lit(anchor_groups)).alias("_a"), "id", "label", "vector", "positives"
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1))).alias("_g"))
    laid = blocks.select(F.pmod(F.xxhash64("block"), F.lit(row_groups)).alias("_g"), "ids", "labels", "columns", "dims", "n", "block").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(anchor_groups - 1))).alias("_a")
    )
    both = sent.select(cells.alias("cell"), F.lit(True).alias("anchor"), "id", "label", "vector", "positives").unionByName(
        laid.select(cells.alias("cell"), F.lit(False).alias("anchor"), F.col("block").alias("id"), "ids", "labels", "columns", "dims", "n"), allowMissingColumns=True
    )
    dealt = both.repartition(anchor_groups * row_groups, "cell").sortWithinPartitions("cell", F.col("anchor").desc(), "id")
    return dealt.mapInPandas(_scanner(search), schema)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    from_percent: int = FROM_PERCENT,
    to_percent: int = TO_PERCENT,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id`` and ``label``. Scores are inner products of
    ``floor(scale * component)``. An anchor's positives are the first ``positives`` other rows of its label,
    by descending score, then ascending id; for each of them the first ``negatives`` rows of
    other labels are returned whose score lies in the window of percents of the positive's.

    Rows with a null id, label or vector, or with a component that is null, not finite or of
    2^24 or more after scaling, take no part. Of rows with one id the one of the smallest label
    and vector counts, so repeated rows count once. Missing dimensions of shorter vectors count as
    0, so an empty vector scores 0 with all. Other columns are ignored, and an empty table
    gives no rows.
    """
    taking = stored(usable_rows(rows, id_col, label_col, vector_col, scale), "vectors")
    n_rows = taking.count()
    blocks = _packed(taking, n_rows, BLOCK_ROWS, "vector-blocks")
    anchors = taking.filter(is_anchor).select("*", F.array().cast("array<long>").alias("positives"))
    n_anchors = anchors.count()

    def nearest(row, vector):
        return PositiveSearch(row, vector, positives)

    nearest.schema = PositiveSearch.schema
    parts = stored(_scan_cells(anchors, n_anchors, blocks, n_rows, nearest, PositiveSearch.schema), "positive-parts", batch=64)
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "other_id")
    best = parts.withColumn("rank", F.row_number().over(by_anchor)).filter(F.col("rank") <= positives)
    best = stored(best.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    asked = best.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("positives"))
    asking = anchors.drop("positives").join(asked, F.col("id") == F.col("anchor_id"))

    def between(row, vector):
        return NegativeSearch(row, vector, negatives, from_percent, to_percent)

    between.schema = NegativeSearch.schema
    found = stored(_scan_cells(asking, n_anchors, blocks, n_rows, between, NegativeSearch.schema), "negative-parts", batch=64)
    by_window = Window.partitionBy("anchor_id", "positive_score").orderBy(F.col("score").desc(), "other_id")
    first = found.withColumn("rank", F.row_number().over(by_window)).filter(F.col("rank") <= negatives)
    first = first.select("anchor_id", "positive_score", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(first, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

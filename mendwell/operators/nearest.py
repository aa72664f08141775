"""Exact top-k by cosine for many queries: cells of vectors, searched only where the triangle inequality allows a hit.

A cell holds vectors nearest to one pivot. Blocks of queries meet blocks of whole cells, so what a task holds is
bounded and what is shuffled are vectors, not pairs. The angle between a query and any vector of a cell is at least what the
triangle inequality leaves of the query's own angle to the cell's centre, so a cell's best possible score is known
without its vectors. In each block a query first scores its most promising cells; the k-th score found there rules out the cells that
can't reach it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.session import broadcast_if_small
from mendwell.sources.files import stored

PLACES = 6
# Rows and numbers of one side that a task holds at a time, and the most vectors of a cell's piece.
BLOCK_ROWS, BLOCK_NUMBERS, PIECE_ROWS = 40_000, 2_560_000, 4_000
# Scores that are worked out at a time, and those of them that a core's cache can hold.
SCORES, TILE = 4_000_000, 250_000
# Bounds are rounded up by this much: scores are rounded to six places.
SLACK = 1e-6


def unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length 1 in double precision; a vector without length stays zero."""
    rows = np.array(vectors.tolist(), dtype=np.float64)
    if rows.size == 0:
        return rows.reshape(len(vectors), 0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _slices(rows: int, width: int, scores: int = SCORES) -> list[slice]:
    """Runs of rows with at most ``scores`` scores of that width."""
    step = max(1, scores // max(1, width))
    return [slice(k, k + step) for k in range(0, rows, step)]


def _dealt(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
    """Rows with a block of their own, copied to every block of the other side."""
    mine = F.pmod(F.xxhash64(name), F.col(own)).cast("int").alias(own[0])
    met = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0])
    return df.select("*", mine, met).drop(own, other)


def _blocks(df: DataFrame, vector: str, name: str) -> DataFrame:
    rows, numbers = F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum(F.size(vector)) / F.lit(BLOCK_NUMBERS)
    return df.groupBy("asset").agg(F.ceil(F.greatest(rows, numbers)).cast("int").alias(name))


def _meet(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vectors: tuple[str, str], fn, schema: str) -> DataFrame:
    """``fn`` of every block of ``left`` with every block of ``right`` of one asset; hot assets have many blocks."""
    sizes = broadcast_if_small(_blocks(left, vectors[0], "l_blocks").join(_blocks(right, vectors[1], "r_blocks"), "asset"))
    a = _dealt(left.join(sizes, "asset"), "l_blocks", "r_blocks", left_id)
    b = _dealt(right.join(sizes, "asset"), "r_blocks", "l_blocks", right_id)
    at = ["asset", "l", "r"]
    return a.groupBy(*at).cogroup(b.groupBy(*at)).applyInPandas(fn, schema)


def _number() -> Column:
    """A number for each row, fixed once the rows are written."""
    return F.monotonically_increasing_id()


def _by_hash(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with a hash of asset and vector.

    As the first of several keys it decides nearly every comparison of a sort, which else goes through assets and vectors number by number.
    """
    return df.withColumn("_h", F.xxhash64("asset", vector))


# --- cells -------------------------------------------------------------------------


def first_ids(index: DataFrame, keep: int) -> DataFrame:
    """``asset, vector, first_id, ids``: of rows with one vector only the first ``keep`` ids can be hits."""
    same = Window.partitionBy("_h", "asset", "vector").orderBy("id")
    each = _by_hash(index.select("asset", "vector", "id").distinct(), "vector")
    few = each.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= keep)
    lists = few.groupBy("_h", "asset", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return lists.drop("_h").withColumn("first_id", F.element_at("ids", 1))


def build_cells(unique: DataFrame) -> DataFrame:
    """``asset, cell, m, first_id, vector``: cells around about the square root of an asset's vectors, which hashes choose as pivots.

    ``unique`` has ``asset, vector, first_id, m``, one row per asset and vector. A cell with more than ``PIECE_ROWS`` vectors is
    split into several.
    """
    hashed = unique.select("asset", "m", "first_id", "vector", F.xxhash64("vector").alias("_hash"))
    sizes = broadcast_if_small(hashed.groupBy("asset").agg(F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_first")))
    is_pivot = (F.col("_hash") == F.col("_first")) | (F.pmod("_hash", F.ceil(F.sqrt("_n"))) == 0)
    pivots = hashed.join(sizes, "asset").filter(is_pivot).select("asset", F.col("_hash").alias("cell"), F.col("vector").alias("pivot"))
    pivots = stored(pivots.groupBy("asset", "cell").agg(F.first("pivot").alias("pivot")), "pivots")

    def nearest(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or around.empty:
            return pd.DataFrame(columns=["asset", "cell", "angle", "m", "first_id", "vector"])
        a, b = unit(rows["vector"]), unit(around["pivot"])
        best, angles = np.empty(len(a), np.int64), np.empty(len(a))
        for part in _slices(len(a), len(b)):
            cosines = a[part] @ b.T
            best[part] = cosines.argmax(axis=1)
            angles[part] = np.arccos(np.clip(cosines.max(axis=1), -1.0, 1.0))
        return rows.assign(cell=around["cell"].to_numpy()[best], angle=angles)[["asset", "cell", "angle", "m", "first_id", "vector"]]

    near = _meet(hashed.drop("_hash"), pivots, "m", "cell", ("vector", "pivot"), nearest, "asset STRING, cell LONG, angle DOUBLE, m LONG, first_id STRING, vector ARRAY<FLOAT>")
    # A block of pivots gives its own nearest one; the nearest of all counts.
    closest = Window.partitionBy("m").orderBy("angle", "cell")
    placed = stored(near.withColumn("_n", F.row_number().over(closest)).filter("_n = 1").drop("_n", "angle"), "placed")
    pieces = broadcast_if_small(placed.groupBy("asset", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIECE_ROWS)).alias("_pieces")))
    piece = F.pmod(F.xxhash64("m"), F.col("_pieces"))
    return placed.join(pieces, ["asset", "cell"]).withColumn("cell", F.xxhash64("cell", piece)).drop("_pieces")


def best_scores(queries: np.ndarray, pivots: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The largest cosine that a vector of each cell can have with each query.

    A vector without length has the angle 90 degrees to all, which obeys no triangle: where one side may be such, scores up to 1 stay possible.
    """
    angle = _angles(queries, pivots)
    gap = np.maximum(0.0, np.maximum(angle - far, near - angle))
    bound = np.cos(np.minimum(gap, np.pi))
    open_cell = (far >= np.pi / 2 - 1e-6) & (near <= np.pi / 2 + 1e-6)
    flat = ~queries.any(axis=1)[:, None] | ~pivots.any(axis=1)[None, :]
    # A zero vector in an ordinary cell lies at exactly 90 degrees and scores 0.
    bound = np.where(open_cell[None, :], np.maximum(bound, 0.0), bound)
    return np.where(flat, 1.0, bound)


# --- search ------------------------------------------------------------------------


class Best:
    """The ``keep`` best vectors of every query so far: rounded scores and rows of ``vectors``, equal scores by ``order``."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, order: np.ndarray, keep: int) -> None:
        self.queries, self.vectors, self.order, self.keep = queries, vectors, order, keep
        self.small = queries.astype(np.float32), vectors.astype(np.float32)
        # What single precision may miss: each product and sum is off by at most 2^-24 of its size.
        self.slack = SLACK + (queries.shape[1] + 4) * 6e-8
        # Components that aren't finite leave scores undefined, which are never near.
        self.undefined = not (np.isfinite(queries).all() and np.isfinite(vectors).all())
        self.scores = np.full((len(queries), keep), -2.0)
        self.rows = np.full((len(queries), keep), -1)
        self.scored = np.zeros(len(queries), np.int64)

    def meet(self, rows: np.ndarray, start: int, end: int) -> None:
        """Score the queries ``rows`` with the vectors from ``start`` to ``end``."""
        width, waiting, held = end - start, [], 0
        others = self.small[1][start:end].T
        for part in _slices(len(rows), width, TILE):
            mine = rows[part]
            rough = self.small[0][mine] @ others
            least = (self.scores[mine, -1] - self.slack).astype(np.float32)
            if self.undefined:
                rough[np.isnan(rough)] = -np.inf
            # Few queries have any that is near; their largest scores tell which.
            some = np.flatnonzero(rough.max(axis=1) >= least)
            if not len(some):
                continue
            mine, rough = mine[some], rough[some]
            near = rough >= least[some, None]
            if width > self.keep and np.count_nonzero(near) > 4 * self.keep * len(mine):
                # Nothing that lies further below the best ones here than single precision may miss on both sides.
                best = np.partition(rough, width - self.keep, axis=1)[:, width - self.keep]
                near &= rough >= (best - 2 * self.slack).astype(np.float32)[:, None]
            q, v = np.divmod(np.flatnonzero(near), width)
            waiting.append((mine[q], v + start))
            held += len(q)
            if held > SCORES // 8:
                self._add(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting, held = [], 0
        self.scored[rows] += width
        if held:
            self._add(*map(np.concatenate, zip(*waiting, strict=True)))

    def _add(self, q: np.ndarray, v: np.ndarray) -> None:
        exact = np.empty(len(q))
        for part in _slices(len(q), 8 * self.queries.shape[1]):
            exact[part] = np.einsum("ij,ij->i", self.queries[q[part]], self.vectors[v[part]])
        exact = np.round(exact, PLACES) + 0.0
        enough = exact >= self.scores[q, -1]
        q, v, exact = q[enough], v[enough], exact[enough]
        touched = np.unique(q)
        q = np.concatenate([np.repeat(touched, self.keep), q])
        v = np.concatenate([self.rows[touched].ravel(), v])
        exact = np.concatenate([self.scores[touched].ravel(), exact])
        by = np.lexsort((np.where(v < 0, 0, self.order[v]), -exact, q))
        q, v, exact = q[by], v[by], exact[by]
        # Each touched query has at least ``keep`` entries.
        first = np.searchsorted(q, touched)[:, None] + np.arange(self.keep)
        self.scores[touched], self.rows[touched] = exact[first], v[first]


def _searcher(keep: int):
    def search(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or members.empty:
            return pd.DataFrame(columns=["q", "m", "score", "scored"])
        members = members.sort_values(["cell", "m"], ignore_index=True)
        queries, vectors = unit(asked["query"]), unit(members["vector"])
        order = np.empty(len(members), np.int64)
        order[np.argsort(members["first_id"].to_numpy(), kind="stable")] = np.arange(len(members))
        starts = np.flatnonzero(np.r_[True, np.diff(members["cell"].to_numpy()) != 0])
        ends = np.r_[starts[1:], len(members)]
        # Any centre gives a bound; the mean direction lies close to all.
        centres = unit(pd.Series(list(np.add.reduceat(vectors, starts, axis=0))))
        angles = np.arccos(np.clip(np.einsum("ij,ij->i", vectors, np.repeat(centres, ends - starts, axis=0)), -1.0, 1.0))
        near, far = np.minimum.reduceat(angles, starts), np.maximum.reduceat(angles, starts)
        bound = np.empty((len(queries), len(starts)), np.float32)
        first = np.zeros(bound.shape, bool)
        for part in _slices(len(queries), 4 * len(starts)):
            bound[part] = best = best_scores(queries[part], centres, near, far)
            by = np.argsort(-best, axis=1, kind="stable")
            sizes = (ends - starts)[by]
            np.put_along_axis(first[part], by, np.cumsum(sizes, axis=1) - sizes < keep, axis=1)
        found = Best(queries, vectors, order, keep)
        for c, (start, end) in enumerate(zip(starts, ends, strict=True)):
            found.meet(np.flatnonzero(first[:, c]), start, end)
        for c, (start, end) in enumerate(zip(starts, ends, strict=True)):
            # Single precision may have rounded the bound down by 6e-8.
            reached = bound[:, c] + (SLACK + 1e-7) >= found.scores[:, -1]
            found.meet(np.flatnonzero(reached & ~first[:, c]), start, end)
        q, place = np.nonzero(found.rows >= 0)
        hit = found.rows[q, place]
        scored = np.where(place == 0, found.scored[q], 0)
        return pd.DataFrame({"q": asked["q"].to_numpy()[q], "m": members["m"].to_numpy()[hit], "score": found.scores[q, place], "scored": scored})

    return search


def search(queries: DataFrame, unique: DataFrame, keep: int) -> DataFrame:
    """``q, similar_id, score, scored`` of the ``keep`` best of each query, which has ``q, asset, query``.

    ``unique`` has ``asset, vector, first_id, ids, m``. ``scored`` is the number of vectors that were scored with the query.
    """
    members = stored(build_cells(unique), "cells")
    hits = stored(_meet(queries, members, "q", "cell", ("query", "vector"), _searcher(keep), "q LONG, m LONG, score DOUBLE, scored LONG"), "hits")
    # Vectors of equal scores stay until their ids are known.
    score = Window.partitionBy("q").orderBy(F.desc("score"))
    few = hits.select("q", "m", "score").withColumn("_n", F.rank().over(score)).filter(F.col("_n") <= keep).drop("_n")
    named = few.join(unique.select("m", "ids"), "m").select("q", "score", F.explode("ids").alias("similar_id"))
    place = Window.partitionBy("q").orderBy(F.desc("score"), "similar_id")
    best = named.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= keep).drop("_n")
    return best.join(hits.groupBy("q").agg(F.sum("scored").alias("scored")), "q")


def nearest_by_cells(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """``incident_id, similar_id, score, rank, scored``: the ``k`` best rows of the query's asset.

    Both sides have ``id, asset, vector``; rows without a vector take no part. Queries of one asset
    and vector are searched once. Exact: cells are left out only where no vector of theirs can reach the
    k-th score found. Equal scores go by id.
    """
    queries, index = (d.filter(F.col("vector").isNotNull()).select("id", "asset", F.col("vector").cast("array<float>").alias("vector")) for d in (queries, index))
    keep = k + 1 if exclude_self else k
    asked = stored(queries, "queries")
    once = stored(asked.groupBy("asset", F.col("vector").alias("query")).agg(F.count(F.lit(1)).alias("_n")).select("asset", "query", _number().alias("q")), "distinct-queries")
    unique = stored(first_ids(index, keep).withColumn("m", _number()), "index-vectors")
    found = search(once, unique, keep)
    numbered = _by_hash(once.withColumnRenamed("query", "vector"), "vector")
    of_query = _by_hash(asked, "vector").join(numbered, ["_h", "asset", "vector"]).select("q", F.col("id").alias("incident_id"))
    hits = of_query.join(found, "q")
    if exclude_self:
        hits = hits.filter(F.col("incident_id") != F.col("similar_id"))
    place = Window.partitionBy("incident_id").orderBy(F.desc("score"), "similar_id")
    return hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("incident_id", "similar_id", "score", "rank", "scored")

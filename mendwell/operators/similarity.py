"""Exact top-k incidents by cosine similarity.

Scores are rounded to a fixed number of places and ties are broken by id, so the
result does not depend on how the rows were partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.functions.scalars import non_empty
from mendwell.operators.nearest import PLACES, nearest_by_cells, unit

# Query vectors sent to every task: at 384 doubles each about 6 MB.
BROADCAST_QUERIES = 2_000
# Words of which a task keeps the dimension.
KEPT_WORDS = 200_000

_HITS = "incident_id STRING, similar_id STRING, score DOUBLE"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, as a column expression."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _best(queries: pd.DataFrame, index: pd.DataFrame, k: int, exclude_self: bool) -> pd.DataFrame:
    """Top-k index rows per query among the given rows."""
    if queries.empty or index.empty:
        return pd.DataFrame({"incident_id": [], "similar_id": [], "score": []})
    ids = index["id"].to_numpy()
    scores = np.round(unit(queries["vector"]) @ unit(index["vector"]).T, PLACES) + 0.0
    found = []
    for query, row in zip(queries["id"], scores, strict=True):
        if exclude_self:
            keep = ids != query
            names, values = ids[keep], row[keep]
        else:
            names, values = ids, row
        if len(values) > k:
            # All rows that reach the k-th best score, so ties can go by id.
            cut = np.partition(values, len(values) - k)[len(values) - k]
            near = values >= cut
            names, values = names[near], values[near]
        order = np.lexsort((names, -values))[:k]
        found.append(pd.DataFrame({"incident_id": query, "similar_id": names[order], "score": values[order]}))
    return pd.concat(found, ignore_index=True)


def _by_scan(queries: pd.DataFrame, index: DataFrame, k: int, exclude_self: bool, same_asset: bool) -> DataFrame:
    """Few queries: every task scores its index rows and passes on only k per query."""
    # None stands for a search over all assets.
    if same_asset:
        keyed = queries[queries["asset"].fillna("") != ""]
        groups = dict(list(keyed.groupby("asset")))
        groups |= {None: rest} if len(rest := queries.drop(keyed.index)) else {}
    else:
        groups = {None: queries}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for batch in batches:
            for asset, mine in groups.items():
                rows = batch if asset is None else batch[batch["asset"] == asset]
                hits = _best(mine, rows, k, exclude_self)
                if asset in best:
                    hits = pd.concat([best[asset], hits], ignore_index=True)
                hits = hits.sort_values(["incident_id", "score", "similar_id"], ascending=[True, False, True])
                best[asset] = hits.groupby("incident_id").head(k)
        yield from best.values()

    return index.mapInPandas(score, _HITS)


def _by_cells(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool, same_asset: bool) -> DataFrame:
    """Many queries: one search per distinct vector and asset, which leaves out cells that hold no hit."""
    anywhere = [d.withColumn("asset", F.lit("")) for d in (queries, index)]
    if not same_asset:
        return nearest_by_cells(*anywhere, k, exclude_self)
    keyed = non_empty(F.col("asset")).isNotNull()
    hits = nearest_by_cells(queries.filter(keyed), index.filter(keyed), k, exclude_self)
    homeless = anywhere[0].join(queries.filter(~keyed).select("id").distinct(), "id", "left_semi")
    return hits if homeless.isEmpty() else hits.unionByName(nearest_by_cells(homeless, anywhere[1], k, exclude_self))


def similar_incidents(
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    same_asset: bool = True,
    exclude_self: bool = False,
    max_broadcast: int = BROADCAST_QUERIES,
) -> DataFrame:
    """The ``k`` most similar index rows of every query: ``incident_id, similar_id, score, rank``.

    Both sides have ``id, asset, vector``. With ``same_asset`` a query meets the rows
    of its own asset, or all rows if it has none. A diagnosis tick has a handful of
    queries: after a bounded count they go to the tasks that scan the index, and
    the index is not shuffled. Larger query tables search an index of cells.
    """
    columns = ["id", "asset", "vector"]
    queries, index = queries.select(*columns), index.select(*columns)
    if queries.count() <= max_broadcast:
        partial = _by_scan(queries.toPandas(), index, k, exclude_self, same_asset)
    else:
        return _by_cells(queries, index, k, exclude_self, same_asset).drop("scored")
    place = Window.partitionBy("incident_id").orderBy(F.desc("score"), "similar_id")
    return partial.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def with_payload(hits: DataFrame, state: DataFrame) -> DataFrame:
    """Attach asset, error type and prior fix of each hit from the incident state."""
    payload = state.select(
        F.col("incident_id").alias("similar_id"),
        F.coalesce("asset_key", F.lit("")).alias("asset_key"),
        F.coalesce("error_type", F.lit("")).alias("error_type"),
        F.coalesce("proposed_fix", F.lit("")).alias("prior_fix"),
    )
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("asset_key", "error_type", "prior_fix")]
    return hits.join(payload, "similar_id", "left").select("incident_id", "similar_id", "score", "rank", *blank)


class _Places(dict):
    """Dimensions of words, by their md5. A bounded number is kept; words are few and repeat."""

    def __init__(self, dims: int) -> None:
        self.dims = dims

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = place = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big") % self.dims
        return place


def _counted(text: bytes | None, places: _Places) -> np.ndarray | None:
    """The unit vector of a text's words; none without words. Bytes split at the white space of ASCII alone."""
    words = (text or b"").split()
    if not words:
        return None
    counts = np.bincount(list(map(places.__getitem__, words)), minlength=places.dims)
    return (counts / np.sqrt(counts @ counts)).astype(np.float32)


def build_index(texts: DataFrame, id_column: str, text_column: str, dims: int = 384) -> DataFrame:
    """Unit vectors of hashed word counts; texts without words are skipped, one row per id.

    A word's dimension comes from its md5, so that other systems give the same vectors. A text is counted
    where it is read: only vectors are shuffled. Of several texts of one id the one with the smallest hash counts; other
    columns keep the values of one of its rows.
    """
    others = [c for c in texts.columns if c not in (id_column, text_column)]

    @F.pandas_udf("array<float>")
    def vectors_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = _Places(dims)
        for batch in batches:
            yield pd.Series([_counted(text, places) for text in batch], dtype=object)

    spoken = F.lower(text_column).cast("binary")
    each = texts.select(id_column, F.xxhash64(text_column).alias("_hash"), vectors_of(spoken).alias("_vector"))
    # Filtered after the grouping: a filter before it would be put below the projection and count every text again.
    counts = F.when(F.col("_vector").isNotNull(), F.col("_hash"))
    vectors = each.groupBy(id_column).agg(F.min_by("_vector", counts).alias("vector")).filter(F.col("vector").isNotNull())
    if not others:
        return vectors
    payload = texts.drop(text_column).dropDuplicates([id_column])
    return payload.join(vectors, id_column)


def upsert_index(index: DataFrame, fresh: DataFrame, id_column: str, written: str | None = None) -> DataFrame:
    """The index with rows of ``fresh`` added or replaced by id.

    ``written`` is a column of ``fresh`` that tells the last write of an id; without
    it ids may not repeat.
    """
    if written is not None:
        fresh = fresh.groupBy(id_column).agg(F.max_by(F.struct("*"), written).alias("_last")).select("_last.*")
    kept = index.join(fresh.select(id_column), id_column, "left_anti")
    return kept.unionByName(fresh.select(*index.columns))

"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwell.llm.common import drop_stored, stored


def large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest node of its neighbourhood to its larger neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of its smaller neighbours to the others and takes it itself. ``edges`` point to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    others = edges.join(least, "u").filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return others.unionAll(least.select("u", F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (``u, v``) can reach; roots aren't listed.

    Nodes may be of any ordered type; edges of null or of a node with itself say nothing.
    Each round is written and the one before it removed, so lineage stays short and a
    lost executor repeats one round at most. A round shuffles each edge a few times
    whatever the size of a component, and minima are taken before the shuffle. Rounds
    grow with the logarithm of a component's diameter.
    """
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(ordered, "edges")
    mark = _mark(now)
    while True:
        after = stored(small_star(large_star(now)), "edges")
        drop_stored(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another: two numbers from each task."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

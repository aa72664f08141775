"""What is known around an incident: lineage, run history, log tail, similar ones.

Sources are joined from the left and any of them may be absent. Runs, log lines and
similar incidents are cut to the newest or best by definition; neighbours are listed in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.functions.scalars import bare_name
from mendwell.session import broadcast_if_small

NODE_KINDS = ["model.", "seed.", "snapshot."]


def asset_nodes(assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lineage node of each distinct asset key: same bare name, lowest id first.

    ``nodes`` has ``node_id, name``; only models, seeds and snapshots count.
    """
    kinds = F.lit(False)
    for kind in NODE_KINDS:
        kinds = kinds | F.col("node_id").startswith(kind)
    named = nodes.filter(kinds).groupBy("name").agg(F.min("node_id").alias("node_id"))
    keys = assets.select("asset_key").dropna().distinct()
    return keys.join(named, bare_name(F.col("asset_key")) == F.col("name")).select("asset_key", "node_id")


def lineage_neighbours(assets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct parents and children of every asset: ``asset_key, direction, neighbour``.

    ``edges`` has ``child, parent``. Only distinct asset keys are joined, however
    many incidents one asset has.
    """
    found = asset_nodes(assets, nodes)
    up = found.join(edges, F.col("node_id") == F.col("child")).select(
        "asset_key", F.lit("upstream").alias("direction"), F.col("parent").alias("neighbour")
    )
    down = found.join(edges, F.col("node_id") == F.col("parent")).select(
        "asset_key", F.lit("downstream").alias("direction"), F.col("child").alias("neighbour")
    )
    return up.unionByName(down).distinct()


def neighbour_lists(neighbours: DataFrame) -> DataFrame:
    """Per asset the counts and the sorted lists of all its neighbours.

    A prompt and a report name every neighbour, so the list has to fit in a row;
    ``lineage_neighbours`` is the same as a table.
    """

    def listed(direction: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("direction") == direction, F.col("neighbour")))).alias(direction)

    lists = neighbours.groupBy("asset_key").agg(listed("upstream"), listed("downstream"))
    sizes = [F.size(c).cast("bigint").alias(f"{c}_count") for c in ("upstream", "downstream")]
    return lists.select("asset_key", *sizes, "upstream", "downstream")


def recent_runs(assets: DataFrame, runs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest ``limit`` runs of every asset.

    ``runs`` has ``run_id, status, asset_keys, created_at``. A run without an asset
    selection belongs to every asset: only the newest ``limit`` of those can matter,
    and they reach the assets as one bounded array.
    """
    wanted = assets.select("asset_key").dropna().distinct()
    newest = [F.col("created_at").desc(), F.col("run_id")]
    run = F.struct("created_at", "run_id", "status")
    everywhere = runs.filter(F.size("asset_keys") == 0).orderBy(*newest).limit(limit)
    shared = everywhere.agg(F.collect_list(run).alias("shared")).scalar()
    from_shared = wanted.select("asset_key", F.inline(shared))

    selected = runs.filter(F.size("asset_keys") > 0).select(
        F.explode(F.array_distinct("asset_keys")).alias("asset_key"), "created_at", "run_id", "status"
    )
    # Cut to the newest per asset before the join: the rank filter is applied map-side too.
    place = Window.partitionBy("asset_key").orderBy(*newest)
    own = selected.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= limit).drop("_n")
    own = own.join(wanted, "asset_key", "left_semi")
    both = own.unionByName(from_shared)
    ranked = both.withColumn("position", F.row_number().over(place))
    return ranked.filter(F.col("position") <= limit)


def log_tail(
    log: DataFrame, run: str, seq: str, line: str, limit: int = 200, wanted: DataFrame | None = None
) -> DataFrame:
    """The last ``limit`` lines of every run in order: ``run, log_lines``.

    ``wanted`` names the runs that are asked for, however many; only those are returned.
    """
    if wanted is not None:
        log = log.join(broadcast_if_small(wanted.select(run).distinct()), run, "left_semi")
    newest = Window.partitionBy(run).orderBy(F.col(seq).desc())
    kept = log.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(line).alias("line"))))
    return kept.groupBy(run).agg(F.transform(ordered, lambda x: x["line"]).alias("log_lines"))


def run_lists(ranked: DataFrame) -> DataFrame:
    """Recent runs as one array per asset, newest first; at most the run limit long."""
    entry = F.struct("position", "run_id", "status")
    return ranked.groupBy("asset_key").agg(F.sort_array(F.collect_list(entry)).alias("recent_runs"))


def similar_lists(hits: DataFrame) -> DataFrame:
    """Similar incidents as one array per incident, best first; at most top-k long."""
    entry = F.struct("rank", "similar_id", "score", "asset_key", "error_type", "prior_fix")
    return hits.groupBy("incident_id").agg(F.sort_array(F.collect_list(entry)).alias("similar_incidents"))


_ABSENT = {
    "upstream": "array<string>",
    "downstream": "array<string>",
    "upstream_count": "bigint",
    "downstream_count": "bigint",
    "recent_runs": "array<struct<position:int,run_id:string,status:string>>",
    "log_lines": "array<string>",
    "similar_incidents": "array<struct<rank:int,similar_id:string,score:double,asset_key:string,"
    "error_type:string,prior_fix:string>>",
}


def context_bundle(
    incidents: DataFrame,
    lineage: DataFrame | None = None,
    runs: DataFrame | None = None,
    logs: DataFrame | None = None,
    similar: DataFrame | None = None,
) -> DataFrame:
    """Incidents with every available source; what is missing is empty.

    ``lineage`` and ``runs`` hold one row per asset, ``logs`` one per run and
    ``similar`` one per incident, so no join adds rows.
    """
    out = incidents
    for source, key in ((lineage, "asset_key"), (runs, "asset_key"), (logs, "run_id"), (similar, "incident_id")):
        if source is not None:
            out = out.join(source, key, "left")
    for name, dtype in _ABSENT.items():
        blank = F.lit(0).cast(dtype) if dtype == "bigint" else F.array().cast(dtype)
        value = F.coalesce(F.col(name), blank) if name in out.columns else blank
        out = out.withColumn(name, value)
    return out

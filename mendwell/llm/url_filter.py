"""URL filters that change with time: captures are judged by the list entries active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The host in lower case without port, user and final dot; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def section_of(url: Column) -> Column:
    """The first part of the path in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1))


def patterns_of(host: Column, section: Column) -> Column:
    """What entries may name a page by, most specific last: its host's parents, its host, its host and section."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(labels, n - k, k + 1), "."))
    inner = F.when(section != "", F.array(F.concat(host, F.lit("/"), section))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(parents, inner))


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, list, valid_from, valid_to``: the days, the last excluded, on which a pattern is on a list.

    ``entries`` has ``pattern, list, day, action`` (add or remove). Several entries of one
    day count as one, a removal if there is any; an addition to what is on the list, or a
    removal of what isn't, changes nothing. Entries with a null say nothing. A pattern
    that isn't removed stays until ``FOREVER``. No group is larger than the days of a pattern.
    """
    stated = entries.select(F.lower("pattern").alias("pattern"), "list", F.col("day").cast("date").alias("day"), "action").dropna()
    stated = stated.filter(F.col("list").isin(BLOCK, ALLOW) & F.col("action").isin("add", "remove"))
    daily = stated.groupBy("pattern", "list", "day").agg(F.bool_and(F.col("action") == "add").alias("on"))
    order = Window.partitionBy("pattern", "list").orderBy("day")
    turns = daily.withColumn("_was", F.coalesce(F.lag("on").over(order), F.lit(False))).filter(F.col("on") != F.col("_was"))
    ends = turns.withColumn("valid_to", F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date")))
    return ends.filter("on").select("pattern", "list", F.col("day").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``verdict`` (block, allow or none), ``pattern, valid_from, valid_to`` of the entry that decides.

    The most specific pattern that is on a list at the day of the capture decides; where
    it is on both lists, it allows. Captures without host or time are judged none. All rows and columns come
    back, repeated ones too; columns named like the results are replaced.

    Lists are asked once for each pattern and day that occurs, so a host of very many captures is at most as many
    rows as it has days. These questions are merged with the intervals of their pattern in
    order of time, and each takes the interval that began last.
    """
    captures = captures.drop("verdict", "pattern", "valid_from", "valid_to")
    keyed = captures.select("*", host_of(F.col(url_col)).alias("_host"), section_of(F.col(url_col)).alias("_section"), F.to_date(time_col).alias("_day"))
    sites = keyed.filter("_host <> '' AND _day IS NOT NULL").select("_host", "_section", "_day").distinct()
    asked = sites.select("_host", "_section", "_day", F.posexplode(patterns_of(F.col("_host"), F.col("_section"))).alias("_rank", "_pattern"))
    questions = asked.select(F.col("_pattern").alias("pattern"), F.col("_day").alias("_at")).distinct()

    interval = F.struct("valid_from", "valid_to")
    begins = validity(entries).select("pattern", F.col("valid_from").alias("_at"), *[F.when(F.col("list") == name, interval).alias(f"_{name}") for name in (BLOCK, ALLOW)])
    merged = begins.withColumn("_asks", F.lit(0)).unionByName(questions.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("pattern").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    latest = merged.select("pattern", "_at", "_asks", *[F.last(f"_{name}", ignorenulls=True).over(so_far).alias(f"_{name}") for name in (BLOCK, ALLOW)])
    active = {name: F.col(f"_{name}.valid_to") > F.col("_at") for name in (BLOCK, ALLOW)}
    answers = latest.filter((F.col("_asks") == 1) & (active[ALLOW] | active[BLOCK])).select(
        F.col("pattern").alias("_pattern"),
        F.col("_at").alias("_day"),
        F.when(active[ALLOW], F.lit(ALLOW)).otherwise(F.lit(BLOCK)).alias("verdict"),
        F.when(active[ALLOW], F.col(f"_{ALLOW}")).otherwise(F.col(f"_{BLOCK}")).alias("_interval"),
    )
    decided = asked.join(answers, ["_pattern", "_day"]).groupBy("_host", "_section", "_day").agg(F.max_by(F.struct("verdict", "_pattern", "_interval"), "_rank").alias("_found"))
    out = keyed.join(decided, ["_host", "_section", "_day"], "left")
    return out.select(
        *[F.col(c) for c in captures.columns],
        F.coalesce("_found.verdict", F.lit("none")).alias("verdict"),
        F.col("_found._pattern").alias("pattern"),
        F.col("_found._interval.valid_from").alias("valid_from"),
        F.col("_found._interval.valid_to").alias("valid_to"),
    )

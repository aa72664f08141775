"""Rates, increases, histograms, quantiles and pass rates over metric events.

A metric event is one increment or observation with a timestamp. Windows are
aligned to their slide, so events are first summed into slide-wide buckets and
only those few rows are spread over the windows that contain them.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.session import broadcast_if_small
from mendwell.sources.files import stored

LARGEST = sys.float_info.max
# Upper bounds of the latency histogram in seconds.
LATENCY_BOUNDS = [0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``ts`` (TIMESTAMP_NTZ)."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_add("MICROSECOND", -F.pmod(micros, F.lit(seconds * 1_000_000)), ts)


def sliding_sum(
    events: DataFrame, labels: list[str], size_s: int, slide_s: int, value: Column | None = None, ts: str = "ts"
) -> DataFrame:
    """Sum of ``value`` per labels and window ``[window_start, window_start + size)``."""
    if size_s % slide_s:
        raise ValueError("the window size must be a multiple of the slide")
    amount = F.lit(1) if value is None else value
    buckets = events.groupBy(*labels, bucket_start(F.col(ts), slide_s).alias("_bucket")).agg(
        F.sum(amount).alias("_sum")
    )
    back = F.explode(F.sequence(F.lit(0), F.lit(size_s - slide_s), F.lit(slide_s)))
    spread = buckets.select("*", back.alias("_back"))
    start = F.timestamp_add("SECOND", -F.col("_back"), F.col("_bucket"))
    return spread.groupBy(*labels, start.alias("window_start")).agg(F.sum("_sum").alias("total"))


def increase(events: DataFrame, labels: list[str], size_s: int, slide_s: int, value: Column | None = None) -> DataFrame:
    return sliding_sum(events, labels, size_s, slide_s, value).withColumnRenamed("total", "increase")


def rate(events: DataFrame, labels: list[str], size_s: int, slide_s: int, value: Column | None = None) -> DataFrame:
    """Increments per second in every window."""
    summed = sliding_sum(events, labels, size_s, slide_s, value)
    return summed.withColumn("rate", F.col("total") / F.lit(float(size_s))).drop("total")


def bucket_counts(events: DataFrame, labels: list[str], value: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative histogram per labels: one row per bound, ``le`` null for the open bucket."""
    bounds = bounds or LATENCY_BOUNDS
    counted = events.filter(F.col(value).isNotNull()).groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("*").alias("_total"),
    )
    rows = [
        F.struct(F.lit(i).alias("bucket"), F.lit(b).alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ]
    rows.append(
        F.struct(
            F.lit(len(bounds)).alias("bucket"),
            F.lit(None).cast("double").alias("le"),
            F.col("_total").alias("cumulative"),
        )
    )
    return counted.select(*labels, F.inline(F.array(*rows)))


def histogram_quantile(histogram: DataFrame, labels: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets, interpolated inside the bucket that reaches it.

    Ranks in the open bucket give the largest finite bound.
    """
    series = Window.partitionBy(*labels).orderBy("bucket")
    whole = Window.partitionBy(*labels)
    steps = histogram.select(
        *labels,
        "bucket",
        "le",
        "cumulative",
        F.coalesce(F.lag("le").over(series), F.lit(0.0)).alias("low"),
        F.coalesce(F.lag("cumulative").over(series), F.lit(0)).alias("before"),
        (F.max("cumulative").over(whole) * F.lit(q)).alias("rank"),
    )
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / (
        F.col("cumulative") - F.col("before")
    )
    value = F.when(F.col("le").isNull(), F.col("low")).otherwise(inside)
    reached = steps.filter((F.col("cumulative") >= F.col("rank")) & (F.col("cumulative") > F.col("before")))
    return reached.groupBy(*labels).agg(F.min_by(value, "bucket").alias("quantile"))


def exact_quantile(events: DataFrame, labels: list[str], value: str, q: float, parts: int = 256) -> DataFrame:
    """``*labels, quantile``: the smallest value that at least the share ``q`` of a series' values doesn't exceed.

    No series is sorted or collected: each pass counts ``parts`` equal ranges between the bounds of each series,
    keeps the range that holds the rank and takes its smallest and largest value as the next bounds, until
    they meet. Between passes a series is one row. Null and NaN are no values, infinite ones count as the
    largest finite ones.
    """
    finite = F.greatest(F.least(F.col(value).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    known = events.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*labels, finite.alias("_v"))
    known = stored(known, "quantile-values")
    rank = F.greatest(F.ceil(F.count(F.lit(1)) * F.lit(q)), F.lit(1))
    at = stored(known.groupBy(*labels).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), rank.alias("_rank")), "quantile-bounds")
    settled = at.filter("_low = _high")
    done, open_series = [settled], at.filter("_low < _high")
    while not open_series.isEmpty():
        bounds = broadcast_if_small(open_series).alias("b")
        inside = known.alias("k").join(bounds, labels_match("k", "b", labels)).filter("_v BETWEEN _low AND _high")
        # The smallest value falls into the first part and the largest into the last, so the bounds always move. Wide bounds are halved first.
        wide = F.col("_high") - F.col("_low") > F.lit(LARGEST)
        share = F.when(wide, (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)).otherwise((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")))
        part = F.least(F.floor(share * parts), F.lit(parts - 1)).alias("_part")
        counts = inside.groupBy(*[F.col(f"b.{c}").alias(c) for c in labels], "_rank", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        order = Window.partitionBy(*labels).orderBy("_part")
        upto = counts.withColumn("_upto", F.sum("_n").over(order))
        chosen = upto.filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        at = stored(chosen.select(*labels, "_low", "_high", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")), "quantile-bounds")
        done.append(at.filter("_low = _high"))
        open_series = at.filter("_low < _high")
    return reduce(DataFrame.unionByName, done).select(*labels, F.col("_low").alias("quantile"))


def labels_match(left: str, right: str, labels: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in labels])


def pass_rate(outcomes: DataFrame, labels: list[str]) -> DataFrame:
    """Share of passed checks; null where nothing was checked."""
    passed = F.count_if(F.col("result") == "pass")
    return outcomes.groupBy(*labels).agg(F.try_divide(passed, F.count("*")).alias("pass_rate"))


def top_failing(outcomes: DataFrame, n: int = 10) -> DataFrame:
    failed = outcomes.filter(F.col("result") == "fail").groupBy("check_name").agg(F.count("*").alias("failures"))
    return failed.orderBy(F.desc("failures"), "check_name").limit(n)


def last_hours(events: DataFrame, hours: int, ts: str = "ts") -> DataFrame:
    """The events of the hours up to the newest one."""
    newest = events.agg(F.max(ts).alias("_t")).scalar()
    return events.filter(F.col(ts) > newest - F.make_dt_interval(F.lit(0), F.lit(hours)))


def landing_totals(events: DataFrame) -> DataFrame:
    """Materializations and landed rows per asset and status."""
    return events.groupBy("asset", "status").agg(
        F.count("*").alias("materializations"), F.sum("rows").alias("rows_landed")
    )


def tick_summary(reports: DataFrame, labels: list[str]) -> DataFrame:
    """Incidents diagnosed, remediated and failed."""
    failed = F.col("failed")
    return reports.groupBy(*labels).agg(
        F.count_if(~failed).alias("diagnosed"),
        F.count_if(~failed & (F.col("action_status") == "executed")).alias("auto_remediated"),
        F.count_if(failed).alias("failed"),
    )


def error_lines(lines: DataFrame, containers: str) -> DataFrame:
    """Log lines of matching containers that mention an error."""
    line = F.col("line")
    # The selector is anchored: the whole container name has to match.
    named = F.col("container").rlike(f"^(?:{containers})$")
    return lines.filter(named & (line.contains("ERROR") | line.contains("error")))


def sample_lateness(samples: DataFrame, ts: str = "ts", arrived: str = "arrived_at", max_age_hours: int = 168) -> DataFrame:
    """Mark samples that were older than the allowed age when they arrived."""
    limit = F.col(arrived) - F.make_dt_interval(F.lit(0), F.lit(max_age_hours))
    return samples.withColumn("rejected", F.coalesce(F.col(ts) < limit, F.lit(False)))

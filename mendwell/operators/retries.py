"""Retryability and planned backoff of fetch and model-call attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.session import work_dir
from mendwell.sources.files import write_table

# Attempts and waits (seconds) of fetches and of model calls, and
# the model-call errors worth another attempt.
FETCH_ATTEMPTS, FETCH_MAX_WAIT = 5, 30
MODEL_ATTEMPTS, MODEL_MAX_WAIT = 4, 15
MIN_WAIT = 2
MODEL_RETRYABLE = [
    "RateLimitError",
    "InternalServerError",
    "Timeout",
    "APITimeoutError",
    "APIConnectionError",
    "ServiceUnavailableError",
]


def fetch_retryable(kind: Column, status: Column) -> Column:
    """Timeouts and network errors, server errors, and 429."""
    by_status = (kind == "status") & ((status >= 500) | (status == 429))
    return F.coalesce(kind.isin("timeout", "network") | by_status, F.lit(False))


def model_retryable(error_type: Column) -> Column:
    return F.coalesce(error_type.isin(MODEL_RETRYABLE), F.lit(False))


def backoff_seconds(attempt: Column, max_wait: int = FETCH_MAX_WAIT) -> Column:
    """Wait after a failed attempt: 1, 2, 4, ... held between the minimum and the maximum."""
    # Past 2^30 the maximum always wins; capping the exponent avoids overflow.
    doubled = F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30)))
    return F.least(F.greatest(doubled, F.lit(float(MIN_WAIT))), F.lit(float(max_wait)))


def retry_plan(
    attempts: DataFrame, request: str, order: str, retryable: Column, max_attempts: int, max_wait: int
) -> DataFrame:
    """Number the attempts of each request and plan what follows each of them.

    Every attempt is numbered; those at or past ``max_attempts`` are exhausted. Attempts are
    dealt by ranges of request and order, numbered within each range, and moved on by
    the counts of the ranges before it, so that a request of very many attempts is numbered by several
    tasks. The dealt rows are written, as ranges drawn twice may differ.
    """
    ranges = attempts.repartitionByRange(request, order).withColumn("_range", F.spark_partition_id())
    dealt = write_table(ranges, work_dir(attempts.sparkSession, "attempts"))
    before = Window.partitionBy(request).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(request, "_range").agg(F.count("*").alias("_n"))
    earlier = counts.select(F.col(request).alias("_request"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(request, "_range").orderBy(order)
    placed = dealt.withColumn("_at", F.row_number().over(inside))
    same = F.col(request).eqNullSafe(F.col("_request")) & (F.col("_range") == F.col("_of"))
    attempt = (F.col("_before") + F.col("_at")).cast("int").alias("attempt")
    numbered = placed.join(earlier, same).select(*attempts.columns, attempt)
    last = F.col("attempt") >= max_attempts
    return numbered.select(
        "*",
        retryable.alias("retryable"),
        (retryable & last).alias("exhausted"),
        F.when(retryable & ~last, backoff_seconds(F.col("attempt"), max_wait)).alias("wait_seconds"),
    )

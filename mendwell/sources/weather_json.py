"""Column-oriented daily weather payloads to one row per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The daily variables of the weather source, in column order.
DAILY_VARS = [
    "temperature_2m_max",
    "temperature_2m_min",
    "temperature_2m_mean",
    "precipitation_sum",
    "rain_sum",
    "snowfall_sum",
    "wind_speed_10m_max",
    "wind_gusts_10m_max",
]

_DAILY = "time: ARRAY<STRING>, " + ", ".join(f"{v}: ARRAY<DOUBLE>" for v in DAILY_VARS)
PAYLOAD_SCHEMA = f"daily STRUCT<{_DAILY}>, _bad STRING"


def parse_payloads(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Add ``daily`` and ``reject_reason``; the reason is null for a usable payload."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = payloads.withColumn("_p", F.from_json(F.col(text), PAYLOAD_SCHEMA, options))
    daily = F.col("_p.daily")
    ragged = F.lit(False)
    for var in DAILY_VARS:
        values = daily[var]
        given = values.isNotNull() & (F.size(values) > 0)
        ragged = ragged | F.coalesce(given & (F.size(values) != F.size(daily["time"])), F.lit(False))
    bad_day = F.exists(daily["time"], lambda d: F.try_to_date(d, "yyyy-MM-dd").isNull())
    reason = (
        F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), "malformed payload")
        .when(daily["time"].isNull(), "missing daily.time")
        .when(ragged, "columns differ in length")
        .when(bad_day, "unparseable date")
    )
    return parsed.select(*payloads.columns, daily.alias("daily"), reason.alias("reject_reason"))


def _filled(var: str) -> Column:
    """The variable's values, or as many nulls as there are days."""
    values = F.col("daily")[var]
    blank = F.array_repeat(F.lit(None).cast("double"), F.size("daily.time"))
    return F.when(values.isNotNull() & (F.size(values) > 0), values).otherwise(blank).alias(var)


def payload_rows(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per day of every usable payload: ``keep`` columns, ``date``, eight doubles."""
    keep = keep or []
    usable = parsed.filter(F.col("reject_reason").isNull())
    zipped = F.arrays_zip(F.col("daily.time").alias("time"), *[_filled(v) for v in DAILY_VARS])
    flat = usable.select(*keep, F.inline(zipped).alias("time", *DAILY_VARS))
    return flat.select(*keep, F.to_date("time", "yyyy-MM-dd").alias("date"), *DAILY_VARS)


def payload_bounds(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Days per payload with its first and last element in payload order."""
    days = F.col("daily.time")
    return parsed.filter(F.col("reject_reason").isNull()).select(
        *keep,
        F.size(days).cast("long").alias("days"),
        F.coalesce(F.try_element_at(days, F.lit(1)), F.lit("")).alias("date_min"),
        F.coalesce(F.try_element_at(days, F.lit(-1)), F.lit("")).alias("date_max"),
    )


def rejected_payloads(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull()).drop("daily")

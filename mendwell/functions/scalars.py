"""Scalar column expressions: casts, months, paths, text and JSON."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(col: Column) -> Column:
    """Number to INT, halves to the even neighbour (Spark's own cast truncates)."""
    return F.rint(col.cast("double")).cast("int")


def non_empty(col: Column) -> Column:
    """Null for both null and the empty string."""
    return F.when(col != "", col)


def or_default(col: Column, default: Column | str) -> Column:
    """``col`` unless it is null or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(non_empty(col), fallback)


def month_start(col: Column) -> Column:
    return F.trunc(col.cast("date"), "MM")


def month_end(col: Column) -> Column:
    return F.last_day(col.cast("date"))


def next_month(col: Column) -> Column:
    return F.add_months(month_start(col), 1)


def partition_key(col: Column) -> Column:
    """Date to its monthly partition key ``YYYY-MM-01``."""
    return F.date_format(month_start(col), "yyyy-MM-dd")


def previous_partition_key(key: Column) -> Column:
    """The key of the month before ``key``; null when ``key`` has no year and month.

    Only the year and month count, so a mid-month day lands on a real monthly
    partition.
    """
    parts = F.regexp_extract(key, r"^(\d{4}).(\d{2})", 1), F.regexp_extract(key, r"^(\d{4}).(\d{2})", 2)
    first = F.try_to_date(F.concat_ws("-", parts[0], parts[1], F.lit("01")), "yyyy-MM-dd")
    return F.date_format(F.add_months(first, -1), "yyyy-MM-dd")


def hive_path(prefix: str, date: Column) -> Column:
    """Object folder of a monthly partition below ``prefix``."""
    return F.format_string(
        prefix.rstrip("/").replace("%", "%%") + "/year=%04d/month=%02d/", F.year(date), F.month(date)
    )


def quarantine_path(path: Column, layer: str = "bronze") -> Column:
    """Mirror of ``path`` under the layer's ``_quarantine`` folder."""
    head = f"{layer}/"
    rest = F.when(path.startswith(head), F.substring(path, F.lit(len(head) + 1), F.length(path))).otherwise(path)
    return F.concat(F.lit(f"{layer}/_quarantine/"), rest)


def bare_name(asset_key: Column) -> Column:
    """Last segment of an asset key written with ``/`` or ``.``."""
    return F.element_at(F.split(asset_key, "[/.]"), -1)


def after_slack(col: Column, now: datetime, slack_hours: int) -> Column:
    """True where ``col`` lies more than ``slack_hours`` past ``now``."""
    # As text, so that neither Python's nor the session's time zone shifts it.
    limit = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(slack_hours))
    return col.cast("timestamp_ntz") > limit


def clip(col: Column, width: int) -> Column:
    return F.substring(col, 1, width)


def padded(col: Column, width: int) -> Column:
    """Pad on the right to ``width`` without cutting longer text."""
    return F.when(F.length(col) < width, F.rpad(col, width, " ")).otherwise(col)


def tail(arr: Column, n: int) -> Column:
    """Last ``n`` elements, or the whole array when it is shorter."""
    start = F.greatest(F.size(arr) - F.lit(n) + 1, F.lit(1))
    return F.slice(arr, start, F.lit(n))


def short_hash(text: Column, width: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, width)


def sorted_json(fields: dict[str, Column]) -> Column:
    """JSON object text with keys in alphabetical order, nulls kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def strip_code_fence(text: Column) -> Column:
    """Text inside a Markdown code fence; unfenced text is only trimmed."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    opened = F.regexp_replace(bare, r"^```[^\n]*(\n|$)", "")
    closed = F.regexp_replace(opened, r"```$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(closed, r"^\s+|\s+$", "")).otherwise(bare)


def contains_any(col: Column, needles: list[str]) -> Column:
    """True where ``col`` holds one of ``needles``; false for null."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | col.contains(needle)
    return F.coalesce(hit, F.lit(False))


def first_match(rules: list[tuple[Column, object]], default: object) -> Column:
    """Value of the first rule whose condition holds."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return F.lit(default) if chain is None else chain.otherwise(default)

"""The three allowlisted remediations: guards, plans, decisions, approvals, rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.functions.scalars import (
    contains_any,
    first_match,
    non_empty,
    previous_partition_key,
    quarantine_path,
)
from mendwell.session import broadcast_if_small

# Names of the actions.
RETRY, SLIP, COERCE = "retry-with-backoff", "partition-window-slip", "coerce-to-string"
ALLOWLIST = [COERCE, SLIP, RETRY]

# Ordered flag rules (text to look for, flag), transient error
# types, and the signals of a late partition and of a schema failure.
FLAG_RULES = [
    ("tlc_5xx", "tlc_5xx"),
    ("tlc_yellow", "tlc_5xx"),
    ("weather_429", "weather_429"),
    ("weather_nyc_daily", "weather_429"),
]
TRANSIENT_TYPES = ["HTTPStatusError", "TimeoutException", "ChaosTriggered"]
LATE_MESSAGES = ["late_partition", "not yet published", "404"]
LATE_TYPES = ["NotFound"]
SCHEMA_MESSAGES = ["schema", "vendor_id", "temperature_2m", "column", "type", "did not match"]
SCHEMA_TYPES = ["ValidationError", "SchemaError"]
LATE_FLAG = "late_partition"

# Reasons for skipping and descriptions of what was planned.
NOT_AUTOMATIC = "diagnosis.can_auto_remediate=false"
OFF_LIST = "proposed_fix '%s' not on allowlist"
NOT_WIRED = "no remediation deps wired"
GUARD_REJECTED = "guard rejected"
FLAG_CLEARED = "cleared chaos flag '%s' and queued re-materialization"
NO_FLAG = "queued re-materialization (no flag to clear)"
SLIPPED = "slipped partition %s -> %s"
QUARANTINED = "wrote %d coerced rows to %s; queued re-ingest"
NO_OBJECT = "could not locate bronze parquet for asset"

# Prefix of the tags put on planned runs.
TAG = "mendwell"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _is_bronze() -> Column:
    return F.lower(_text("asset_key")).startswith("bronze")


def _has_partition() -> Column:
    return non_empty(F.col("partition_key")).isNotNull()


def fault_flag(strict: bool = False) -> Column:
    """The flag an incident points to, null for none.

    Asset names are signals too, so any failure of a known asset counts as
    transient. ``strict`` reads the message and the error type only.
    """
    fields = ["error_message", "error_type"] if strict else ["asset_key", "error_message", "error_type"]
    blob = F.lower(F.concat_ws(" ", *[_text(f) for f in fields]))
    return first_match([(blob.contains(text), F.lit(flag)) for text, flag in FLAG_RULES], None)


def retry_guard(strict: bool = False) -> Column:
    transient = contains_any(_text("error_type"), TRANSIENT_TYPES)
    return _is_bronze() & _has_partition() & (fault_flag(strict).isNotNull() | transient)


def slip_guard() -> Column:
    late = contains_any(F.lower(_text("error_message")), LATE_MESSAGES) | contains_any(_text("error_type"), LATE_TYPES)
    return _is_bronze() & _has_partition() & late


def coerce_guard() -> Column:
    message = contains_any(F.lower(_text("error_message")), SCHEMA_MESSAGES)
    return _is_bronze() & (message | contains_any(_text("error_type"), SCHEMA_TYPES))


def guard_passes(fix: Column) -> Column:
    """Whether the guard of the named action accepts the incident; false off the list."""
    return (
        F.when(fix == RETRY, retry_guard()).when(fix == SLIP, slip_guard()).when(fix == COERCE, coerce_guard())
    ).otherwise(False)


# Datasets an asset name can point to, in this order.
DATASETS = ["tlc", "weather"]


def bronze_dataset() -> Column:
    """Dataset an asset's files belong to."""
    asset = F.lower(_text("asset_key"))
    return first_match([(asset.contains(d), F.lit(d)) for d in DATASETS], None)


def _with_cleared_flags(df: DataFrame, fix: str, runs: str, flags: DataFrame) -> DataFrame:
    """Add ``cleared_flag``: set for the first executed retry that meets an active flag.

    Incidents are handled newest first, so of many pointing to one flag the
    newest clears it and the others find nothing to clear.
    """
    retrying = F.col(runs) & (F.col(fix) == RETRY)
    flagged = df.withColumn("_flag", F.when(retrying, fault_flag()))
    handled = F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), F.col("incident_id"))
    winners = (
        flagged.filter(F.col("_flag").isNotNull())
        .groupBy("_flag")
        .agg(F.min(handled)["incident_id"].alias("_winner"))
        .join(flags.select(F.col("flag").alias("_flag")).distinct(), "_flag", "left_semi")
    )
    # At most one row per flag of the fixed rules.
    joined = flagged.join(F.broadcast(winners), "_flag", "left")
    cleared = F.when(F.col("_winner") == F.col("incident_id"), F.col("_flag"))
    return joined.withColumn("cleared_flag", cleared).drop("_flag", "_winner")


def _with_bronze_object(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``bronze_path`` and ``bronze_rows`` of the incident's own partition.

    An incident without a partition takes the newest landed one of its dataset.
    ``manifest`` has ``dataset, partition_key, path, rows``, one row per partition.
    """
    manifest = manifest.filter(F.col("dataset").isin(DATASETS))
    # One row per dataset, so at most two.
    newest = manifest.groupBy("dataset").agg(F.max("partition_key").alias("_newest"))
    objects = manifest.select(
        "dataset",
        F.col("partition_key").alias("_object_key"),
        F.col("path").alias("bronze_path"),
        F.col("rows").alias("bronze_rows"),
    )
    located = df.withColumn("dataset", bronze_dataset()).join(F.broadcast(newest), "dataset", "left")
    located = located.withColumn("_object_key", F.coalesce(non_empty(F.col("partition_key")), "_newest"))
    return located.join(broadcast_if_small(objects), ["dataset", "_object_key"], "left").drop(
        "dataset", "_object_key", "_newest"
    )


def _tags(fix: Column, tag: str) -> Column:
    """Tags of the next run; the optional ones only where they have a value."""
    tags = F.create_map(
        F.lit(f"{tag}.remediation"),
        fix,
        F.lit(f"{tag}.incident_id"),
        F.col("incident_id"),
        F.lit(f"{tag}.cleared_flag"),
        F.col("cleared_flag"),
        F.lit(f"{tag}.partition_slipped_from"),
        F.when(fix == SLIP, F.col("partition_key")),
        F.lit(f"{tag}.quarantine_key"),
        F.when(fix == COERCE, F.col("quarantine_key")),
    )
    return F.map_filter(tags, lambda _, v: v.isNotNull())


def with_plans(df: DataFrame, fix: str, runs: str, flags: DataFrame, manifest: DataFrame, tag: str = TAG) -> DataFrame:
    """Add the outcome of carrying out ``fix`` where the boolean ``runs`` is true.

    ``success`` is null where nothing runs; ``action_error`` tells why a plan
    could not be made at all.
    """
    f, does = F.col(fix), F.col(runs)
    prepared = _with_bronze_object(_with_cleared_flags(df, fix, runs, flags), manifest)
    prepared = prepared.withColumns(
        {
            "slipped_partition": F.when(does & (f == SLIP), previous_partition_key(F.col("partition_key"))),
            "quarantine_key": F.when(does & (f == COERCE), quarantine_path(F.col("bronze_path"))),
        }
    )
    # Fixed value: the error text.
    unparsed = does & (f == SLIP) & F.col("slipped_partition").isNull()
    error = F.when(unparsed, F.concat(F.lit("unparseable partition_key: '"), F.col("partition_key"), F.lit("'")))
    success = F.when(does & error.isNull(), (f != COERCE) | F.col("quarantine_key").isNotNull())
    description = (
        F.when(
            (f == RETRY) & F.col("cleared_flag").isNotNull(),
            F.format_string(FLAG_CLEARED, "cleared_flag"),
        )
        .when(f == RETRY, F.lit(NO_FLAG))
        .when(f == SLIP, F.format_string(SLIPPED, "partition_key", "slipped_partition"))
        .when(
            F.col("quarantine_key").isNotNull(),
            F.format_string(QUARANTINED, "bronze_rows", "quarantine_key"),
        )
        .otherwise(F.lit(NO_OBJECT))
    )
    target = F.when(f == SLIP, F.col("slipped_partition")).otherwise(F.col("partition_key"))
    next_run = F.struct(
        F.col("asset_key").alias("asset_key"),
        target.alias("partition_key"),
        _tags(f, tag).alias("run_tags"),
        # A quarantined partition is landed already and has to be replaced.
        (f == COERCE).alias("force"),
    )
    undo = F.map_filter(
        F.create_map(
            F.lit("cleared_flag"),
            F.col("cleared_flag"),
            F.lit("original_partition"),
            F.when(f == SLIP, F.col("partition_key")),
            F.lit("slipped_partition"),
            F.col("slipped_partition"),
            F.lit("quarantine_key"),
            F.col("quarantine_key"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return prepared.withColumns(
        {
            "action_error": error,
            "success": success,
            "description": F.when(success.isNotNull(), description),
            "next_run": F.when(success, next_run),
            "rollback_data": F.when(success, undo),
        }
    )


def plan(incidents: DataFrame, action: str, flags: DataFrame, manifest: DataFrame, tag: str = TAG) -> DataFrame:
    """Plans of one action for every incident its guard accepts."""
    chosen = incidents.withColumn("action", F.lit(action)).filter(guard_passes(F.lit(action)))
    return with_plans(chosen.withColumn("_runs", F.lit(True)), "action", "_runs", flags, manifest, tag).drop("_runs")


def decide_actions(
    diagnosed: DataFrame, flags: DataFrame, manifest: DataFrame, wired: bool = True, tag: str = TAG
) -> DataFrame:
    """Turn diagnoses into action decisions: the first failing condition gives the reason."""
    fix = F.coalesce(F.col("proposed_fix"), F.lit(""))
    allowed = fix.isin(ALLOWLIST)
    reason = (
        F.when(~F.coalesce(F.col("can_auto_remediate"), F.lit(False)), NOT_AUTOMATIC)
        .when(~allowed, F.format_string(OFF_LIST, fix))
        .when(F.lit(not wired), NOT_WIRED)
        .when(~guard_passes(fix), GUARD_REJECTED)
    )
    judged = diagnosed.withColumns({"action_reason": reason, "_runs": reason.isNull()})
    planned = with_plans(judged, "proposed_fix", "_runs", flags, manifest, tag)
    status = (
        F.when(~F.col("_runs"), "skipped")
        .when(F.col("action_error").isNotNull(), "failed")
        .when(F.col("success"), "executed")
        .otherwise("execute_returned_failure")
    )
    named = F.col("_runs") | (F.col("action_reason") == GUARD_REJECTED)
    return planned.withColumns(
        {
            "action_status": status,
            "action": F.when(named, fix),
            "action_reason": F.coalesce("action_reason", "action_error"),
        }
    ).drop("_runs")


def decide_approvals(
    approvals: DataFrame, incidents: DataFrame, flags: DataFrame, manifest: DataFrame, tag: str = TAG
) -> DataFrame:
    """Outcome of human approvals ``(approval_id, incident_id, action)``."""
    found = approvals.join(incidents.withColumn("_found", F.lit(True)), "incident_id", "left")
    act = F.coalesce(F.col("action"), F.lit(""))
    runs = F.coalesce(F.col("_found"), F.lit(False)) & act.isin(ALLOWLIST) & guard_passes(act)
    planned = with_plans(found.withColumn("_runs", runs), "action", "_runs", flags, manifest, tag)
    status = (
        F.when(F.col("_found").isNull(), "not_found")
        .when(~act.isin(ALLOWLIST), "off_allowlist")
        .when(~F.col("_runs") | F.col("action_error").isNotNull(), "guard_failed")
        .otherwise("applied")
    )
    # The texts of the outcomes.
    detail = (
        F.when(status == "not_found", F.format_string("no incident '%s'", "incident_id"))
        .when(
            status == "off_allowlist",
            F.format_string(f"action '%s' not on allowlist. Allowed: {', '.join(ALLOWLIST)}.", act),
        )
        .when(
            status == "guard_failed",
            F.format_string("action '%s' was rejected by its guard or failed to execute.", act),
        )
        .otherwise(F.col("description"))
    )
    return planned.select(
        "approval_id",
        "incident_id",
        "action",
        status.alias("status"),
        detail.alias("detail"),
        "next_run",
        "rollback_data",
    )


def flags_after(flags: DataFrame, done: DataFrame) -> DataFrame:
    """The flags that stay raised: carried-out retries clear theirs, any carried-out slip the one of late partitions.

    ``done`` has ``action, success, cleared_flag``.
    """
    slipped = F.when(F.col("success") & (F.col("action") == SLIP), LATE_FLAG)
    gone = done.select(F.explode(F.array("cleared_flag", slipped)).alias("flag")).dropna().distinct()
    return flags.join(gone, "flag", "left_anti")


def approved_fixes(decided: DataFrame, seq: Column, at: Column) -> DataFrame:
    """State changes that stamp the action of each applied approval on its incident."""
    applied = decided.filter(F.col("status") == "applied")
    return applied.select(
        "incident_id", seq.alias("seq"), F.lit("fix").alias("kind"), at.alias("changed_at"), F.col("action").alias("proposed_fix")
    )


def forced_partitions(runs: DataFrame) -> DataFrame:
    """Distinct ``(year, month)`` that planned runs have to replace."""
    month = F.to_date("partition_key")
    forced = runs.filter(F.col("force") & month.isNotNull())
    return forced.select(F.year(month).alias("year"), F.month(month).alias("month")).distinct()


def pending_runs(plans: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned runs that have not completed, for whatever launches them."""
    due = plans.filter(F.col("next_run").isNotNull()).select("incident_id", "next_run.*")
    return due.join(completed.select("incident_id"), "incident_id", "left_anti")


def coerce_to_strings(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every column as text, except the partition columns in ``keep``."""
    keep = keep or []
    return df.select(*[F.col(c) if c in keep else F.col(c).cast("string").alias(c) for c in df.columns])


def quarantine_rows(bronze: DataFrame, plans: DataFrame) -> DataFrame:
    """Text copies of the bronze partitions that successful coerce plans name."""
    wanted = plans.filter(F.col("quarantine_key").isNotNull()).select(
        F.regexp_extract("quarantine_key", r"year=(\d+)", 1).cast("int").alias("year"),
        F.regexp_extract("quarantine_key", r"month=(\d+)", 1).cast("int").alias("month"),
    )
    named = bronze.join(broadcast_if_small(wanted.distinct()), ["year", "month"], "left_semi")
    return coerce_to_strings(named, ["year", "month"])


def rollback(results: DataFrame) -> DataFrame:
    """What undoing each result takes: a tombstone, a flag to set again, or nothing.

    ``results`` has ``incident_id, rollback_data``. Nothing is deleted: readers of
    the quarantine leave out paths with a tombstone.
    """
    data = F.col("rollback_data")
    kind = (
        F.when(data["quarantine_key"].isNotNull(), "tombstone")
        .when(data["cleared_flag"].isNotNull(), "reset_flag")
        .otherwise("none")
    )
    subject = F.coalesce(data["quarantine_key"], data["cleared_flag"])
    return results.filter(data.isNotNull()).select("incident_id", kind.alias("undo"), subject.alias("subject"))


def live_quarantine(manifest: DataFrame, undone: DataFrame) -> DataFrame:
    """Quarantine objects without a tombstone."""
    gone = undone.filter(F.col("undo") == "tombstone").select(F.col("subject").alias("quarantine_key")).distinct()
    return manifest.join(gone, "quarantine_key", "left_anti")

"""Failed runs to incidents, and the state of the incident log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.functions.scalars import bare_name, clip, first_match, non_empty, or_default, padded, short_hash
from mendwell.session import broadcast_if_small
from mendwell.sources.files import stored

# Ordered classifier rules (error type, asset or message, category).
# An empty second part matches every asset. The first matching rule wins.
CLASSIFIER_RULES = [
    ("ChaosTriggered", "tlc_5xx", "upstream_outage"),
    ("ChaosTriggered", "weather_429", "upstream_outage"),
    ("ChaosTriggered", "late_partition", "upstream_outage"),
    ("ChaosTriggered", "duckdb_lock", "infra"),
    ("ChaosTriggered", "schema", "schema_drift"),
    ("HTTPStatusError", "", "upstream_outage"),
    ("TimeoutException", "", "upstream_outage"),
    ("ConnectError", "", "upstream_outage"),
    ("DbtRuntimeError", "", "dbt_error"),
    ("DagsterDbtCliRuntimeError", "", "dbt_error"),
    ("AssertionError", "stg_", "data_quality"),
    ("ValueError", "weather", "schema_drift"),
]

SUMMARY = ["incident_id", "asset_key", "partition_key", "error_type", "status", "proposed_fix", "created_at"]


def incident_id(run_id: Column, asset_key: Column) -> Column:
    """The same failed run and asset always give the same id."""
    return short_hash(F.concat_ws("|", run_id, asset_key), 32)


FOLDED = ["asset_key", "error_type", "error_message", "stack_trace"]


def _usable(name: str, line: Column | None = None) -> Column:
    """Whether a line gives a field a value; ``line`` is a struct, else the row."""
    part = F.col if line is None else line.getField
    return part(name).isNotNull() if name == "asset_key" else part("is_failure") & (part(name) != "")


def partial_fold(log: DataFrame) -> DataFrame:
    """One row per run: for each field its last value and the line that gave it.

    ``log`` has ``run_id, seq, asset_key, is_failure, error_type, error_message,
    stack_trace``. The asset key is the last one named on any line, the error
    fields the last non-empty ones of failure lines; of lines with one number the larger value counts.
    Only line numbers are aggregated, four of them per run and with a map-side part, so a run that owns a
    large share of all lines is reduced before the shuffle; the texts of the few winning lines are fetched afterwards.
    """
    # Other lines cannot be the last of anything.
    telling = log.filter(F.col("asset_key").isNotNull() | F.col("is_failure")).select("run_id", "seq", "is_failure", *FOLDED)
    places = [f"_{c}" for c in FOLDED]
    last = telling.groupBy("run_id").agg(*[F.max(F.when(_usable(c), F.col("seq"))).alias(f"_{c}") for c in FOLDED])
    last = stored(last, "last-lines")
    wanted = last.select("run_id", F.explode(F.array_distinct(F.array_compact(F.array(*places)))).alias("seq"))
    lines = telling.join(broadcast_if_small(wanted), ["run_id", "seq"])
    held = lines.groupBy("run_id").agg(F.collect_list(F.struct("seq", "is_failure", *FOLDED)).alias("_lines"))

    def newest(name: str) -> Column:
        mine = F.filter("_lines", lambda x: (x["seq"] == F.col(f"_{name}")) & F.coalesce(_usable(name, x), F.lit(False)))
        value = F.array_max(F.transform(mine, lambda x: x[name]))
        return F.when(F.col(f"_{name}").isNotNull(), F.struct(F.col(f"_{name}").alias("seq"), value.alias("value"))).alias(name)

    return last.join(held, "run_id", "left").select("run_id", *[newest(c) for c in FOLDED])


def merge_folds(parts: DataFrame) -> DataFrame:
    """One partial fold per run from several of them, as streaming batches leave behind."""
    return parts.groupBy("run_id").agg(*[F.max(c).alias(c) for c in FOLDED])


def folded_values(fold: DataFrame) -> DataFrame:
    """The fold without the line numbers; runs that never name an asset are dropped."""
    named = fold.filter(F.col("asset_key").isNotNull())
    return named.select("run_id", *[F.col(c)["value"].alias(c) for c in FOLDED])


def capture_incidents(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Incidents of all failed runs that name an asset.

    ``runs`` has ``run_id, job_name, status, partition_key, ended_at``. The log is
    folded to one row per run before it meets the runs.
    """
    return incidents_of(runs, partial_fold(log))


def incidents_of(runs: DataFrame, fold: DataFrame) -> DataFrame:
    failed = runs.filter(F.col("status") == "FAILURE")
    joined = failed.join(folded_values(fold), "run_id")
    return joined.select(
        incident_id(F.col("run_id"), F.col("asset_key")).alias("incident_id"),
        F.col("ended_at").alias("created_at"),
        "asset_key",
        "partition_key",
        or_default(F.col("error_type"), "Unknown").alias("error_type"),
        or_default(F.col("error_message"), "").alias("error_message"),
        or_default(F.col("stack_trace"), "").alias("stack_trace"),
        F.create_map(
            F.lit("run_id"), "run_id", F.lit("job_name"), "job_name", F.lit("partition"), "partition_key"
        ).alias("recent_metadata"),
        "run_id",
    )


def full_records(captured: DataFrame, lineage: DataFrame, tags: DataFrame, samples: DataFrame) -> DataFrame:
    """Captured incidents with ``upstream_lineage``, the run's tags in ``recent_metadata``, and ``sample_rows``.

    ``lineage`` has ``asset_key, upstream`` (a list), ``tags`` ``run_id, tags`` (a map), ``samples``
    ``target, sample_rows`` of failed checks; a target is the bare name of an asset. Lists are empty where nothing is known; a tag doesn't replace
    what the capture says itself.
    """
    per_target = stored(samples.groupBy("target").agg(F.flatten(F.collect_list("sample_rows")).alias("sample_rows")), "target-samples")
    per_asset = stored(lineage.select("asset_key", F.col("upstream").alias("upstream_lineage")), "asset-lineage")
    # Lists that many incidents share are attached last, so that no shuffle repeats them.
    named = captured.withColumn("_name", bare_name(F.col("asset_key"))).join(tags.select("run_id", "tags"), "run_id", "left")
    joined = named.join(broadcast_if_small(per_asset), "asset_key", "left").join(broadcast_if_small(per_target), F.col("_name") == F.col("target"), "left")
    own = F.col("recent_metadata")
    extra = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(own), k))
    return joined.select(
        *[c for c in captured.columns if c != "recent_metadata"],
        F.coalesce("upstream_lineage", F.array().cast("array<string>")).alias("upstream_lineage"),
        F.map_concat(own, extra).alias("recent_metadata"),
        F.coalesce("sample_rows", F.array().cast("array<map<string,string>>")).alias("sample_rows"),
    )


def append_new(opened: DataFrame, incoming: DataFrame) -> DataFrame:
    """Captured incidents that the log does not hold yet; of those that share an id the one created first."""
    each = incoming.groupBy("incident_id").agg(F.min_by(F.struct("*"), "created_at").alias("_first"))
    fresh = each.select("_first.*")
    return fresh.join(opened.select("incident_id"), "incident_id", "left_anti")


def fold_changes(changes: DataFrame) -> DataFrame:
    """``incident_id, resolved_seq, resolved_at, fix_seq, proposed_fix``: the last change of each kind.

    ``changes`` has ``incident_id, seq, kind, changed_at, proposed_fix``. Numbers and times are
    aggregated, the text of the last fix is fetched afterwards; of fixes with one number the larger counts.
    """
    resolved = F.when(F.col("kind") == "resolve", F.col("seq"))
    last = changes.groupBy("incident_id").agg(
        F.max(resolved).alias("resolved_seq"),
        F.max_by("changed_at", resolved).alias("resolved_at"),
        F.max(F.when(F.col("kind") == "fix", F.col("seq"))).alias("fix_seq"),
    )
    fixes = changes.filter("kind = 'fix'").select("incident_id", F.col("seq").alias("fix_seq"), "proposed_fix")
    found = fixes.join(last.select("incident_id", "fix_seq"), ["incident_id", "fix_seq"]).groupBy("incident_id").agg(F.array_max(F.collect_set("proposed_fix")).alias("proposed_fix"))
    return last.join(found, "incident_id", "left")


def with_status(state: DataFrame) -> DataFrame:
    return state.withColumn("status", F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise("open"))


def incident_state(opened: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest state of every incident from the append-only log.

    Resolving and stamping a fix touch separate columns, so each takes its own last change.
    """
    latest = fold_changes(changes).drop("resolved_seq", "fix_seq")
    return with_status(opened.join(latest, "incident_id", "left"))


def state_after(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state once ``changes`` are added to the log, all numbered above those that ``state`` holds.

    Only the new changes are folded.
    """
    moved = ["resolved_at", "proposed_fix"]
    later = fold_changes(changes).withColumnsRenamed({c: f"_{c}" for c in moved})
    joined = state.join(later, "incident_id", "left")
    values = [F.when(F.col(seq).isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for seq, c in zip(("resolved_seq", "fix_seq"), moved, strict=True)]
    kept = [c for c in state.columns if c not in (*moved, "status")]
    return with_status(joined.select(*kept, *values)).select(*state.columns)


def open_incidents(state: DataFrame, limit: int = 50) -> DataFrame:
    """The newest open incidents; ids break ties."""
    newest = [F.col("created_at").desc(), F.col("incident_id")]
    return state.filter(F.col("status") == "open").orderBy(*newest).limit(limit)


def undiagnosed(state: DataFrame) -> DataFrame:
    """Open incidents without a proposed fix."""
    return state.filter((F.col("status") == "open") & non_empty(F.col("proposed_fix")).isNull())


def diagnosis_queue(state: DataFrame, limit: int = 10) -> DataFrame:
    """The incidents of one tick. Filtered before the limit, so old ones do not starve."""
    return undiagnosed(state).orderBy(F.col("created_at").desc(), "incident_id").limit(limit)


def incident_by_id(state: DataFrame, wanted: str) -> DataFrame:
    return state.filter(F.col("incident_id") == wanted)


def summaries(state: DataFrame) -> DataFrame:
    return state.select(*SUMMARY)


def details(state: DataFrame, reports: DataFrame) -> DataFrame:
    """Incident columns with their report, null where there is none or it is unreadable.

    Of several reports the last one counts, by the time it states or else by its text.
    """
    stated = F.coalesce(F.get_json_object("report", "$.generated_at"), F.lit(""))
    readable = reports.filter(F.try_parse_json("report").isNotNull()).groupBy("incident_id").agg(
        F.max_by("report", F.struct(stated, F.col("report"))).alias("report")
    )
    return state.join(readable.select("incident_id", "report"), "incident_id", "left").select(
        *SUMMARY, "error_message", "recent_metadata", "resolved_at", F.col("report").alias("incident_report")
    )


def listing_line(state: DataFrame) -> DataFrame:
    """One text line per incident, as an operator's terminal shows it."""
    line = F.concat_ws(
        "  ",
        clip(F.col("incident_id"), 8),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
        padded(F.col("asset_key"), 35),
        padded(F.col("error_type"), 20),
        clip(F.col("error_message"), 60),
    )
    return state.select("incident_id", line.alias("line"))


def category(error_type: Column, error_message: Column, asset_key: Column) -> Column:
    """Category of an incident by the ordered rules, case-insensitive, else ``unknown``."""
    kind, message, asset = (F.lower(F.coalesce(c, F.lit(""))) for c in (error_type, error_message, asset_key))
    rules = []
    for type_part, text_part, name in CLASSIFIER_RULES:
        condition = kind.contains(type_part.lower())
        if text_part:
            condition = condition & (asset.contains(text_part) | message.contains(text_part))
        rules.append((condition, name))
    return first_match(rules, "unknown")


def classify(incidents: DataFrame) -> DataFrame:
    hint = category(F.col("error_type"), F.col("error_message"), F.col("asset_key"))
    return incidents.withColumn("category_hint", hint)


def embedding_text(
    asset_key: Column, error_type: Column, error_message: Column, proposed_fix: Column | None = None
) -> Column:
    """The short text an incident is embedded by; empty parts are left out."""
    parts = [non_empty(c) for c in (asset_key, error_type, error_message)]
    if proposed_fix is not None:
        fix = non_empty(proposed_fix)
        parts.append(F.when(fix.isNotNull(), F.concat(F.lit("prior fix: "), fix)))
    return F.concat_ws("\n", *parts)

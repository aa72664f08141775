"""Prompts, response validation and incident reports for whole tables of incidents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.functions.scalars import sorted_json, strip_code_fence, tail

# Categories, fallback fix, and texts read as booleans.
CATEGORIES = ["upstream_outage", "schema_drift", "data_quality", "infra", "dbt_error", "unknown"]
FALLBACK_FIX = "file incident for human review"
TRUE_TEXTS = ["1", "true", "t", "yes", "y", "on"]
FALSE_TEXTS = ["0", "false", "f", "no", "n", "off"]

# Headings of a prompt, and what it shows of the lists.
HINT = "Heuristic category guess (you may override): "
INCIDENT_HEAD, CONTEXT_HEAD, SIMILAR_HEAD = "INCIDENT", "CONTEXT", "SIMILAR PAST INCIDENTS"
LOG_HEAD, CLOSING = "recent_log_excerpts (tail):", "Return JSON only."
SIMILAR_LINE = "- asset=%s error_type=%s score=%.2f prior_fix=%s"
PROMPT_LOG_LINES = 10
PROMPT_SIMILAR = 3

DIAGNOSIS = ["category", "root_cause", "proposed_fix", "confidence", "can_auto_remediate"]


def _listed(arr: Column) -> Column:
    """Names in brackets, each in single quotes."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def similar_block(similar: Column) -> Column:
    """One line per similar incident, or ``(none)``."""
    def line(hit: Column) -> Column:
        return F.format_string(SIMILAR_LINE, *[hit[c] for c in ("asset_key", "error_type", "score", "prior_fix")])

    lines = F.array_join(F.transform(F.slice(similar, 1, PROMPT_SIMILAR), line), "\n")
    return F.when(F.size(similar) == 0, "(none)").otherwise(lines)


def build_prompts(context: DataFrame) -> DataFrame:
    """``incident_id, prompt`` for classified incidents with their context bundle."""
    def field(name: str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name), F.lit("")))

    logs = F.array_join(F.transform(tail(F.col("log_lines"), PROMPT_LOG_LINES), lambda x: F.concat(F.lit("  "), x)), "\n")
    hint = F.concat(F.lit(HINT), F.col("category_hint"))
    # concat_ws leaves out the null hint and keeps empty lines.
    prompt = F.concat_ws(
        "\n",
        hint,
        F.lit(INCIDENT_HEAD),
        *[field(c) for c in ("asset_key", "partition_key", "error_type", "error_message")],
        F.lit(""),
        F.lit(CONTEXT_HEAD),
        F.concat(F.lit("upstream: "), _listed(F.col("upstream"))),
        F.concat(F.lit("downstream: "), _listed(F.col("downstream"))),
        F.concat(F.lit("recent_runs: "), F.size("recent_runs").cast("string"), F.lit(" entries")),
        F.lit(LOG_HEAD),
        logs,
        F.lit(""),
        F.lit(SIMILAR_HEAD),
        similar_block(F.col("similar_incidents")),
        F.lit(""),
        F.lit(CLOSING),
    )
    return context.select("incident_id", prompt.alias("prompt"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add the diagnosis fields and ``error``; the error is null for a valid response.

    A code fence is stripped, then the text must be a JSON object with all five
    fields of the right type and a confidence from 0 to 1.
    """
    parsed = responses.withColumn("_v", F.try_parse_json(strip_code_fence(F.col(text))))
    member = {f: F.try_variant_get("_v", f"$.{f}", "variant") for f in DIAGNOSIS}
    fields = parsed.select(
        *responses.columns,
        F.col("_v").isNotNull().alias("_json"),
        *[F.try_variant_get("_v", f"$.{f}", "string").alias(f) for f in DIAGNOSIS],
        *[_kind(member[f]).alias(f"_{f}") for f in DIAGNOSIS],
    )
    number = F.col("confidence").try_cast("double")
    flag_text = F.lower("can_auto_remediate")
    is_scalar = F.col("_can_auto_remediate").isin("BOOLEAN", "STRING", "BIGINT")
    flag = F.when(flag_text.isin(TRUE_TEXTS), True).when(flag_text.isin(FALSE_TEXTS), False)
    typed = fields.withColumns({"confidence": number, "can_auto_remediate": F.when(is_scalar, flag)})
    bad = F.filter(
        F.array(
            *[F.when(F.coalesce(F.col(f"_{f}") != "STRING", F.lit(True)), F.lit(f)) for f in DIAGNOSIS[:3]],
            F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), F.lit("confidence")),
            F.when(F.col("can_auto_remediate").isNull(), F.lit("can_auto_remediate")),
        ),
        lambda x: x.isNotNull(),
    )
    # The error texts.
    error = (
        F.when(F.col(text).isNull(), "no response")
        .when(~F.col("_json"), "model returned non-JSON")
        .when(F.size(bad) > 0, F.concat(F.lit("model JSON did not match schema: "), F.array_join(bad, ", ")))
    )
    return typed.withColumn("error", error).drop("_json", *[f"_{f}" for f in DIAGNOSIS])


def normalise(parsed: DataFrame, allowlist: list[str]) -> DataFrame:
    """Off-list categories become ``unknown``; an off-list fix loses its remediation flag."""
    listed = F.col("can_auto_remediate") & F.col("proposed_fix").isin(allowlist)
    return parsed.withColumns(
        {
            "category": F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("unknown"),
            "can_auto_remediate": F.coalesce(listed, F.lit(False)),
        }
    )


def diagnose(incidents: DataFrame, responses: DataFrame, allowlist: list[str], text: str = "response") -> DataFrame:
    """Classified incidents with a diagnosis each, a fallback where no valid response exists.

    ``responses`` has one row per incident at most: ``incident_id`` and the text.
    Columns of an earlier diagnosis are replaced.
    """
    answered = incidents.drop(*DIAGNOSIS).join(responses.select("incident_id", text), "incident_id", "left")
    parsed = parse_responses(answered, text)
    ok = F.col("error").isNull()
    known = normalise(parsed, allowlist)
    fallback = {
        "category": F.coalesce("category_hint", F.lit("unknown")),
        # Fixed value: the prefix of a failure.
        "root_cause": F.concat(F.lit("agent diagnose failed: "), F.col("error")),
        "proposed_fix": F.lit(FALLBACK_FIX),
        "confidence": F.lit(0.0),
        "can_auto_remediate": F.lit(False),
    }
    filled = {name: F.when(ok, F.col(name)).otherwise(value) for name, value in fallback.items()}
    return known.select(
        *[c for c in known.columns if c not in fallback and c not in ("error", text)],
        *[value.alias(name) for name, value in filled.items()],
        F.col("error").alias("diagnosis_error"),
    )


def build_reports(decided: DataFrame, generated_at: datetime, keep: list[str] | None = None) -> DataFrame:
    """One JSON report per incident, keys in alphabetical order at every level.

    Columns named in ``keep`` stay beside the report.
    """
    def group(names: list[str], **more: Column) -> Column:
        fields = {n: F.col(n) for n in names} | more
        return F.struct(*[fields[n].alias(n) for n in sorted(fields)])

    errors = F.filter(F.array("diagnosis_error", "action_error"), lambda x: x.isNotNull())
    report = sorted_json(
        {
            "incident_id": F.col("incident_id"),
            "asset_key": F.col("asset_key"),
            "partition_key": F.col("partition_key"),
            "error_type": F.col("error_type"),
            "error_message": F.col("error_message"),
            "category_hint": F.col("category_hint"),
            "diagnosis": group(DIAGNOSIS),
            "proposed_action": group(
                ["description", "next_run", "rollback_data", "action"],
                status=F.col("action_status"),
                reason=F.col("action_reason"),
            ),
            "context_summary": group(
                ["upstream", "downstream", "upstream_count", "downstream_count"],
                recent_run_count=F.size("recent_runs"),
                similar_incident_count=F.size("similar_incidents"),
            ),
            "generated_at": F.lit(generated_at.isoformat()),
            "errors": errors,
        }
    )
    return decided.select(
        "incident_id", F.lit(generated_at.date()).alias("report_date"), report.alias("report"), *(keep or [])
    )


def proposed_fixes(reports: DataFrame, seq: Column, at: Column) -> DataFrame:
    """State changes that stamp each report's fix on its incident."""
    fix = F.get_json_object("report", "$.diagnosis.proposed_fix")
    return reports.select(
        "incident_id",
        seq.alias("seq"),
        F.lit("fix").alias("kind"),
        at.alias("changed_at"),
        F.coalesce(fix, F.lit("")).alias("proposed_fix"),
    )

"""String rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a log line other than an ERROR worth a pattern.
SYMPTOMS = (
    "timed out", "timeout", "waiting on lock", "exceeded", "transient error", "queue full", "oomkilled",
    "queue depth high", "unreachable", "connection refused", "does not exist", "returning 503", "retrying attempt",
)
# Statements that write.
WRITES = ("INSERT", "UPDATE", "DELETE", "UPSERT", "REPLACE", "MERGE", "ALTER")
HTTP_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def blank_to_null(c: Column) -> Column:
    """Blank text counts as missing."""
    return F.when(F.trim(c) != "", c)


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def log_template(body: Column) -> Column:
    """A log body with its varying numbers masked: a leading lock-wait count, the first retry attempt, numbers in parentheses."""
    body = F.regexp_replace(body, r"^[0-9]+(?= transactions waiting)", "<n>")
    body = F.regexp_replace(body, r"(?s)^((?:(?!attempt ).)*attempt )[0-9]+(?=/)", "$1<n>")
    return F.regexp_replace(body, r"\([0-9]+\)", "(<n>)")


def worth_a_pattern(severity: Column, body: Column) -> Column:
    """Blank and INFO lines are out, ERROR lines in, others in if they name a symptom."""
    symptom = F.lower(body).rlike("|".join(SYMPTOMS))
    return (severity != "INFO") & (F.trim(body) != "") & ((severity == "ERROR") | symptom)


def pattern_stability(template: Column, count: Column) -> Column:
    low = F.lower(template)
    return (
        F.when(low.contains("oomkilled") & (count > 1), "recurring-each-cycle")
        .when(low.contains("transient"), "transient-trigger")
        .when(low.contains("queue full") | low.contains("shedding load"), "overload-symptom")
        .otherwise("new-since-incident")
    )


def is_write(statement: Column) -> Column:
    return F.coalesce(F.upper(F.ltrim(statement)).rlike("^(" + "|".join(WRITES) + ")"), F.lit(False))


def shard_number(entity: Column) -> Column:
    return F.regexp_extract(entity, r"-shard-([0-9]+)$", 1)


def service_name(entity: Column) -> Column:
    """The bare service name of an entity id: after the prefix, before a qualifier."""
    return F.when(entity.startswith("service:"), F.substring_index(F.substring(entity, F.lit(9), F.length(entity)), "@", 1))


def method_of(span_name: Column) -> Column:
    """The HTTP verb that starts a span name, else null."""
    first = F.substring_index(F.trim(span_name), " ", 1)
    return F.when(first.isin(*HTTP_VERBS), first)


def signal_of_ref(ref: Column) -> Column:
    """The signal a reference's text points to; the rules hold in this order."""
    return (
        F.when(ref.startswith("aw-"), "anomaly_window")
        .when(ref.startswith("change:"), "change")
        .when(ref.startswith("log-"), "log")
        .when(ref.startswith("lp-"), "log_pattern")
        .when(ref.startswith("prior:"), "prior_incident")
        .when(ref.startswith("telemetry_gap:"), "telemetry_gap")
        .when(ref.startswith("relationship:"), "relationship")
        .when(ref.contains("@"), "metric")
        .when(ref.startswith("trace:") | ref.contains("/") | ref.startswith("t-"), "trace")
    )


def check_signal(label: Column) -> Column:
    """A next-check signal in its canonical spelling."""
    low = F.translate(F.lower(F.trim(label)), "-", "_")
    return F.when(low.isin("code_change", "change"), "change_event").otherwise(low)


def safe_id(c: Column) -> Column:
    """No traversal: letters, digits, dash, underscore and dot, and no two dots in a row."""
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~c.contains("..")

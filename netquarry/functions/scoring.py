"""Severity, keys, titles and the small derived texts of alerts and cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.ip import ip_hex, is_internal
from netquarry.functions.timing import iso_utc

# fixed values
SEVERITY_FORMULA = (
    "clamp(floor(base + 0.5 * (asset_criticality - 3) + 2 * (signal_strength - 0.5) + 0.5), 1, 5)"
)
CASE_FORMULA = "min(5, max(member severities) + (1 if distinct rules >= 3 else 0))"
DEFAULT_CRITICALITY = 3
ESCALATION_RULES = 3
AUTH_PATTERNS = (
    "brute",
    "login fail",
    "authentication fail",
    "auth fail",
    "invalid user",
    "failed password",
    "password guess",
    "privilege gain",
)


def _raw_score(base: Column, signal: Column, criticality: Column) -> Column:
    return base + F.lit(0.5) * (criticality - 3) + F.lit(2.0) * (signal - F.lit(0.5))


def _clamped(raw: Column) -> Column:
    return F.least(F.greatest(F.floor(raw + 0.5), F.lit(1)), F.lit(5)).cast("int")


def severity_score(base: Column, signal: Column, criticality: Column) -> Column:
    """Severity 1–5 with everything needed to derive it again."""
    used = F.coalesce(criticality, F.lit(DEFAULT_CRITICALITY))
    raw = _raw_score(base, signal, used)
    return F.struct(
        _clamped(raw).alias("value"),
        F.struct(
            F.lit(SEVERITY_FORMULA).alias("formula"),
            base.cast("int").alias("base"),
            used.cast("int").alias("asset_criticality"),
            F.when(criticality.isNull(), F.lit("default"))
            .otherwise(F.lit("asset"))
            .alias("asset_criticality_source"),
            F.bround(signal, 4).alias("signal_strength"),
            F.bround(raw, 4).alias("raw"),
            _clamped(raw).alias("result"),
        ).alias("rationale"),
    )


def reproduce(rationale: Column) -> Column:
    """The severity a stored rationale leads to; NULL for an unknown formula. A stored result
    that differs was changed after the fact."""
    return F.when(
        rationale["formula"] == SEVERITY_FORMULA,
        _clamped(
            _raw_score(
                rationale["base"], rationale["signal_strength"], rationale["asset_criticality"]
            )
        ),
    )


def entity_key(entity_type: Column, entity_value: Column) -> Column:
    return F.concat(entity_type, F.lit("="), entity_value)


def dedup_key(rule: Column, entity_type: Column, entity_value: Column, bucket: Column) -> Column:
    return F.concat_ws(":", rule, entity_key(entity_type, entity_value), iso_utc(bucket))


def case_number(prefix: str, opened_at: Column, ordinal: Column) -> Column:
    text = ordinal.cast("string")
    padded = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    return F.concat_ws("-", F.lit(prefix), F.date_format(opened_at, "yyyy"), padded)


def case_title(
    rules: Column, entity: Column, hostname: Column | None = None, max_chars: int | None = None
) -> Column:
    """``rules`` is the sorted array of distinct rule ids."""
    subject = entity if hostname is None else F.coalesce(hostname, entity)
    count = F.size(rules)
    short = F.concat(F.array_join(rules, " and "), F.lit(" on "), subject)
    long = F.concat(
        count.cast("string"), F.lit(" rules on "), subject, F.lit(": "), F.array_join(rules, ", ")
    )
    title = F.when(count <= 2, short).otherwise(long)
    return title if max_chars is None else F.substring(title, 1, max_chars)


def case_severity(member_max: Column, distinct_rules: Column) -> Column:
    bump = F.when(distinct_rules >= ESCALATION_RULES, 1).otherwise(0)
    return F.least(F.lit(5), member_max + bump).cast("int")


def is_auth_failure(
    signature: Column, category: Column, patterns: Sequence[str] = AUTH_PATTERNS
) -> Column:
    text = F.lower(
        F.concat(F.coalesce(signature, F.lit("")), F.lit(" "), F.coalesce(category, F.lit("")))
    )
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.contains(pattern.strip().lower())
    return hit

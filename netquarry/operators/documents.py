"""Admission of stored narrative documents: shape first, then policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.text import clean_keep_newline, strip_python

# fixed values: lengths, vocabulary, forbidden wording
MAX_SUMMARY, MAX_CLAIM, MAX_DETAIL, MAX_URL, MAX_TITLE = 1200, 600, 400, 500, 200
MAX_CLAIMS, MAX_CITATIONS, MAX_ADVICE = 20, 20, 8
ACTIONS = (
    "investigate_host",
    "review_with_asset_owner",
    "check_baseline",
    "collect_more_evidence",
    "correlate_with_other_cases",
    "monitor",
    "document_and_close",
    "escalate",
    "no_action_needed",
)
FORBIDDEN = (
    ("offensive_action", r"(?i)\b(?:hack\s?back|retaliat\w*|counter-?attack|exploit)\b"),
    (
        "active_scanning",
        r"(?i)\b(?:scan|probe|enumerate|fingerprint)\s+(?:the\s+)?"
        r"(?:attacker|source|host|target|remote)\b",
    ),
    (
        "automated_blocking",
        r"(?i)\b(?:automatically|immediately)\s+"
        r"(?:block|drop|null-?route|blackhole|quarantine|isolate)\b",
    ),
    (
        "destructive",
        r"(?i)\b(?:wipe|destroy|delete\s+(?:the\s+)?(?:logs?|evidence)|format\s+the)\b",
    ),
    ("takedown", r"(?i)\b(?:take\s?down|deface|dos|ddos|flood)\b"),
    ("credential_use", r"(?i)\b(?:brute[\s-]?force|crack|password\s+spray)\b"),
)
HTTPS_URL = r"^https://[^\s/@]+(?:/[^\s]*)?$"
_TOP = ("summary", "claims", "recommendations", "citations", "limitations")


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is_text(v: Column, low: int, high: int) -> Column:
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        (F.schema_of_variant(v) == "STRING") & F.length(text).between(low, high), F.lit(False)
    )


def _optional_text(v: Column, high: int) -> Column:
    return v.isNull() | _is_text(v, 0, high)


def _only_keys(v: Column, allowed: tuple[str, ...]) -> Column:
    keys = F.json_object_keys(F.to_json(v))
    return F.coalesce(
        F.schema_of_variant(v).startswith("OBJECT")
        & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) == 0),
        F.lit(False),
    )


def _list(v: Column, cap: int) -> tuple[Column, Column]:
    """Items of an optional array and whether it is one of at most ``cap`` items."""
    items = F.coalesce(
        F.try_variant_get(v, "$", "ARRAY<VARIANT>"), F.expr("CAST(array() AS ARRAY<VARIANT>)")
    )
    shaped = v.isNull() | (F.schema_of_variant(v).startswith("ARRAY") & (F.size(items) <= cap))
    return items, F.coalesce(shaped, F.lit(False))


def _clean(v: Column) -> Column:
    return strip_python(clean_keep_newline(F.try_variant_get(v, "$", "string")))


def _ids(v: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(v, "$", "ARRAY<INT>"), F.expr("CAST(array() AS ARRAY<INT>)")
    )


def admit_documents(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """``(admitted, refused)``. Admitted rows carry ``has_unverified`` (an external claim cites
    nothing); refused rows a ``reason``: ``not_json``, ``schema``, ``dangling_citation`` or
    ``safety:<rule>``."""
    parsed = df.withColumn("_doc", F.try_parse_json(json_col)).withColumns(
        {f"_{n}": _member(F.col("_doc"), n) for n in _TOP}
    )
    claims, claims_ok = _list(F.col("_claims"), MAX_CLAIMS)
    advice, advice_ok = _list(F.col("_recommendations"), MAX_ADVICE)
    cites, cites_ok = _list(F.col("_citations"), MAX_CITATIONS)

    def good_claim(c: Column) -> Column:
        ids, ids_ok = _list(_member(c, "citations"), MAX_CITATIONS)
        return (
            _only_keys(c, ("text", "kind", "citations"))
            & _is_text(_member(c, "text"), 1, MAX_CLAIM)
            & (F.coalesce(_clean(_member(c, "text")), F.lit("")) != "")
            & F.coalesce(
                F.try_variant_get(c, "$.kind", "string").isin("observed", "external"), F.lit(False)
            )
            & ids_ok
            & F.forall(ids, lambda i: F.schema_of_variant(i) == "BIGINT")
        )

    def good_advice(a: Column) -> Column:
        return (
            _only_keys(a, ("action", "detail"))
            & F.coalesce(F.try_variant_get(a, "$.action", "string").isin(*ACTIONS), F.lit(False))
            & _optional_text(_member(a, "detail"), MAX_DETAIL)
        )

    def good_citation(c: Column) -> Column:
        number = F.try_variant_get(c, "$.id", "int")
        return (
            _only_keys(c, ("id", "url", "title"))
            & F.coalesce(
                (F.schema_of_variant(_member(c, "id")) == "BIGINT")
                & number.between(1, MAX_CITATIONS),
                F.lit(False),
            )
            & _is_text(_member(c, "url"), 0, MAX_URL)
            & F.coalesce(
                strip_python(F.try_variant_get(c, "$.url", "string")).rlike(HTTPS_URL), F.lit(False)
            )
            & _is_text(_member(c, "title"), 0, MAX_TITLE)
        )

    staged = parsed.withColumns(
        {
            "_cl": claims,
            "_ad": advice,
            "_ci": cites,
            "_shape": _only_keys(F.col("_doc"), _TOP)
            & _is_text(F.col("_summary"), 1, MAX_SUMMARY)
            & _optional_text(F.col("_limitations"), MAX_SUMMARY)
            & claims_ok
            & advice_ok
            & cites_ok,
        }
    ).withColumn(
        "_items",
        F.forall("_cl", good_claim) & F.forall("_ad", good_advice) & F.forall("_ci", good_citation),
    )
    declared = F.transform("_ci", lambda c: F.try_variant_get(c, "$.id", "int"))
    cited = F.flatten(F.transform("_cl", lambda c: _ids(_member(c, "citations"))))
    passages = F.concat(
        F.array(_clean(F.col("_summary")), F.coalesce(_clean(F.col("_limitations")), F.lit(""))),
        F.transform("_cl", lambda c: _clean(_member(c, "text"))),
        F.transform("_ad", lambda a: F.coalesce(_clean(_member(a, "detail")), F.lit(""))),
    )
    staged = staged.withColumns({"_declared": declared, "_cited": cited, "_passages": passages})
    # the first passage that breaks a rule names the first rule it breaks
    def policy(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(FORBIDDEN):
            out = F.when(p.rlike(pattern), F.lit(f"safety:{name}")).otherwise(out)
        return out

    unsafe = F.get(F.array_compact(F.transform("_passages", policy)), F.lit(0))
    verdict = (
        F.when(F.col("_doc").isNull(), F.lit("not_json"))
        .when(~F.coalesce(F.col("_shape") & F.col("_items"), F.lit(False)), F.lit("schema"))
        .when(F.size(F.array_except("_cited", "_declared")) > 0, F.lit("dangling_citation"))
        .otherwise(unsafe)
    )
    unverified = F.exists(
        "_cl",
        lambda c: (F.try_variant_get(c, "$.kind", "string") == "external")
        & (F.size(_ids(_member(c, "citations"))) == 0),
    )
    judged = staged.withColumn(
        "_v",
        F.explode(
            F.array(F.struct(verdict.alias("reason"), unverified.alias("has_unverified")))
        ),
    )
    admitted = judged.filter(F.col("_v.reason").isNull()).select(
        *df.columns, F.coalesce(F.col("_v.has_unverified"), F.lit(False)).alias("has_unverified")
    )
    refused = judged.filter(F.col("_v.reason").isNotNull()).select(
        *df.columns, F.col("_v.reason").alias("reason")
    )
    return admitted, refused

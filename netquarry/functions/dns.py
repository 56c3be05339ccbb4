"""Domain names as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.binding import let

# fixed values: suffixes whose names look random by design
ALLOWED_SUFFIXES = (
    "cloudfront.net",
    "akamaiedge.net",
    "akamai.net",
    "edgekey.net",
    "amazonaws.com",
    "azureedge.net",
    "azure.com",
    "windows.net",
    "windowsupdate.com",
    "microsoft.com",
    "googleusercontent.com",
    "googleapis.com",
    "gstatic.com",
    "apple.com",
    "icloud.com",
    "cloudflare.net",
    "fastly.net",
    "in-addr.arpa",
    "ip6.arpa",
)
SUSPICIOUS_LABEL_CHARS = 16


def canonical_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.+$", ""))


def _labels(name: Column) -> Column:
    return F.split(canonical_name(name), r"\.")


def base_domain(name: Column) -> Column:
    """The last two labels."""
    return F.substring_index(canonical_name(name), ".", -2)


def subdomain_labels(name: Column) -> Column:
    labels = _labels(name)
    return F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))


def is_allowed(name: Column, suffixes: Sequence[str] = ALLOWED_SUFFIXES) -> Column:
    if not suffixes:
        return F.lit(False)
    choices = "|".join(re.escape(suffix) for suffix in suffixes)
    return canonical_name(name).rlike(rf"(?:^|\.)(?:{choices})$")


def shannon_entropy(text: Column) -> Column:
    """Bits per character; an empty text has none."""

    def bits(whole: Column) -> Column:
        total = F.length(whole).cast("double")

        def add(acc: Column, ch: Column) -> Column:
            count = F.length(whole) - F.length(F.replace(whole, ch, F.lit("")))
            share = count.cast("double") / total
            return acc - share * F.log2(share)

        return F.aggregate(F.array_distinct(F.split(whole, "")), F.lit(0.0), add)

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(text, bits))


def longest_label(name: Column) -> Column:
    """The longest subdomain label, the leftmost of equals; NULL without subdomain."""
    return F.aggregate(
        subdomain_labels(name),
        F.lit(None).cast("string"),
        lambda best, label: F.when(
            best.isNull() | (F.length(label) > F.length(best)), label
        ).otherwise(best),
    )


def looks_random(name: Column, entropy_threshold: float) -> Column:
    return let(
        longest_label(name),
        lambda label: F.when(
            F.length(label) >= SUSPICIOUS_LABEL_CHARS,
            shannon_entropy(label) >= entropy_threshold,
        ).otherwise(F.lit(False)),
    )


def has_long_label(name: Column, chars: int) -> Column:
    return F.exists(subdomain_labels(name), lambda label: F.length(label) >= chars)

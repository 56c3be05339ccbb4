"""Secret-shaped text and addresses inside text, as native patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.binding import let
from netquarry.functions.ip import ip_canonical, is_internal
from netquarry.functions.text import clean_text, strip_python

# fixed values: the denylist. Every quantifier that could backtrack is bounded.
SECRET_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA)[0-9A-Z]{12,}\b"),
    ("private_key_block", r"(?i)-{2,10}\s*BEGIN[A-Z ]*PRIVATE KEY\s*-{2,10}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("bearer_token", r"(?i)\b(?:bearer|token)\s+[A-Za-z0-9._~+/-]{16,}=*"),
    (
        "credential_assignment",
        r"(?i)\b(?:pass(?:word|wd)?|secret|api[_-]?key|access[_-]?key|client[_-]?secret|auth"
        r"|credential)\b\s*[:=]\s*\S{4,}",
    ),
    ("slack_or_github_token", r"\b(?:xox[abprs]-|ghp_|gho_|ghs_|github_pat_)\S{8,}"),
    ("private_key_body", r"\bMII[A-Za-z0-9+/]{40,}={0,2}"),
    ("base64_blob", r"\b[A-Za-z0-9+/]{60,}={0,2}\b"),
)

# fixed values: literals of which a match must hold one, and the least characters of a match. They
# spare texts that cannot match the pattern itself.
_NEEDS = {
    "email": ("@",),
    "aws_access_key_id": ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA", "ANVA"),
    "private_key_block": ("--",),
    "jwt": ("eyJ",),
    "credential_assignment": (":", "="),
    "slack_or_github_token": ("xox", "ghp_", "gho_", "ghs_", "github_pat_"),
    "private_key_body": ("MII",),
}
_SHORTEST = {"bearer_token": 22, "base64_blob": 60}

# fixed value: an address or a host name inside a sentence
NAME_IN_TEXT = (
    r"\b(?:\d{1,3}(?:\.\d{1,3}){3}"
    r"|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){2,7}"
    r"|(?:[a-zA-Z0-9-]{1,63}\.){1,10}[a-zA-Z]{2,24})\b"
)
# fixed value: keys whose values never leave
SENSITIVE_KEY = r"(?i)pass(?:word)?|secret|token|api[_-]?key|authorization|cookie|credential"


def _possible(text: Column, name: str) -> Column:
    if name in _SHORTEST:
        return F.length(text) >= _SHORTEST[name]
    return reduce(Column.__or__, [text.contains(part) for part in _NEEDS[name]])


def _hit(text: Column, name: str, pattern: str) -> Column:
    if name != "base64_blob":
        return _possible(text, name) & text.rlike(pattern)
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _possible(text, name) & F.exists(
        runs, lambda r: r.rlike("[a-z]") & r.rlike("[A-Z]") & r.rlike("[0-9]")
    )


def secret_names(text: Column) -> Column:
    """Names of the patterns that occur, in declaration order. What matched is not returned."""
    return F.array_compact(
        F.array(*[F.when(_hit(text, n, p), F.lit(n)) for n, p in SECRET_PATTERNS])
    )


def free_text(text: Column, limit: int | None = None) -> Column:
    """Text fit to leave: controls gone, ends trimmed, NULL when empty or when any secret pattern
    occurs anywhere in it; cut to ``limit`` characters where one is given."""

    def decide(clean: Column) -> Column:
        short = clean if limit is None else F.substring(clean, 1, limit)
        return F.when((clean != "") & (F.size(secret_names(clean)) == 0), short)

    return let(strip_python(clean_text(text)), decide)


def names_in_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME_IN_TEXT), F.lit(0))


def name_class(value: Column) -> Column:
    """``int``, ``ext`` or ``domain`` of a name in any spelling."""
    return let(
        F.coalesce(ip_canonical(value), F.lit("")),
        lambda ip: F.when(ip == "", F.lit("domain"))
        .when(is_internal(ip), F.lit("int"))
        .otherwise(F.lit("ext")),
    )


def replace_names(text: Column, token: object) -> Column:
    """Every name in the text replaced by ``token(name)``. Built from the pieces between the
    matches, so a name that is part of another is never touched."""
    pieces = F.split(text, NAME_IN_TEXT)
    tokens = F.transform(names_in_text(text), token)
    return F.array_join(
        F.flatten(
            F.zip_with(pieces, tokens, lambda p, t: F.array(p, F.coalesce(t, F.lit(""))))
        ),
        "",
    )


def bounded_detail(
    detail: Column,
    max_keys: int | None = None,
    key_chars: int | None = None,
    value_chars: int | None = None,
) -> Column:
    """A detail map without sensitive keys; where limits are given, at most ``max_keys`` of them
    with keys and values cut to so many characters. Of keys that become equal the first stays."""

    def entries(kept: Column) -> Column:
        short = F.transform(
            kept if max_keys is None else F.slice(kept, 1, max_keys),
            lambda e: F.struct(
                clean_text(e["key"], key_chars).alias("key"),
                clean_text(e["value"], value_chars).alias("value"),
            ),
        )

        def unique(pairs: Column) -> Column:
            keys = F.transform(pairs, lambda e: e["key"])
            return F.map_from_entries(
                F.filter(pairs, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
            )

        return let(short, unique)

    return let(
        F.filter(F.map_entries(detail), lambda e: ~e["key"].rlike(SENSITIVE_KEY)), entries
    )

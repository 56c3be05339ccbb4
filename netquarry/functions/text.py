"""Untrusted text: size and nesting measures, cleaning, strict JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: control characters dropped from sensor text (tab kept) and from notes
# (tab and newline kept)
CONTROL = r"[\x00-\x08\x0a-\x1f\x7f-\x9f]"
CONTROL_KEEP_NEWLINE = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"

# the same characters written as JSON escapes; the look-behind keeps an escaped backslash
_ESCAPED_CONTROL = (
    r"(?<!\\)((?:\\\\)*)\\(?:[bfnr]|u00(?:0[0-8a-fA-F]|1[0-9a-fA-F]|7[fF]|[89][0-9a-fA-F]))"
)


def line_bytes(raw: Column) -> Column:
    return F.octet_length(raw)


def skeleton(raw: Column) -> Column:
    """The line with escapes dropped and every string literal reduced to ``s``. An unfinished
    literal runs to the end of the line. Neither pattern can backtrack."""
    return F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), '"[^"]*+(?:"|$)', "s")


def bracket_fold(skel: Column) -> Column:
    """``{d, m, z}``: final depth, greatest depth, and how often the depth came back to zero."""
    brackets = F.regexp_replace(skel, r"[^\[\]{}]", "")
    zero = F.lit(0)
    start = F.struct(zero.alias("d"), zero.alias("m"), zero.alias("z"))

    def step(acc: Column, ch: Column) -> Column:
        opens = ch.isin("{", "[")
        depth = F.when(opens, acc["d"] + 1).otherwise(F.greatest(acc["d"] - 1, zero))
        return F.struct(
            depth.alias("d"),
            F.greatest(acc["m"], depth).alias("m"),
            (acc["z"] + F.when((~opens) & (depth == 0), 1).otherwise(0)).alias("z"),
        )

    chars = F.when(F.length(brackets) > 0, F.split(brackets, "")).otherwise(
        F.expr("CAST(array() AS ARRAY<STRING>)")
    )
    return F.aggregate(chars, start, step)


def bracket_depth(raw: Column) -> Column:
    """Deepest nesting of braces and brackets outside string literals."""
    return bracket_fold(skeleton(raw))["m"]


def structure_excess(skel: Column, max_keys: int, max_items: int) -> Column:
    """True when an object has more than ``max_keys`` members or an array more than
    ``max_items``. Members are separators plus one, counted per open bracket on a stack; lines
    with too few separators to break either limit skip the fold."""
    marks = F.regexp_replace(skel, r"[^\[\]{},]", "")
    floor = min(max_keys, max_items)
    start = F.struct(
        F.expr("CAST(array() AS ARRAY<STRUCT<k: STRING, n: INT>>)").alias("stack"),
        F.lit(False).alias("over"),
    )

    def step(acc: Column, ch: Column) -> Column:
        stack = acc["stack"]
        depth = F.size(stack)
        top = F.get(stack, depth - 1)
        below = F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        grown = F.struct(top["k"].alias("k"), (top["n"] + 1).cast("int").alias("n"))
        limit = F.when(top["k"] == "{", F.lit(max_keys)).otherwise(F.lit(max_items))
        opened = F.struct(ch.alias("k"), F.lit(1).cast("int").alias("n"))
        comma = (ch == ",") & (depth > 0)
        return F.struct(
            F.when(ch.isin("{", "["), F.concat(stack, F.array(opened)))
            .when(ch.isin("}", "]"), below)
            .when(comma, F.concat(below, F.array(grown)))
            .otherwise(stack)
            .alias("stack"),
            (acc["over"] | F.coalesce(comma & (grown["n"] > limit), F.lit(False))).alias("over"),
        )

    commas = F.length(marks) - F.length(F.replace(marks, F.lit(","), F.lit("")))
    return F.when(commas < floor, F.lit(False)).otherwise(
        F.aggregate(F.split(marks, ""), start, step, lambda acc: acc["over"])
    )


def clean_text(text: Column, max_chars: int | None = None) -> Column:
    clean = F.regexp_replace(text, CONTROL, "")
    return clean if max_chars is None else F.substring(clean, 1, max_chars)


def clean_keep_newline(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_KEEP_NEWLINE, "")


def excerpt(raw: Column, max_chars: int | None = None) -> Column:
    """A refused line, fit to be shown; whole unless a length is given."""
    return clean_text(raw, max_chars)


def clean_json_text(raw: Column) -> Column:
    """Controls removed from the JSON text itself, raw or escaped, so every string and key of
    the parsed record is free of them. Raw C0 characters stay: they make the line unparseable,
    which is the answer wanted."""
    bare = F.regexp_replace(raw, r"[\x7f-\x9f]", "")
    return F.regexp_replace(bare, _ESCAPED_CONTROL, "$1")


def strict_json(raw: Column, fold: Column, skel: Column) -> Column:
    """VARIANT of the line, NULL when it is not one JSON value. Spark's parser stops at the end
    of the first value, so text after it is caught on the skeleton: the depth may return to
    zero once, at the last character. Duplicate keys and NaN give NULL as well."""
    closed = skel.rlike(r"[}\]]\s*$") & (fold["z"] == 1) & (fold["d"] == 0)
    scalar = ~skel.rlike(r"^\s*[{\[]")
    return F.when(closed | scalar, F.try_parse_json(raw))


def strip_python(text: Column) -> Column:
    """Both ends without any whitespace character, not only spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")

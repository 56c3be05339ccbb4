"""Markdown that renders untrusted text as itself and never as markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.binding import let

# fixed values: punctuation CommonMark lets a backslash make literal, control characters
# dropped, and code points that change how text looks without being seen
_PUNCTUATION = r"[!-/:-@\[-`{-~]"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_INVISIBLE_RANGES = (
    (0x200B, 0x200F),
    (0x202A, 0x202E),
    (0x2060, 0x2064),
    (0x2066, 0x2069),
    (0xFEFF, 0xFEFF),
)
_INVISIBLE = [chr(p) for low, high in _INVISIBLE_RANGES for p in range(low, high + 1)]
# what a text must hold for anything of it to be rewritten: more than plain ASCII and line ends
_ODD = r"[^\t\n\r -~]"


def md_visible(text: Column) -> Column:
    """Controls gone; invisible code points written out as ``<U+202E>``. Most texts have neither
    and are only looked through; the code points are one loop, not a call for each in the plan."""
    names = F.array(
        *(F.struct(F.lit(c).alias("c"), F.lit(f"<U+{ord(c):04X}>").alias("n")) for c in _INVISIBLE)
    )
    bare = F.regexp_replace(text, _CONTROL, "")
    written = F.aggregate(names, bare, lambda out, x: F.replace(out, x["c"], x["n"]))
    return F.when(text.rlike(_ODD), written).otherwise(text)


def _escape(visible: Column) -> Column:
    return F.regexp_replace(visible, _PUNCTUATION, r"\\$0")


def md_escape(text: Column) -> Column:
    return _escape(md_visible(text))


def md_one_line(text: Column) -> Column:
    spaced = F.regexp_replace(md_visible(text), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(F.when(text.rlike(r"[^ -~]|  "), spaced).otherwise(text))


def md_cell(text: Column) -> Column:
    """For a table cell or a heading."""
    return _escape(md_one_line(text))


def _longest_ticks(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("(`+)"), 1)
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return F.when(text.contains("`"), longest).otherwise(F.lit(0))


def md_code(text: Column) -> Column:
    """A code span whose fence is longer than any run of backticks inside."""

    def span(flat: Column) -> Column:
        longest = _longest_ticks(flat)
        ticks = F.repeat(F.lit("`"), longest + 1)
        return (
            F.when(flat == "", F.lit("``"))
            .when(longest == 0, F.concat(F.lit("`"), flat, F.lit("`")))
            .otherwise(F.concat_ws(" ", ticks, flat, ticks))
        )

    return let(md_one_line(text), span)


def md_fence(text: Column, language: str = "") -> Column:
    def block(body: Column) -> Column:
        fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), _longest_ticks(body) + 1))
        return F.concat(fence, F.lit(language + "\n"), body, F.lit("\n"), fence)

    return let(md_visible(text), block)


def md_prose(text: Column) -> Column:
    """Many lines: each trimmed and escaped, blank lines kept, so no line can open an indented
    code block."""
    lines = F.split(md_visible(text), r"\r\n|[\n\r\x85  ]")
    shown = F.array_join(
        F.transform(lines, lambda x: _escape(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), "\n"
    )
    body = F.regexp_replace(shown, r"^\n+|\n+$", "")
    return F.when(body == "", F.lit("_(empty)_")).otherwise(body)


def md_when(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss'Z'"), F.lit("—"))

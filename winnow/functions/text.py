"""Text columns: lines, whitespace, line-numbered rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and line breaks as the scanned language's runtime sees them. Java's own classes are
# narrower (\s) or lack the information separators ((?U)\s), so both sets are spelled out. The
# intersection lets most characters fail on two tests instead of one test per range.
_LOW = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_HIGH = (
    r"\x85\xa0\x{1680}-\x{3000}"
    r"&&[^\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}]"
)
WS = f"[ {_LOW}{_HIGH}]"
NOT_WS = f"(?!{WS})[\\s\\S]"
# Runs that normalizing changes; a single blank stays. Most characters fail on the first class.
WS_TO_REPLACE = f"{WS}(?:{WS}++|(?<! ))"
# One class first and then what may follow it: most characters fail on a single test.
LINE_BREAKS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}](?:(?<=\r)\n)?+"

# A rendered line number at the start of a line; only \n starts a line here.
LINE_PREFIX = rf"(?md)^{WS}*\p{{Nd}}+{WS}*\|{WS}?"


def no_strings() -> Column:
    """An empty list of strings."""
    return F.array().cast("array<string>")


def normalize_ws(text: Column) -> Column:
    """Runs of whitespace become one blank, both ends are stripped."""
    return F.trim(F.regexp_replace(text, WS_TO_REPLACE, " "))


def is_blank(text: Column) -> Column:
    """Nothing is left of the text when whitespace is normalized; looks no further than the first other character."""
    return ~text.rlike(NOT_WS)


def normalize_texts(text: Column) -> Column:
    """:func:`normalize_ws` for whole texts; several times as fast, but not for values inside a lambda.

    Both whitespaces are the runtime's own. A function inside this one reaches the workers by value, so they need no package.
    """

    def joined(value: str | None) -> str | None:
        return None if value is None else " ".join(value.split())

    return F.udf(joined, "string", useArrow=True)(F.make_valid_utf8(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    A lambda of a higher-order function computes whatever it captures anew for each element, and
    the optimizer moves single-use columns into lambdas; a lambda's own variable stays a value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_lines(text: Column) -> Column:
    """The lines of a text; a final line break does not open another line."""
    return let(
        F.split(text, LINE_BREAKS),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (1-based, inclusive) as an array; shorter past the end."""
    return F.slice(lines, start, F.greatest(end - start + 1, F.lit(0)))


def numbered(lines: Column, start: Column) -> Column:
    """Lines with their right-aligned numbers in front: `` 9 | code``."""
    shown = let(lines, lambda given: F.when(F.size(given) == 0, F.array(F.lit(""))).otherwise(given))
    sized = let(
        F.struct(shown.alias("lines"), start.alias("start")),
        lambda s: F.struct(
            s["lines"].alias("lines"),
            s["start"].alias("start"),
            F.length((s["start"] + F.size(s["lines"]) - 1).cast("string")).alias("width"),
        ),
    )
    return let(
        sized,
        lambda s: F.array_join(
            F.transform(
                s["lines"],
                lambda line, i: F.concat(
                    F.lpad((s["start"] + i).cast("string"), s["width"], F.lit(" ")), F.lit(" | "), line
                ),
            ),
            "\n",
        ),
    )


def strip_line_prefixes(text: Column) -> Column:
    """Undo :func:`numbered`."""
    return F.regexp_replace(text, LINE_PREFIX, "")


def fingerprint(
    prompt_version: Column, rule_id: Column, file_path: Column, matched_code: Column, function_source: Column
) -> Column:
    """Content key of a finding: 16 hex digits that survive whitespace-only edits."""
    key = F.concat_ws(
        "|",
        prompt_version,
        rule_id,
        file_path,
        normalize_texts(matched_code),
        normalize_texts(F.coalesce(function_source, F.lit(""))),
    )
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)

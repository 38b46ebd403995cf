"""Text to lines, blanks, trimming, head."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s is ASCII-only without (?U). \z, not $: $ also matches before a final CR.
TRAILING_SPACE = r"(?U)(?<!\s)\s++\z"
LEADING_SPACE = r"(?U)\A\s++"
EDGE_SPACE = r"(?U)\A\s++|(?<!\s)\s++\z"
VISIBLE = r"(?U)\S"
SPACE = r"(?U)\s"


def drop_cr(line: Column) -> Column:
    """Remove one trailing carriage return."""
    return F.when(line.endswith("\r"), F.left(line, F.char_length(line) - 1)).otherwise(line)


def split_lines(text: Column) -> Column:
    """Lines of a text: split on LF, one trailing CR removed, final empty piece dropped."""
    parts = F.split(text, "\n", -1)
    kept = F.when(
        text.endswith("\n") | (text == ""), F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)
    return F.when(text.contains("\r"), F.transform(kept, drop_cr)).otherwise(kept)


def trim_end(line: Column) -> Column:
    """Right-trim of all Unicode white space; the last character decides whether to look."""
    spaced = F.substring(line, -1, 1).rlike(SPACE)
    return F.when(spaced, F.regexp_replace(line, TRAILING_SPACE, "")).otherwise(line)


def trim_start(line: Column) -> Column:
    return F.regexp_replace(line, LEADING_SPACE, "")


def trim_both(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(VISIBLE)


def head_lines(text: Column, n: int) -> Column:
    """First ``n`` lines joined by LF."""
    return F.array_join(F.slice(split_lines(text), 1, n), "\n")


def octets(col: Column) -> Column:
    return F.octet_length(col).cast("bigint")

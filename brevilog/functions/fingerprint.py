"""Structural fingerprint: variable tokens of a line become placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token shapes in order of priority. One alternation, one pass from
# left to right, so a token inside an earlier match is never looked at again. The path
# shape is possessive: same matches, but no recursion on very long paths.
TOKEN_SHAPES = [
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b",
    r"\b0x[0-9a-fA-F]{4,}\b",
    r"[A-Za-z]:\\[^\s]+",
    r"(?:/[^\s/:]++){2,}+",
    r"\b\d{2,}\b",
]
TOKEN = "(?U)" + "|".join(TOKEN_SHAPES)

# No shape can match in a line without a digit, a slash, a backslash or a dash.
CANDIDATE = r"(?U)[\d/\\-]"


def _placeholder(hit: Column) -> Column:
    # The shapes are disjoint, so the matched text alone tells which one it was.
    return (
        F.when(hit.startswith("/"), "<PATH>")
        .when(F.substring(hit, 2, 2) == ":\\", "<PATH>")
        .when(hit.startswith("0x"), "<HEX>")
        .when(F.substring(hit, 5, 1) == "-", "<ISO8601>")
        .when(hit.contains("."), "<IP>")
        .when(hit.contains("-"), "<UUID>")
        .otherwise("<NUM>")
    )


# Every token is set between two control characters; the marked pieces are then named one
# shape at a time, most telling first.
OPEN, CLOSE = "\x01", "\x02"
MARKED = "(?U)(" + "|".join(TOKEN_SHAPES) + ")"
NAMING = [
    (r"\x01(?:/|[A-Za-z]:\\)[^\x02]*+\x02", "<PATH>"),
    (r"\x010x[^\x02]*+\x02", "<HEX>"),
    (r"\x01[^\x02]{4}-[^\x02]*+\x02", "<ISO8601>"),
    (r"\x01[^\x02.-]*+\x02", "<NUM>"),
    (r"\x01[^\x02.]*+\x02", "<UUID>"),
    (r"\x01[^\x02]*+\x02", "<IP>"),
]


def _by_marks(line: Column) -> Column:
    """Seven cheap passes; for lines without the two marks of their own."""
    out = F.regexp_replace(line, MARKED, f"{OPEN}$1{CLOSE}")
    for pattern, name in NAMING:
        out = F.regexp_replace(out, pattern, name)
    return out


def _by_pieces(line: Column) -> Column:
    """Split and extract with the same pattern, then weave placeholders back in."""
    between = F.split(line, TOKEN, -1)
    hits = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))
    marks = F.transform(hits, _placeholder)
    woven = F.zip_with(between, marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(woven, "")


def fingerprint(line: Column) -> Column:
    """Fingerprint of one line, without a UDF."""
    own_marks = line.contains(OPEN) | line.contains(CLOSE)
    return (
        F.when(~line.rlike(CANDIDATE), line).when(own_marks, _by_pieces(line))
        .otherwise(_by_marks(line))
    )

"""Terminal escapes: three stripping rules and token-class counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complete or cut-off sequences. Parameters may be any of 0x20-0x3F, so malformed CSI
# sequences are swallowed up to their final byte too.
CSI = r"\x1b\[[\x20-\x3f]*[\x40-\x7e]?"
OSC = r"\x1b\][^\x07\x18\x1a\x1b]*\x07?"
STRING = r"\x1b[PX^_][^\x18\x1a\x1b]*"
ESC = r"\x1b(?![\[\]PX^_])[\x20-\x2f]*[\x30-\x7e]?"
C0 = r"[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f]"
ANY_ESCAPE = "|".join([CSI, OSC, STRING, ESC, C0])

SGR = r"\x1b\[[\x20-\x3f]*m"
CSI_OTHER = r"\x1b\[[\x20-\x3f]*[\x40-\x6c\x6e-\x7e]"
ESC_DONE = r"\x1b(?![\[\]PX^_])[\x20-\x2f]*[\x30-\x7e]"

# Log replay: an escape swallows everything up to its first closing byte.
REPLAY = r"\x1b[^\x07\x40-\x5a\x5c\x5e-\x7e]*(?:[\x07\x40-\x5a\x5c\x5e-\x7e]|\z)"

# Log viewer: three passes.
VIEWER_PASSES = [
    r"\x1b\[[0-9;]*[a-zA-Z]",
    r"\x1b\][^\x1b]*\x1b\\",
    r"\x1b\][^\x07]*\x07",
]


def strip_ansi(text: Column) -> Column:
    """Printable text plus TAB, LF and CR; every escape and other control removed."""
    return F.when(
        text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), F.regexp_replace(text, ANY_ESCAPE, "")
    ).otherwise(text)


def strip_replay(text: Column) -> Column:
    """Stripping rule of log replay (a title set by OSC leaks after its first letter)."""
    return F.regexp_replace(text, REPLAY, "")


def strip_viewer(text: Column) -> Column:
    for pattern in VIEWER_PASSES:
        text = F.regexp_replace(text, pattern, "")
    return text


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _total(parts: Column, size=F.octet_length) -> Column:
    return F.aggregate(
        parts, F.lit(0).cast("bigint"), lambda acc, x: acc + size(x).cast("bigint")
    )


def _rebuilt_csi(hit: Column) -> Column:
    """Sequence as it is replayed: private markers dropped, empty parameters are 0."""
    bare = F.regexp_replace(hit, r"[\x20-\x2f<-?]", "")
    filled = F.regexp_replace(bare, r"(?<=[\[;:])(?=[;:\x40-\x7e])", "0")
    return F.regexp_replace(filled, r"(?<![0-9])0+(?=[0-9])", "")


def token_counts(text: Column) -> Column:
    """Events and bytes by token class.

    SGR is a CSI ending in ``m``; every other CSI, OSC, two-byte escape and control is
    Control; payload bytes of device strings are one Control each. Text is what lies
    between, one event per non-empty piece.
    """
    pieces = F.filter(F.split(text, ANY_ESCAPE, -1), lambda p: p != "")
    sgr = F.transform(_hits(text, SGR), _rebuilt_csi)
    csi = F.transform(_hits(text, CSI_OTHER), _rebuilt_csi)
    osc = _hits(text, OSC)
    # An OSC is replayed with a two-byte terminator whatever ended it.
    osc_bytes = _total(osc, lambda h: F.octet_length(F.rtrim(h, F.lit("\x07"))) + 2)
    esc = _hits(text, ESC_DONE)
    esc_bytes = F.size(esc).cast("bigint") * 2
    strings = _hits(text, STRING)
    payload = _total(strings, lambda h: F.octet_length(F.regexp_replace(
        h, r"\A\x1b[PX^_](?:[\x20-\x3f]*[\x40-\x7e])?", "")))
    # Controls inside OSC and device strings belong to those; take them out first.
    plain = F.regexp_replace(text, f"{OSC}|{STRING}", "")
    c0 = F.regexp_count(plain, F.lit(C0)).cast("bigint")
    return F.struct(
        F.size(pieces).cast("bigint").alias("text_events"),
        _total(pieces).alias("text_bytes"),
        F.size(sgr).cast("bigint").alias("sgr_events"),
        _total(sgr).alias("sgr_bytes"),
        (F.size(csi) + F.size(osc) + F.size(esc) + payload + c0).cast("bigint")
        .alias("control_events"),
        (_total(csi) + osc_bytes + esc_bytes + payload + c0).alias("control_bytes"),
    )

"""Report columns: tiers, badges, labels, number formats, intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_both

# Fixed values.
FAILURE_INTENT = "debug:test-failure"
DIFF_INTENT = "commit:generate"


def parse_intent(raw: Column, trim: bool = True) -> Column:
    """Trimmed intent, null when empty; unknown values stay as they are."""
    return F.nullif(trim_both(raw), F.lit("")) if trim else raw


def intent_kind(intent: Column) -> Column:
    return (
        F.when(intent.isNull(), "none")
        .when(intent == FAILURE_INTENT, "failure")
        .when(intent == DIFF_INTENT, "diff")
        .otherwise("custom")
    )


def savings_tier(pct: Column) -> Column:
    return F.when(pct >= 60, "high").when(pct >= 20, "medium").otherwise("low")


def efficiency_badge(pct: Column) -> Column:
    return (
        F.when(pct >= 80, "Superior").when(pct >= 60, "Strong").when(pct >= 40, "Solid")
        .when(pct >= 20, "Moderate").otherwise("Low")
    )


def efficiency_class(pct: Column) -> Column:
    return F.when(pct >= 60, "high").when(pct >= 30, "mid").otherwise("low")


def exit_label(code: Column) -> Column:
    return F.when(code == 0, "OK").otherwise(F.concat(F.lit("ERR:"), code.cast("string")))


def argv_from_json(text: Column) -> Column:
    """Parsed argv; text that is not a JSON array of strings becomes its only element."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array(F.coalesce(text, F.lit(""))))


def argv_head(argv: Column) -> Column:
    return F.coalesce(F.try_element_at(argv, F.lit(1)), F.lit("unknown"))


def command_line(argv: Column) -> Column:
    return F.array_join(argv, " ")


def history_label(argv: Column, program: str) -> Column:
    """Program and arguments; above 40 bytes the first 37 characters and an ellipsis."""
    full = F.concat(F.lit(program + " "), command_line(argv))
    return F.when(F.octet_length(full) > 40, F.concat(F.left(full, F.lit(37)), F.lit("..."))).otherwise(full)


def list_label(argv: Column) -> Column:
    """At most 64 characters, for lists of runs; an empty command shows as unknown."""
    rest = F.slice(argv, 2, F.greatest(F.size(argv) - 1, F.lit(0)))
    # A missing or empty first argument both show as unknown.
    head = F.coalesce(F.nullif(F.try_element_at(argv, F.lit(1)), F.lit("")), F.lit("unknown"))
    return F.left(trim_both(F.concat(head, F.lit(" "), F.array_join(rest, " "))), F.lit(64))


def table_label(argv: Column) -> Column:
    return F.array_join(F.slice(argv, 1, 4), " ")


def iso_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of a zone-less timestamp."""
    return F.replace(F.left(ts.cast("string"), F.lit(19)), F.lit(" "), F.lit("T"))


def short_time(ts: Column) -> Column:
    """Month to minute of the ISO text."""
    return F.substring(iso_text(ts), 6, 11)


def day_text(ts: Column) -> Column:
    return F.left(ts.cast("string"), F.lit(10))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed1(x: Column) -> Column:
    """One decimal, exact binary value, ties to even."""
    # With a pattern, format_number goes through DecimalFormat, which rounds the exact
    # binary value; printf-style formatting rounds the shortest decimal instead.
    return F.call_function("format_number", x, F.lit("0.0"))


def fixed1_up(x: Column) -> Column:
    """One decimal, exact binary value, ties away from zero."""
    tie = (x * 4) % 2 == 1
    return F.when(tie, fixed1((F.floor(x * 10) + 1) / 10)).otherwise(fixed1(x))


def duration_text(ms: Column) -> Column:
    whole = lambda c: F.floor(c).cast("string")
    minutes, hours = 60_000, 3_600_000
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < minutes, F.concat(fixed1(ms / 1000.0), F.lit("s")))
        .when(ms < hours,
              F.concat(whole(ms / minutes), F.lit("m "), whole((ms % minutes) / 1000), F.lit("s")))
        .otherwise(F.concat(whole(ms / hours), F.lit("h "), whole((ms % hours) / minutes), F.lit("m")))
    )


def size_text(n_bytes: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    scaled = lambda unit, name: F.concat(fixed1(n_bytes / unit), F.lit(name))
    return (
        F.when(n_bytes < kb, F.concat(n_bytes.cast("string"), F.lit(" B")))
        .when(n_bytes < mb, scaled(kb, " KB"))
        .when(n_bytes < gb, scaled(mb, " MB"))
        .otherwise(scaled(gb, " GB"))
    )

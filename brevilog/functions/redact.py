"""Secret redaction with per-pattern hit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Applied in this order, each on the result of the one before.
PATTERNS = [
    ("ssh-key", r"-----BEGIN\s*(?:RSA|DSA|EC|OPENSSH|PRIVATE)\s*KEY-----"),
    ("github-token", r"\bgh[poasu]_[A-Za-z0-9_]{36,40}\b"),
    ("openai-key", r"\bsk-[A-Za-z0-9]{32,48}\b"),
    ("aws-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("jwt-token", r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b"),
    ("generic-secret",
     r"(?i)(pass|secret|token|key|password|apikey|api_key|auth_token)\s*[:=]\s*['\"]?\S{8,}"),
    ("bearer-token", r"(?i)bearer\s+[A-Za-z0-9._-]{16,}"),
]
# What a text must hold for the pattern to have any chance; cheap to look for.
HINTS = {
    "ssh-key": lambda t: t.contains("-----BEGIN"),
    "github-token": lambda t: t.rlike(r"gh[poasu]_"),
    "openai-key": lambda t: t.contains("sk-"),
    "aws-key": lambda t: t.contains("AKIA"),
    "jwt-token": lambda t: t.contains("eyJ"),
    "generic-secret": lambda t: t.rlike(r"[:=]"),
    "bearer-token": lambda t: t.rlike(r"[bB][eE][aA][rR][eE][rR]"),
}
ON_VALUES = ["1", "on", "true", "yes"]


def hits_column(name: str) -> str:
    return "hits_" + name.replace("-", "_")


def redaction_on(setting: Column) -> Column:
    """Gate for a per-run setting; anything but the known words leaves the text alone."""
    return F.coalesce(setting.isin(ON_VALUES), F.lit(False))


def redact(df: DataFrame, text: str = "text", mode: str | Column = "on") -> DataFrame:
    """Add ``redacted``, ``hits_<pattern>`` and ``hits`` to ``df``.

    Hits of a step are counted on the text that step sees. A step that left the text
    as it was had no hits (every label differs from what it replaces in the first
    character), so clean texts cost one regex pass per pattern.
    """
    gate = redaction_on(F.lit(mode) if isinstance(mode, str) else mode)
    steps = df.withColumn("_t0", F.col(text))
    for i, (name, pattern) in enumerate(PATTERNS):
        before = F.col(f"_t{i}")
        steps = steps.withColumn(
            f"_t{i + 1}",
            F.when(gate & HINTS[name](before), F.regexp_replace(before, "(?U)" + pattern, f"[REDACTED: {name}]"))
            .otherwise(before),
        )
    counts = [
        F.when(F.col(f"_t{i + 1}") == F.col(f"_t{i}"), F.lit(0).cast("bigint"))
        .otherwise(F.regexp_count(F.col(f"_t{i}"), F.lit("(?U)" + pattern)).cast("bigint"))
        .alias(hits_column(name))
        for i, (name, pattern) in enumerate(PATTERNS)
    ]
    hits = [F.col(hits_column(name)) for name, _ in PATTERNS]
    return steps.select(
        *[F.col(c) for c in df.columns], F.col(f"_t{len(PATTERNS)}").alias("redacted"), *counts
    ).withColumn("hits", sum(hits[1:], hits[0]))

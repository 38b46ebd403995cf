"""Corpus-wide questions: log templates and the archetype census."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..functions.tokens import savings_pct, tokens_from_bytes, tokens_saved


def templates(lines: DataFrame) -> DataFrame:
    """Each fingerprint with its lines, the runs it occurs in and one sample.

    Lines are counted per (template, run) first, with map-side partial aggregation, so
    a template that makes up a third of the corpus reaches the last step as one row per
    run, combined once more before the shuffle on the template.
    """
    per_run = lines.groupBy(fingerprint(F.col("line")).alias("template"), "run_id").agg(
        F.count("*").alias("n"), F.min(F.struct("line_no", "line")).alias("first"))
    return per_run.groupBy("template").agg(
        F.sum("n").alias("lines"), F.count("*").alias("runs"),
        F.min(F.struct("run_id", "first")).alias("seen"),
    ).select(
        "template", "lines", "runs", F.col("seen.run_id").alias("first_run"),
        F.col("seen.first.line_no").alias("first_line_no"), F.col("seen.first.line").alias("sample"))


def top_templates(lines: DataFrame, n: int = 20) -> DataFrame:
    return templates(lines).orderBy(F.desc("lines"), "template").limit(n)


def census(runs: DataFrame) -> DataFrame:
    """Runs, lines, bytes and tokens by archetype, from classified runs."""
    return runs.groupBy("archetype").agg(
        F.count("*").alias("runs"), F.sum("n_lines").alias("lines"), F.sum("n_bytes").alias("bytes"),
        F.sum(tokens_from_bytes(F.col("n_bytes"))).alias("tokens"))


def savings_by_archetype(reports: DataFrame) -> DataFrame:
    """Token savings by archetype, from compaction reports."""
    tin, tout = F.col("tokens_in"), F.col("tokens_out")
    return (
        reports.groupBy("archetype")
        .agg(F.count("*").alias("runs"), F.sum("tokens_in").alias("tokens_in"),
             F.sum("tokens_out").alias("tokens_out"))
        .withColumn("tokens_saved", tokens_saved(tin, tout))
        .withColumn("savings_pct", F.round(savings_pct(tin, tout), 6))
    )

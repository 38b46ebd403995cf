"""Distilling in the lines form: paragraphs or windows of lines of runs of any length, each compacted on its own.

A section becomes a run of its own whose ``run_id`` is the struct ``(doc, section_no)``; numbers are those of
``texts.sections``. A document or a paragraph may hold a third of the table, so sections are numbered and trimmed
with one summary row for each block (and section), as in ``blocks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drop_cr, is_blank, trim_end, trim_start
from ..functions.tokens import savings_pct, tokens_saved
from ..params import DEFAULTS, Params
from ..session import cut_lineage
from .blocks import block_of_line, div
from .compact import Compacted, compact_lines, report

PARTS = ["run_id", "section_no", "block"]


def _paragraphs(rows: DataFrame) -> DataFrame:
    """Visible lines with the number of their paragraph: how often blank lines ended before them.

    A single blank line at the very start ends nothing, as there is no line end before it.
    """
    key, at, blank = ["run_id", "block"], F.col("line_no"), F.col("blank")
    order = Window.partitionBy(*key).orderBy("line_no")
    starts = lambda before: (~blank & F.coalesce(before, F.lit(False)) & (at >= 3)).cast("bigint")
    rows = rows.withColumn("starts", starts(F.lag("blank").over(order)))
    # What a block adds is known but for its first line, which depends on the last line of the block before.
    blocks = rows.groupBy(*key).agg(
        F.sum("starts").alias("inner"), F.min("line_no").alias("line_no"),
        F.min_by("blank", "line_no").alias("blank"), F.max_by("blank", "line_no").alias("last_blank"))
    run = Window.partitionBy("run_id").orderBy("block")
    blocks = blocks.withColumn("edge", starts(F.lag("last_blank").over(run)))
    blocks = blocks.select(*key, (F.sum(F.col("inner") + F.col("edge")).over(run) - F.col("inner")).alias("before"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("running", F.sum("starts").over(upto)).filter(~blank).join(blocks, key)
    return numbered.select(*key, "line_no", "line", "blank", (F.col("running") + F.col("before")).alias("section_no"))


def section_lines(lines: DataFrame, window_lines: int = 0, p: Params = DEFAULTS) -> DataFrame:
    """``lines(run_id, line_no, line)`` of all sections: paragraphs, or chunks of ``window_lines`` lines.

    Sections are trimmed on both sides; blank ones are dropped but keep their number. Lines of a run are numbered from 1. A CR
    that is left at a line's end goes to the flag ``cr``, as texts that are split again lose it.
    """
    at, blank = F.col("line_no"), F.col("blank")
    rows = lines.select("run_id", block_of_line(at, p.block_lines).alias("block"), "line_no", "line",
                        is_blank(F.col("line")).alias("blank"))
    rows = rows.withColumn("section_no", div(at - 1, window_lines)) if window_lines > 0 else _paragraphs(rows)
    # First and last visible line of each section, from one row for each block it touches.
    seen = F.when(~blank, at)
    whole = Window.partitionBy("run_id", "section_no")
    edges = rows.groupBy(*PARTS).agg(F.min(seen).alias("first"), F.max(seen).alias("last")).select(
        *PARTS, F.min("first").over(whole).alias("first"), F.max("last").over(whole).alias("last"))
    kept = rows.join(edges, PARTS).filter(at.between(F.col("first"), F.col("last")))
    line = F.when(at == F.col("first"), trim_start(F.col("line"))).otherwise(F.col("line"))
    line = F.when(at == F.col("last"), trim_end(line)).otherwise(line)
    return kept.select(
        F.struct(F.col("run_id").alias("doc"), "section_no").alias("run_id"), (at - F.col("first") + 1).alias("line_no"),
        drop_cr(line).alias("line"), line.endswith("\r").alias("cr"), (at < F.col("last")).alias("lf"))


def distill_lines(lines: DataFrame, window_lines: int = 0, p: Params = DEFAULTS, intent: Column | None = None) -> Compacted:
    """Each section of a lines table compacted on its own; ``intent`` is the same for all of them.

    Sections are written once, since every branch of the compaction reads them.
    """
    found = cut_lineage(section_lines(lines, window_lines, p))
    asked = None if intent is None else found.select("run_id").distinct().withColumn("intent", intent)
    return compact_lines(found, p, intent=asked)


def distill_lines_report(done: Compacted) -> DataFrame:
    """Tokens of a document, summed over its sections."""
    tin, tout = F.col("tokens_in"), F.col("tokens_out")
    return (
        report(done).groupBy(F.col("run_id.doc").alias("doc_id"))
        .agg(F.count("*").alias("sections"), F.sum("tokens_in").alias("tokens_in"),
             F.sum("tokens_out").alias("tokens_out"))
        .withColumn("tokens_saved", tokens_saved(tin, tout))
        .withColumn("savings_pct", savings_pct(tin, tout))
    )

"""Intent bias on compacted lines: failure focus and diff stripping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drop_cr
from ..params import DEFAULTS, Params
from .blocks import block_of_line, per_block

# A line containing any of these is a failure line.
FAILURE_MARKS = [
    "FAIL", "FAILED", "error:", "Error:", "ERROR ", "panic", "panicked",
    "AssertionError", "assertion failed", "Traceback", "stack backtrace",
    "test result: FAILED", "FAIL[", "✗ ",
]
GAP_LINE = "..."


def is_failure(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.contains(m) for m in FAILURE_MARKS])


def diff_keep(line: Column) -> Column:
    header = line.startswith("+++") | line.startswith("---") | line.startswith("diff ")
    body = line.startswith("+") | line.startswith("-") | line.startswith("@@")
    return header | ~body


def strip_diff(lines: DataFrame) -> DataFrame:
    return lines.filter(diff_keep(F.col("line")))


def focus_failures(numbered: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Failure lines with their context; runs without any stay as they are.

    ``numbered`` has dense ``out_no`` per run. Rows near a block edge are also sent to
    the neighbouring block, so each block sees its full context on both sides and a run
    of any length is spread over many tasks. The first line dropped after kept lines
    becomes a gap line.
    """
    size, reach = p.block_lines, p.context_lines + 1
    at = F.col("out_no")
    home = block_of_line(at, size)
    # Every block in reach, however small blocks are; those after the last one have no facts to join.
    spread = F.sequence(block_of_line(F.greatest(at - reach, F.lit(1)), size), block_of_line(at + reach, size))
    flagged = numbered.withColumn("hit", is_failure(F.col("line")))
    runs = flagged.groupBy("run_id").agg(
        F.max("hit").alias("any_hit"), F.max("out_no").alias("n_out"))
    facts = (
        per_block(runs, "n_out", size).withColumnRenamed("block", "part").drop("n_out")
    )
    rows = flagged.withColumn("home", home).withColumn("part", F.explode(spread))
    order = Window.partitionBy("run_id", "part").orderBy("out_no")
    near = order.rowsBetween(-p.context_lines, p.context_lines)
    return (
        rows.join(facts, ["run_id", "part"])
        .withColumn("keep", F.max("hit").over(near))
        .withColumn("after_kept", F.coalesce(F.lag("keep").over(order), F.lit(False)))
        .filter((F.col("home") == F.col("part"))
                & (~F.col("any_hit") | F.col("keep") | F.col("after_kept")))
        .withColumn("line", F.when(~F.col("any_hit"), F.col("line"))
                    .when(F.col("keep"), drop_cr(F.col("line"))).otherwise(GAP_LINE))
        .drop("home", "part", "hit", "any_hit", "keep", "after_kept")
    )

"""Blocks: the unit of work that keeps long runs spread over tasks.

A run is an ordered list of lines, and one run may hold a third of a table. So nothing
here is partitioned by ``run_id`` alone. Lines are keyed by ``(run_id, block)``, where a
block is a fixed number of consecutive lines, and whatever flows from one block into the
next (running counts, last values) is computed on one small summary row per block and
joined back ("carried"). For runs of a single block the carry tables are empty, and AQE
drops their joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

COMBINE = {
    "sum": F.sum,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def div(a: Column, b: int) -> Column:
    """Integer division of a non-negative whole number."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def block_of_line(line_no: Column, size: int) -> Column:
    return div(line_no - 1, size)


def block_of_ord(ord_: Column, size: int) -> Column:
    """Block of an output position; line ``k`` sits at ``2k``, a note before it at ``2k-1``."""
    return div(ord_ - 1, 2 * size)


def per_block(runs: DataFrame, n: str, size: int) -> DataFrame:
    """One copy of a per-run row for each block of the run.

    Joining lines to per-run facts on ``(run_id, block)`` instead of ``run_id`` bounds
    the rows per join key by the block size.
    """
    last = F.greatest(block_of_line(F.col(n), size), F.lit(0).cast("bigint"))
    return runs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def carries(rows: DataFrame, summaries: dict[str, tuple[Column, str]]) -> DataFrame:
    """Value of each summary over all earlier blocks of the run.

    ``summaries`` maps a name to an aggregate over one block and the way blocks are
    combined. The first block of a run has nothing before it and gets no row.
    """
    before = (
        Window.partitionBy("run_id").orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = rows.groupBy("run_id", "block").agg(
        *[agg.alias(name) for name, (agg, _) in summaries.items()]
    )
    return blocks.select(
        "run_id", "block",
        *[COMBINE[how](F.col(name)).over(before).alias(name)
          for name, (_, how) in summaries.items()],
    ).filter(F.col("block") > 0)


def number_within(
    rows: DataFrame, keys: list[str], bucket: list[str], order: list[Column], name: str
) -> DataFrame:
    """Dense 1-based position of each row within its key, in the given order.

    ``bucket`` columns must rise with the order; they cut a hot key into pieces that are
    numbered independently and shifted by the sizes of the pieces before them.
    """
    before = (
        Window.partitionBy(*keys).orderBy(*bucket)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = rows.groupBy(*keys, *bucket).agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        *keys, *bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*keys, *bucket).orderBy(*order)
    return (
        rows.join(offsets, keys + bucket)
        .withColumn(name, F.col("_offset") + F.row_number().over(within))
        .drop("_offset")
    )


# Keys of up to so many rows are numbered by one sort each; no task holds more of one key.
WHOLE_KEY_ROWS = 262_144


def number_by_size(
    rows: DataFrame, keys: list[str], bucket: list[str], order: list[Column], name: str, most: int = WHOLE_KEY_ROWS,
    last: str | None = None,
) -> DataFrame:
    """As ``number_within``, which costs a join on pieces that may be as many as the rows; only keys of more than ``most``
    rows are cut into pieces. ``order`` is the whole order, ``bucket`` included. ``last`` names a column that tells the last
    row of each key. Runs a job that counts the rows of keys."""
    large = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > most))
    whole = Window.partitionBy(*keys).orderBy(*order)

    def number(part: DataFrame) -> DataFrame:
        part = part.withColumn(name, F.row_number().over(whole).cast("bigint"))
        return part.withColumn(last, F.lead(F.lit(True)).over(whole).isNull()) if last else part
    if large.isEmpty():
        return number(rows)
    # At most one row for each ``most`` rows of the table.
    large = F.broadcast(large)
    cut = number_within(rows.join(large, keys), keys, bucket, order, name)
    cut = cut.withColumn(last, F.col(name) == F.col("_rows")) if last else cut
    return number(rows.join(large, keys, "left_anti")).unionByName(cut.drop("_rows"))


def number_by_range(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """As ``number_within`` where no bucket column bounds the rows: tasks get ranges of rows cut at sampled places.

    No task holds more than its range, whatever part of the table has one key or even one place in the order; equal
    rows are told apart by where they were read. Ranges are written once, so that sizes and numbers see the same ones.
    """
    read = rows.withColumn("_read", F.monotonically_increasing_id())
    order = [*order, F.col("_read")]
    cut = cut_lineage(read.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    return number_within(cut, keys, ["_range"], order, name).drop("_range", "_read")

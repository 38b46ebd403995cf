"""The lines table and filters on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_cr, is_blank, split_lines


def lines_of_texts(texts: DataFrame, run_id: str, text: str = "text", exact: bool = False) -> DataFrame:
    """``lines(run_id, line_no, line)`` of a table with one text per row.

    ``exact`` adds what the lines of a text leave out: whether a line lost a CR (``cr``) and has a line end (``lf``).
    """
    body = F.col(text)
    if not exact:
        return texts.select(
            F.col(run_id).alias("run_id"), F.posexplode(split_lines(body)).alias("pos", "line")
        ).select("run_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    parts = F.split(body, "\n", -1)
    parts = F.when(body.endswith("\n") | (body == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = texts.select(F.col(run_id).alias("run_id"), F.size(parts).alias("n"), body.endswith("\n").alias("ends"),
                        F.posexplode(parts).alias("pos", "line"))
    return rows.select("run_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), drop_cr(F.col("line")).alias("line"),
                       F.col("line").endswith("\r").alias("cr"), (F.col("ends") | (F.col("pos") < F.col("n") - 1)).alias("lf"))


def head(lines: DataFrame, n: int) -> DataFrame:
    return lines.filter(F.col("line_no") <= n)


def drop_blank_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.filter(~is_blank(F.col(text)))

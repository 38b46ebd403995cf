"""Report rows ready for JSON and CSV sinks, and the sinks themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.tokens import tokens_saved

# Field names and order of the reports.
SUMMARY_FIELDS = {
    "total_commands": "total_commands", "input_tokens": "tokens_in", "output_tokens": "tokens_out",
    "tokens_saved": "tokens_saved", "savings_pct": "savings_pct", "total_exec_ms": "total_exec_ms",
    "avg_exec_ms": "avg_exec_ms",
}
HISTORY_FIELDS = ["id", "started_at", "argv", "savings_pct", "tokens_saved", "tokens_in",
                  "tokens_out", "wall_ms", "exit_code", "log_path"]
DAILY_FIELDS = ["day", "runs", "tokens_in", "tokens_out", "tokens_saved"]
CSV_FIELDS = ["started_at", "argv", "savings_pct", "tokens_in", "tokens_out", "tokens_saved",
              "wall_ms", "exit_code"]


def _json(df: DataFrame, fields: list[Column], options: dict[str, str] | None = None) -> DataFrame:
    return df.select(F.to_json(F.struct(*fields), options or {}).alias("json"))


def summary_json(summary: DataFrame) -> DataFrame:
    return _json(summary, [F.col(c).alias(name) for name, c in SUMMARY_FIELDS.items()])


def history_json(history: DataFrame) -> DataFrame:
    shown = history.withColumn("started_at", F.concat(L.iso_text(F.col("started_at")), F.lit("Z")))
    return _json(shown, [F.col(c) for c in HISTORY_FIELDS])


def daily_json(daily: DataFrame) -> DataFrame:
    return _json(daily.withColumn("day", F.col("day").cast("string")), [F.col(c) for c in DAILY_FIELDS])


def csv_rows(history: DataFrame) -> DataFrame:
    """Columns of the CSV export; quoting is left to the writer."""
    saved = tokens_saved(F.col("tokens_in"), F.col("tokens_out"))
    return history.select(
        F.concat(L.iso_text(F.col("started_at")), F.lit("Z")).alias("started_at"),
        L.command_line(F.col("argv")).alias("argv"), L.fixed1_up(F.col("savings_pct")).alias("savings_pct"),
        "tokens_in", "tokens_out", saved.alias("tokens_saved"), "wall_ms", "exit_code")


def write_csv(history: DataFrame, path: str) -> None:
    csv_rows(history).select(*CSV_FIELDS).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def footers(runs: DataFrame, tool: str = "run", version: str = "1") -> DataFrame:
    """One JSON line per run: tokens, savings, archetype and how to get the full log."""
    saved = tokens_saved(F.col("tokens_in"), F.col("tokens_out"))
    body = F.struct(
        F.lit(version).alias("version"), "tokens_in", "tokens_out", saved.alias("tokens_saved"),
        L.fixed1(F.col("savings_pct")).alias("savings_pct"), "archetype", "log_path",
        F.struct(F.lit("cat").alias("command"), F.array("log_path").alias("args")).alias("recover_full_output"))
    return runs.select("id", F.to_json(F.struct(body.alias(tool))).alias("json"))

"""Raw logs: one file per run, named by the run id."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ansi import strip_replay
from ..functions.text import drop_cr, head_lines, is_blank
from ..operators.texts import compact_texts
from ..params import DEFAULTS, Params
from ..session import scratch_path


def _stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"\.log\z", "")


def scan_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``(run_id, path, length, modified_at, data)`` of every ``*.log`` file.

    ``data`` is only read when it is selected.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    return files.select(
        _stem(F.col("path")).alias("run_id"), "path", "length",
        F.col("modificationTime").alias("modified_at"), F.col("content").alias("data"))


class LogLines(NamedTuple):
    """``lines(run_id, line_no, line, cr, lf)`` and ``runs(run_id, path, n_lines, n_bytes, ends_newline)``."""

    lines: DataFrame
    runs: DataFrame


def scan_lines(spark: SparkSession, folder: str, glob: str = "*.log", run_id: Column | None = None, p: Params = DEFAULTS) -> LogLines:
    """Numbered lines of every log file, of any size: a file is read in splits by many tasks, and no row holds a file.

    Line ends are LF; a line over a split edge belongs to the split it begins in. Lines are written once to the shared
    folder with their split and their place in the scan. Numbers follow from the lines of the splits before, summed
    over one small row for each split. ``run_id`` is made from the column ``path``; the name of the file by default.
    Bytes that are not UTF-8 become the replacement character. A file without bytes has no row: readers skip it.
    """
    meta = F.col("_metadata")
    text = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").option("recursiveFileLookup", "true").text(folder)
    raw = text.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("split"), meta["file_size"].alias("size"),
                      F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    held = scratch_path(spark, "log-lines")
    raw.write.parquet(held)
    stored = spark.read.schema(raw.schema).parquet(held)

    octets = F.octet_length("raw").cast("bigint")
    splits = stored.groupBy("path", "split", "size").agg(
        F.count("*").alias("n"), F.sum(octets + 1).alias("bytes"), F.min("at").alias("first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")))
    files = splits.groupBy("path", "size").agg(F.sum("n").alias("n_lines"), F.sum("bytes").alias("bytes"))
    # Each line was counted with a line end; a file that has one byte less lacks the last one.
    files = files.withColumn("ends_newline", F.col("bytes") <= F.col("size"))
    numbered = splits.join(files.select("path", "n_lines", "ends_newline"), "path").select(
        "path", "split", "first", "before", "n_lines", "ends_newline")
    # Exactly counted before it is broadcast; beyond the limit the join is left to the optimizer.
    if numbered.count() <= p.broadcast_rows:
        numbered = F.broadcast(numbered)
    name = run_id if run_id is not None else _stem(F.col("path"))
    line, line_no = F.make_valid_utf8("raw"), F.col("before") + (F.col("at") - F.col("first")) + 1
    lines = stored.drop("size").join(numbered, ["path", "split"]).select(
        name.alias("run_id"), line_no.alias("line_no"), drop_cr(line).alias("line"), line.endswith("\r").alias("cr"),
        (F.col("ends_newline") | (line_no < F.col("n_lines"))).alias("lf"))
    runs = files.select(name.alias("run_id"), "path", "n_lines", F.col("size").alias("n_bytes"), "ends_newline")
    return LogLines(lines, runs)


def read_texts(spark: SparkSession, *paths: str, head: int | None = None) -> DataFrame:
    """Whole text files, one row each, without blank ones; optionally their first lines."""
    texts = spark.read.text(list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if head is not None:
        texts = texts.withColumn("text", head_lines(F.col("text"), head))
    return texts.filter(~is_blank(F.col("text")))


def decoded(data: Column) -> Column:
    """Text of raw bytes; invalid UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def replay_each(logs: DataFrame, prefix: str, intent: Column | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Every log whose id starts with ``prefix``, stripped and compacted, with the outcome."""
    found = logs.filter(F.col("run_id").startswith(prefix))
    n = found.agg(F.count("*")).scalar()
    texts = found.select("run_id", strip_replay(decoded(F.col("data"))).alias("text"))
    return compact_texts(texts, "text", intent, p).withColumn("outcome", F.when(n == 1, "one").otherwise("many"))


def replay(logs: DataFrame, prefix: str, intent: Column | None = None, p: Params = DEFAULTS) -> DataFrame:
    """The one log whose id starts with ``prefix``, stripped and compacted; of several a listing by id.

    ``outcome`` is ``one`` or ``many``. Of the listed logs (run_id and length) nothing is read but that, if
    ``logs`` comes from ``scan_logs``.
    """
    found = logs.filter(F.col("run_id").startswith(prefix))
    if "length" not in logs.columns:
        found = found.withColumn("length", F.octet_length("data").cast("bigint"))
    if len(found.select("run_id").limit(2).collect()) > 1:
        nothing = {c: F.lit(None).cast("string") for c in ("archetype", "compacted")}
        tokens = {c: F.lit(None).cast("bigint") for c in ("tokens_in", "tokens_out", "tokens_saved")}
        return found.select("run_id", "length").withColumns(
            {**nothing, **tokens, "savings_pct": F.lit(None).cast("double"), "outcome": F.lit("many")}).orderBy("run_id")
    texts = found.select("run_id", "length", strip_replay(decoded(F.col("data"))).alias("text"))
    return compact_texts(texts, "text", intent, p).drop("text").withColumn("outcome", F.lit("one"))


def compact_files(spark: SparkSession, *paths: str, head: int | None = None,
                  intent: Column | None = None, p: Params = DEFAULTS) -> DataFrame:
    return compact_texts(read_texts(spark, *paths, head=head), "text", intent, p)

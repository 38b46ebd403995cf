"""Streams: raw-log sink, compaction, live metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.tokens import savings_pct, tokens_saved
from ..operators.classify import PASSTHROUGH
from ..operators.compact import compact_lines, report, tty_bypass
from ..params import DEFAULTS, Params
from ..schema import RUNS
from ..session import stash
from ..sources.journal import append_new_runs
from .chunks import ChunkCompactor, lines_of_chunks
from .windows import WindowCompactor


def read_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    """Stream over a folder of Parquet files; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_raw_sink(chunks: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep every chunk as it came. Together with a compaction started on the same source
    this is the two-way split of a live stream."""
    return _start(chunks.writeStream.format("parquet").option("path", out), checkpoint, once)


def raw_totals(chunks: DataFrame) -> DataFrame:
    """Bytes and chunks stored per run."""
    return chunks.groupBy("run_id").agg(
        F.count("*").alias("chunks"), F.sum(F.octet_length("data").cast("bigint")).alias("raw_bytes"))


def start_window_compaction(
    lines: DataFrame, out_dir: str, checkpoint: str, p: Params = DEFAULTS, window: int | None = None,
    once: bool = False, expiry_ms: int | None = 3_600_000, lock: bool = False,
) -> StreamingQuery:
    """Compacted windows of a stream of numbered lines, under ``out_dir/windows``; see ``WindowCompactor``."""
    target = WindowCompactor(out_dir, p, window, None if once else expiry_ms, lock)
    return _start(lines.writeStream.foreachBatch(target), checkpoint, once)


def start_chunk_compaction(
    chunks: DataFrame, out_dir: str, checkpoint: str, p: Params = DEFAULTS, window: int | None = None, once: bool = False,
    lock: bool = False, runs: DataFrame | None = None, journal: str | None = None,
) -> StreamingQuery:
    """Compacted windows of a stream of raw chunks, under ``out_dir/windows``.

    With ``runs`` (see ``finished_runs``) and the path of a ``journal`` every run that ends is written there once.
    """
    def record(_: int, ended: DataFrame) -> None:
        append_new_runs(finished_runs(ended, runs, p), journal)

    target = ChunkCompactor(out_dir, p, window, lock, record if journal else None)
    return _start(chunks.writeStream.foreachBatch(target), checkpoint, once)


def finished_totals(chunks: DataFrame, intent: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Journal totals of finished runs: one batch pass over each whole text, line ends as they came. Runs jobs."""
    raw = raw_totals(chunks).select("run_id", "raw_bytes")
    # Written once: the classifier, the census and each way of compaction read them.
    lines = stash(lines_of_chunks(chunks, exact=True), "finished-lines")
    totals = report(compact_lines(lines, p, intent=intent))
    # A run whose output holds no line has no row there.
    zero = F.lit(0).cast("bigint")
    counts = {c: F.coalesce(c, zero) for c in ("n_lines", "n_bytes", "out_lines", "out_bytes", "tokens_in", "tokens_out", "tokens_saved")}
    return raw.join(totals, "run_id", "left").withColumns({
        **counts, "savings_pct": F.coalesce("savings_pct", F.lit(0.0)), "archetype": F.coalesce("archetype", F.lit(PASSTHROUGH))})


def finished_runs(chunks: DataFrame, runs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Journal rows of runs from all of their chunks and from what is known of them without their output.

    ``runs`` has id, argv, cwd, started_at, finished_at, exit_code, log_path, intent and is_tty. Runs at a terminal
    are never compacted: their tokens are those of the raw bytes. Chunks of runs that ``runs`` does not know give no row.
    """
    asked = runs.filter(F.col("intent").isNotNull()).select(F.col("id").alias("run_id"), "intent")
    totals = finished_totals(chunks, asked.join(chunks.select("run_id").distinct(), "run_id", "left_semi"), p)
    rows = runs.join(totals.withColumnRenamed("run_id", "id"), "id")
    wall = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at"))
    return tty_bypass(rows.withColumn("wall_ms", F.greatest(wall, F.lit(0)).cast("bigint"))).select(*RUNS.fieldNames())


def live_daily(runs: DataFrame) -> DataFrame:
    """Runs and tokens per day, kept up to date (complete mode)."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return runs.groupBy(F.col("started_at").cast("date").alias("day")).agg(
        F.count("*").alias("runs"), zero("tokens_in"), zero("tokens_out"))


def live_summary(runs: DataFrame) -> DataFrame:
    """Totals of the journal, kept up to date (complete mode)."""
    tin, tout = F.col("tokens_in"), F.col("tokens_out")
    return runs.groupBy().agg(
        F.count("*").alias("total_commands"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    ).withColumns({"tokens_saved": tokens_saved(tin, tout), "savings_pct": savings_pct(tin, tout)})


def start_live_table(metrics: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Replace the table at ``out`` with each new state of the metrics."""
    def replace(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(out)

    return _start(metrics.writeStream.outputMode("complete").foreachBatch(replace), checkpoint, once)

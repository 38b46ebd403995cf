"""Live windows over numbered lines.

Lines carry their number, so the window of a line is known without looking at any other
line, and a busy run is spread over as many keys as it has windows. Compaction itself is the
row form, so it adds nothing to the state.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import div, number_within
from ..operators.texts import compact_texts
from ..params import DEFAULTS, Params
from .state import BucketedState

HELD = "run_id string, line_no bigint, line string, is_last boolean, seen_ms bigint"
FINISHED = "run_id string, window_no bigint, upto boolean"
# Finished windows per piece of the prefix sum.
WINDOW_SPAN = 65_536


def window_of(lines: DataFrame, window: int) -> DataFrame:
    """``lines`` with ``window_no``, counted from 0."""
    return lines.withColumn("window_no", div(F.col("line_no") - 1, window))


def compact_windows(windows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Compact each window by itself, classified anew each time.

    A run that ends before it has enough lines to be classified is passed on unchanged
    and has no archetype; only its first window can be that short.
    """
    ready = ~((F.col("window_no") == 0) & (F.col("n_lines") < p.window_min_lines))
    return (
        compact_texts(windows, "text", p=p)
        .withColumn("archetype", F.when(ready, F.col("archetype")))
        .withColumn("compacted", F.when(ready, F.col("compacted")).otherwise(F.col("text")))
        .select("run_id", "window_no", "n_lines", "archetype", "compacted")
    )


def lock_windows(
    windows: DataFrame, known: DataFrame, p: Params = DEFAULTS, step: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> tuple[DataFrame, DataFrame]:
    """Windows compacted with the archetype of their run's first window, and the choice of each run.

    ``known(run_id, locked)`` holds what was chosen before; a run whose first window is among ``windows`` gets its choice from
    it. A run without a choice (its first window was too short) is passed on unchanged. ``step`` may write the choices, which
    both results start from.
    """
    first = compact_windows(windows.filter(F.col("window_no") == 0), p).select("run_id", F.col("archetype").alias("chosen"))
    choices = step(known.join(first, "run_id", "full_outer").select("run_id", F.coalesce("locked", "chosen").alias("locked")))
    joined = windows.join(choices, "run_id", "left")
    done = compact_texts(joined, "text", p=p, archetype=F.col("locked"))
    out = done.select(
        "run_id", "window_no", "n_lines", F.col("locked").alias("archetype"),
        F.when(F.col("locked").isNull(), F.col("text")).otherwise(F.col("compacted")).alias("compacted"))
    return out, choices


def lock_archetypes(windows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Windows compacted with the archetype of their run's first window.

    A batch over finished windows, for use where the first choice is to be kept.
    """
    nothing = windows.select("run_id", F.lit(None).cast("string").alias("locked")).limit(0)
    return lock_windows(windows, nothing, p)[0]


def batch_windows(lines: DataFrame, p: Params = DEFAULTS, window: int | None = None) -> DataFrame:
    """The same windows for a lines table at rest: one bounded group per window."""
    size = max(window or p.window_lines, p.window_min_lines)
    grouped = window_of(lines, size).groupBy("run_id", "window_no").agg(
        F.count("*").cast("int").alias("n_lines"),
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    return grouped.select("run_id", "window_no", "n_lines", F.array_join(
        F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


class WindowCompactor:
    """``foreachBatch`` target for a stream of ``(run_id, line_no, line, is_last)``.

    A window is finished when it is full, when the last line of the run is known and all lines of the window up to it are
    there, or when nothing came for it for ``expiry_ms``. ``out_dir/windows/batch=N`` gets the compacted windows. The
    lines of unfinished windows are kept in ``out_dir/state``, and so is which windows of a run are finished: up to
    which number all are, and those beyond. Lines of finished windows are dropped: a line that comes again changes
    nothing, and one that comes after its window expired is counted in ``out_dir/late`` (see ``late``). With ``lock`` the
    archetype of a run's first window is kept for its later ones, which wait for it.

    All steps are joins and aggregates; expiry is looked at when a batch comes.
    """

    def __init__(self, out_dir: str, p: Params = DEFAULTS, window: int | None = None, expiry_ms: int | None = None,
                 lock: bool = False, buckets: int = 64):
        self.out_dir, self.p, self.expiry_ms, self.lock = out_dir, p, expiry_ms, lock
        self.size = max(window or p.window_lines, p.window_min_lines)
        self.state = BucketedState(f"{out_dir}/state", {
            "held": HELD, "finished": FINISHED, "locks": "run_id string, locked string",
            "expired": "run_id string, line_no bigint"}, buckets)

    def windows_dir(self) -> str:
        return f"{self.out_dir}/windows"

    def late(self, spark: SparkSession) -> DataFrame:
        """``(run_id, n_late)``: lines that came after their window had expired without them."""
        rows = spark.read.schema("run_id string, n_late bigint, batch bigint").parquet(f"{self.out_dir}/late")
        return rows.groupBy("run_id").agg(F.sum("n_late").alias("n_late"))

    def _compacted_finished(self, finished: DataFrame) -> DataFrame:
        """Finished windows without gap from 0 become one row: the last of them (``upto``)."""
        first = finished.filter("upto").groupBy("run_id").agg((F.max("window_no") + 1).alias("next"))
        more = finished.filter("NOT upto").distinct().join(first, "run_id", "left")
        zero = F.lit(0).cast("bigint")
        ranked = number_within(more.filter(F.col("window_no") >= F.coalesce("next", zero)).withColumn("span", div(F.col("window_no"), WINDOW_SPAN)),
                               ["run_id"], ["span"], [F.col("window_no")], "rank")
        joined = ranked.withColumn("upto", F.col("window_no") == F.coalesce("next", zero) + F.col("rank") - 1)
        upto = first.select("run_id", (F.col("next") - 1).alias("window_no")).unionByName(
            joined.filter("upto").select("run_id", "window_no")).groupBy("run_id").agg(F.max("window_no").alias("window_no"))
        return upto.withColumn("upto", F.lit(True)).unionByName(joined.filter("NOT upto").select("run_id", "window_no", "upto"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, int(time.time() * 1000)
        step = lambda rows, name: self.state.step(rows, name, batch_id)
        batch = step(batch.select("run_id", "line_no", "line", F.coalesce("is_last", F.lit(False)).alias("is_last")), "batch")
        versions = self.state.versions(spark, batch_id)
        # With an expiry every bucket may hold windows that are due.
        touched = sorted({*self.state.touched(batch), *(versions if self.expiry_ms is not None else ())})
        finished = self.state.read(spark, "finished", versions, touched)
        held = self.state.read(spark, "held", versions, touched)
        expired = self.state.read(spark, "expired", versions, touched)

        fresh = window_of(batch.withColumn("seen_ms", F.lit(now)), self.size)
        upto = finished.filter("upto").select("run_id", F.col("window_no").alias("done_upto"))
        beyond = finished.filter("NOT upto").select("run_id", "window_no", F.lit(True).alias("is_done"))
        # Per-run rows are spread over windows before lines meet them.
        keys = fresh.select("run_id", "window_no").distinct().join(upto, "run_id", "left").join(beyond, ["run_id", "window_no"], "left")
        done = F.coalesce("is_done", F.lit(False)) | F.coalesce(F.col("window_no") <= F.col("done_upto"), F.lit(False))
        fresh = step(fresh.join(keys.select("run_id", "window_no", done.alias("done")), ["run_id", "window_no"]), "fresh")
        # Of lines for finished windows, those that expired windows went without are late.
        late = fresh.filter("done").select("run_id", "line_no").distinct().join(expired, ["run_id", "line_no"], "left_semi")
        late.groupBy("run_id").agg(F.count("*").alias("n_late")).write.mode("overwrite").parquet(f"{self.out_dir}/late/batch={batch_id}")

        lines = fresh.filter("NOT done").drop("done", "window_no").unionByName(held)
        lines = lines.groupBy("run_id", "line_no").agg(
            F.min("line").alias("line"), F.max("is_last").alias("is_last"), F.max("seen_ms").alias("seen_ms"))
        lines = step(window_of(lines, self.size), "lines")
        windows = lines.groupBy("run_id", "window_no").agg(
            F.count("*").cast("int").alias("n_lines"), F.max("seen_ms").alias("seen_ms"),
            F.max(F.when(F.col("is_last"), F.col("line_no"))).alias("last_no"),
            F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
        expected = F.coalesce(F.col("last_no") - F.col("window_no") * self.size, F.lit(self.size))
        whole = F.col("n_lines") >= expected
        due = (F.col("seen_ms") < now - self.expiry_ms) if self.expiry_ms is not None else F.lit(False)
        ready = windows.withColumn("whole", whole).filter(whole | due)
        known = self.state.read(spark, "locks", versions, touched)
        if self.lock:
            # Later windows wait for the first one.
            begun = known.select("run_id").unionByName(ready.filter("window_no = 0").select("run_id")).distinct()
            ready = ready.join(begun, "run_id", "left_semi")
        ready = step(ready, "ready")
        texts = ready.select("run_id", "window_no", "n_lines", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
        out, locks = lock_windows(texts, known, self.p, lambda rows: step(rows, "locks")) if self.lock else (compact_windows(texts, self.p), known)
        out.write.mode("overwrite").parquet(f"{self.windows_dir()}/batch={batch_id}")

        # What an expired window went without: its other numbers.
        at = F.col("window_no") * self.size
        missing = ready.filter("NOT whole").select("run_id", F.explode(F.array_except(
            F.sequence(at + 1, at + expected), F.transform("rows", lambda r: r["line_no"]))).alias("line_no"))
        gone = ready.select("run_id", "window_no")
        self.state.write(batch_id, versions, touched, {
            "held": lines.join(gone, ["run_id", "window_no"], "left_anti").select("run_id", "line_no", "line", "is_last", "seen_ms"),
            "finished": self._compacted_finished(finished.unionByName(gone.withColumn("upto", F.lit(False)))),
            "locks": locks,
            "expired": expired.join(late, ["run_id", "line_no"], "left_anti").unionByName(missing)})

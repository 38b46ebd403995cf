"""Live compaction of raw byte chunks.

A chunk may end anywhere: inside a line, a character or an escape sequence. Each micro-batch is a small
batch job over whole tables: escapes are stripped with the state each chunk is entered in, chunks are cut at
line ends, numbered with prefix sums, pieces of cut lines are put together by line number, and lines are grouped
into windows. No step gathers a run in one task, so one very busy run is processed by all executors.

Chunks may come in any order. Of each run the chunks up to the first gap are processed; those above it wait
in the state until the gap is filled. What is unfinished at the end of a batch (waiting chunks, the escape
state, the open line and the lines of the open window of each run) is kept in ``state.BucketedState``; so are
the tables between the steps of a batch. All writes replace the folder of their batch, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import drop_cr
from ..operators.blocks import carries, div, number_within
from ..operators.texts import compact_texts
from ..params import DEFAULTS, Params
from .escapes import GROUND, resumed, state_after, strip_resumed, with_entry_state
from .state import BucketedState
from .windows import compact_windows, lock_windows

BYTES = "ISO-8859-1"  # one character per byte, so bytes survive string functions
CHUNK_SPAN = 4096     # chunks per piece of the prefix sum
RUNS = ("run_id string, n_done bigint, next_chunk bigint, escape int, raw_bytes bigint, ended boolean, "
        "locked string, held array<string>, tail binary")
WAITING = "run_id string, chunk_no bigint, data binary, is_last boolean"


def _span(chunk_no: Column) -> Column:
    return div(chunk_no, CHUNK_SPAN)


def _newlines_before(chunks: DataFrame, start: DataFrame | None) -> DataFrame:
    """Add ``before``: line ends of the run in earlier chunks, on top of its ``start``."""
    chunks = chunks.withColumn("span", _span(F.col("chunk_no")))
    earlier = (
        Window.partitionBy("run_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = chunks.groupBy("run_id", "span").agg(F.sum("ends").alias("s"))
    zero = F.lit(0).cast("bigint")
    base = F.coalesce(F.sum("s").over(earlier), zero)
    if start is not None:
        spans = spans.join(start.select("run_id", "n_done"), "run_id", "left")
        base = base + F.coalesce("n_done", zero)
    spans = spans.select("run_id", "span", base.alias("base"))
    inside = (
        Window.partitionBy("run_id", "span").orderBy("chunk_no")
        .rowsBetween(Window.unboundedPreceding, -1))
    return (
        chunks.join(spans, ["run_id", "span"])
        .withColumn("before", F.col("base") + F.coalesce(F.sum("ends").over(inside), zero))
        .drop("span", "base")
    )


def clean_chunks(chunks: DataFrame, start: Column | None = None) -> DataFrame:
    """``(run_id, chunk_no, data, escape)``: chunks without escapes, and the escape state each of them leaves.

    ``start`` is the state before the first chunk of each run.
    """
    texts = chunks.withColumn("text", F.decode(F.col("data"), BYTES))
    placed = with_entry_state(texts, _span(F.col("chunk_no")), start)
    entry, text = F.col("entry"), F.col("text")
    return placed.select("run_id", "chunk_no", F.encode(strip_resumed(entry, text), BYTES).alias("data"),
                         state_after(resumed(entry, text)).alias("escape"))


def _placed(chunks: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Clean chunks cut at line ends, each with the number of line ends before it."""
    text = F.decode(F.col("data"), BYTES)
    cut = chunks.select("run_id", "chunk_no", F.split(text, "\n", -1).alias("pieces"))
    return _newlines_before(cut.withColumn("ends", (F.size("pieces") - 1).cast("bigint")), start)


def _joined(placed: DataFrame) -> DataFrame:
    """Lines from placed chunks; ``seg`` is the segment of the chunk that closes a line."""
    pieces = placed.select(
        "run_id", "chunk_no", "before", "ends", "seg", F.posexplode("pieces").alias("k", "piece"))
    pieces = pieces.withColumn("idx", F.col("before") + F.col("k"))
    closes = F.col("k") < F.col("ends")
    inner = (F.col("k") > 0) & closes
    whole = pieces.filter(inner).select("run_id", "idx", "seg", "piece", F.lit(False).alias("is_open"))
    # Only the first and last piece of a chunk can belong to a line that was cut.
    cut_lines = (
        pieces.filter(~inner).groupBy("run_id", "idx")
        .agg(F.sort_array(F.collect_list(F.struct("chunk_no", "piece"))).alias("parts"),
             F.max(closes).alias("closed"), F.max("seg").alias("seg"))
        .select("run_id", "idx", "seg",
                F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("piece"),
                (~F.col("closed")).alias("is_open"))
    )
    return whole.unionByName(cut_lines).select(
        "run_id", "idx", "seg", F.encode(F.col("piece"), BYTES).alias("data"), "is_open")


def assemble_lines(chunks: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``(run_id, idx, data, is_open)``: the lines of a set of clean chunks.

    ``chunks`` holds ``(run_id, chunk_no, data)``; lines are counted from 0, or from
    ``start(run_id, n_done)``. The last line of a run has no line end yet and is marked
    open; it may be empty.
    """
    placed = _placed(chunks, start).withColumn("seg", F.lit(0).cast("bigint"))
    return _joined(placed).drop("seg")


def _text(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def line_text(data: Column) -> Column:
    """Text of a clean line's bytes, trailing CR dropped."""
    return drop_cr(_text(data))


def lines_of_chunks(chunks: DataFrame, exact: bool = False) -> DataFrame:
    """``(run_id, line_no, line)`` of finished runs, from all of their chunks: the lines of the stripped text.

    ``exact`` adds whether a line lost a CR (``cr``) and has a line end (``lf``).
    """
    rows = assemble_lines(clean_chunks(chunks)).filter(~(F.col("is_open") & (F.octet_length("data") == 0)))
    flags = [_text(F.col("data")).endswith("\r").alias("cr"), (~F.col("is_open")).alias("lf")] if exact else []
    return rows.select("run_id", (F.col("idx") + 1).alias("line_no"), line_text(F.col("data")).alias("line"), *flags)


def newline_windows(chunks: DataFrame, p: Params = DEFAULTS, window: int | None = None) -> DataFrame:
    """Windows of finished runs that also end wherever a chunk ends with a line end.

    Here the windows depend on how the stream was cut into chunks, which is why no
    stream uses this by default. Windows before the first one with enough lines to
    classify a run are passed on unchanged.
    """
    size = max(window or p.window_lines, p.window_min_lines)
    placed = _placed(clean_chunks(chunks)).withColumn("block", _span(F.col("chunk_no")))
    # A segment begins after the last earlier chunk that ended with a line end.
    flush = F.when((F.element_at("pieces", -1) == "") & (F.col("ends") > 0), F.col("before") + F.col("ends"))
    placed = placed.join(carries(placed, {"seg_before": (F.max(flush), "max")}), ["run_id", "block"], "left")
    earlier = (
        Window.partitionBy("run_id", "block").orderBy("chunk_no")
        .rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("bigint")
    placed = placed.withColumn("seg", F.greatest(F.max(flush).over(earlier), F.col("seg_before"), zero))
    lines = _joined(placed).filter(~(F.col("is_open") & (F.octet_length("data") == 0)))

    first = F.col("seg") + div(F.col("idx") - F.col("seg"), size) * size
    windows = (
        lines.select("run_id", "idx", line_text(F.col("data")).alias("line"), first.alias("first"))
        .groupBy("run_id", "first").agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("rows"))
        .select("run_id", "first", F.size("rows").alias("n_lines"),
                F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
    )
    windows = windows.withColumn("block", div(F.col("first"), p.block_lines))
    windows = number_within(windows, ["run_id"], ["block"], [F.col("first")], "window_no").withColumn(
        "window_no", F.col("window_no") - 1)
    enough = F.col("n_lines") >= p.window_min_lines
    upto = (
        Window.partitionBy("run_id", "block").orderBy("first")
        .rowsBetween(Window.unboundedPreceding, 0))
    windows = windows.join(carries(windows, {"ready_before": (F.max(enough), "max")}), ["run_id", "block"], "left")
    ready = F.max(enough).over(upto) | F.coalesce("ready_before", F.lit(False))
    done = compact_texts(windows.withColumn("ready", ready), "text", p=p)
    return done.select(
        "run_id", "window_no", "n_lines", F.when(F.col("ready"), F.col("archetype")).alias("archetype"),
        F.when(F.col("ready"), F.col("compacted")).otherwise(F.col("text")).alias("compacted"))


class ChunkCompactor:
    """``foreachBatch`` target for a stream of ``(run_id, chunk_no, data, is_last)``.

    ``out_dir/windows/batch=N`` gets the compacted windows, ``out_dir/state`` what is unfinished. Chunks may come
    in any order and more than once; finished runs are remembered (a small row each), so chunks of theirs that
    come again are dropped, however late. ``waiting`` lists the runs with chunks above a gap.

    With ``lock`` the archetype of a run's first window is kept for its later ones. With ``on_finished`` the
    chunks are stored under ``out_dir/raw``, and after each batch the function gets the batch id and all chunks
    of the runs that ended in it.
    """

    def __init__(self, out_dir: str, p: Params = DEFAULTS, window: int | None = None, lock: bool = False,
                 on_finished: Callable[[int, DataFrame], None] | None = None, buckets: int = 64):
        self.out_dir, self.p, self.lock, self.on_finished = out_dir, p, lock, on_finished
        self.size = max(window or p.window_lines, p.window_min_lines)
        self.state = BucketedState(f"{out_dir}/state", {"runs": RUNS, "waiting": WAITING}, buckets)

    def windows_dir(self) -> str:
        return f"{self.out_dir}/windows"

    def waiting(self, spark: SparkSession) -> DataFrame:
        """``(run_id, next_chunk, n_waiting, first_waiting)`` of runs with chunks above a gap, after the last batch."""
        versions = self.state.versions(spark)
        held = self.state.read(spark, "waiting", versions).groupBy("run_id").agg(
            F.count("*").alias("n_waiting"), F.min("chunk_no").alias("first_waiting"))
        known = self.state.read(spark, "runs", versions).select("run_id", "next_chunk")
        return held.join(known, "run_id", "left").select(
            "run_id", F.coalesce("next_chunk", F.lit(0).cast("bigint")).alias("next_chunk"), "n_waiting", "first_waiting")

    def _ready(self, batch: DataFrame, waiting: DataFrame, known: DataFrame, step: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """Chunks that have not been processed, each once, with ``ready`` for those before the first gap of their run.

        The per-run row is spread over the spans of the run, so a busy run does not end up in one join task.
        """
        zero = F.lit(0).cast("bigint")
        both = batch.unionByName(waiting).withColumn("span", _span(F.col("chunk_no")))
        seen = both.select("run_id", "span").distinct().join(known, "run_id", "left")
        # Rows are dealt by (run_id, span) for the join; copies of a chunk are then side by side.
        todo = both.join(seen, ["run_id", "span"]).filter(
            (F.col("chunk_no") >= F.coalesce("next_chunk", zero)) & ~F.coalesce("ended", F.lit(False)))
        fresh = step(todo.dropDuplicates(["run_id", "span", "chunk_no"]), "fresh")
        ranked = number_within(fresh, ["run_id"], ["span"], [F.col("chunk_no")], "rank")
        # Numbers are distinct, so from the first gap on each is above its rank.
        ready = F.col("chunk_no") == F.coalesce("next_chunk", zero) + F.col("rank") - 1
        return ranked.select("run_id", "chunk_no", "data", "is_last", "escape", ready.alias("ready"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, zero = batch.sparkSession, F.lit(0).cast("bigint")
        step = lambda rows, name: self.state.step(rows, name, batch_id)
        batch = step(batch.select("run_id", "chunk_no", "data", F.coalesce("is_last", F.lit(False)).alias("is_last")), "batch")
        versions, touched = self.state.versions(spark, batch_id), self.state.touched(batch)
        runs_before = self.state.read(spark, "runs", versions, touched)
        known = runs_before.select("run_id", "next_chunk", "n_done", "escape", "raw_bytes", "ended", "locked")

        placed = step(self._ready(batch, self.state.read(spark, "waiting", versions, touched), known.select(
            "run_id", "next_chunk", "ended", "escape"), step), "placed")
        ready = placed.filter("ready")
        clean = step(clean_chunks(ready, F.col("escape")), "clean")
        # The open line of the last batch goes in front, as if it were a chunk.
        tails = runs_before.filter(~F.col("ended")).select(
            "run_id", (F.col("next_chunk") - 1).alias("chunk_no"), F.col("tail").alias("data"))
        lines = step(assemble_lines(clean.select("run_id", "chunk_no", "data").unionByName(tails), known), "lines")

        arrived = ready.groupBy("run_id").agg(
            F.max("is_last").alias("now_ended"), (F.max("chunk_no") + 1).alias("after"),
            F.sum(F.octet_length("data").cast("bigint")).alias("more_bytes"))
        left = clean.groupBy("run_id").agg(F.max_by("escape", "chunk_no").alias("now_escape"))
        closed = lines.filter(~F.col("is_open")).groupBy("run_id").agg((F.max("idx") + 1).alias("closed"))
        runs = step(
            known.join(arrived, "run_id", "full_outer").join(left, "run_id", "left").join(closed, "run_id", "left")
            .select("run_id", F.coalesce("closed", "n_done", zero).alias("n_done"),
                    F.coalesce("after", "next_chunk", zero).alias("next_chunk"),
                    F.coalesce("now_escape", "escape", F.lit(GROUND)).alias("escape"),
                    (F.coalesce("raw_bytes", zero) + F.coalesce("more_bytes", zero)).alias("raw_bytes"),
                    (F.coalesce("ended", F.lit(False)) | F.coalesce("now_ended", F.lit(False))).alias("ended"),
                    F.coalesce("now_ended", F.lit(False)).alias("now_ended"), "locked"), "runs")
        # One open line and at most one open window per run: these joins have no skew.
        open_lines = lines.filter("is_open").join(runs, "run_id")
        last_lines = open_lines.filter(F.col("ended") & (F.octet_length("data") > 0))
        held = runs_before.select("run_id", "n_done", F.posexplode("held").alias("k", "line")).select(
            "run_id", (F.col("n_done") - F.pmod("n_done", F.lit(self.size)) + F.col("k")).alias("idx"), "line")
        done_lines = (
            lines.filter(~F.col("is_open")).unionByName(last_lines.select(*lines.columns))
            .select("run_id", "idx", line_text(F.col("data")).alias("line")).unionByName(held)
        )
        windows = step(
            done_lines.groupBy("run_id", div(F.col("idx"), self.size).alias("window_no"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("rows"))
            .select("run_id", "window_no", F.size("rows").alias("n_lines"),
                    F.transform("rows", lambda r: r["line"]).alias("lines")), "windows")
        full = windows.filter(F.col("n_lines") == self.size)
        part = windows.filter(F.col("n_lines") < self.size).join(runs.select("run_id", "ended"), "run_id")
        done = full.unionByName(part.filter("ended").drop("ended"))
        texts = done.withColumn("text", F.array_join("lines", "\n")).drop("lines")
        out, locks = lock_windows(texts, runs.select("run_id", "locked"), self.p, lambda rows: step(rows, "locks")) if self.lock else (compact_windows(texts, self.p), None)
        out.write.mode("overwrite").parquet(f"{self.windows_dir()}/batch={batch_id}")

        if self.on_finished:
            kept = ready.select("run_id", "chunk_no", "data").withColumn("bucket", self.state.bucket(F.col("run_id")))
            kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.out_dir}/raw/batch={batch_id}")
            ended = runs.filter("now_ended").select("run_id")
            if touched and not ended.isEmpty():
                raw = spark.read.schema("run_id string, chunk_no bigint, data binary, batch bigint, bucket int").parquet(f"{self.out_dir}/raw")
                # Folders of other buckets, and of a later attempt, are not read.
                raw = raw.filter(F.col("bucket").isin(touched) & (F.col("batch") <= batch_id)).join(ended, "run_id", "left_semi")
                self.on_finished(batch_id, raw.select("run_id", "chunk_no", "data"))

        held_now = part.filter(~F.col("ended")).select("run_id", F.col("lines").alias("held"))
        after = runs.drop("now_ended").join(held_now, "run_id", "left").join(
            open_lines.filter(~F.col("ended")).select("run_id", F.col("data").alias("tail")), "run_id", "left")
        if locks is not None:
            after = after.drop("locked").join(locks, "run_id", "left")
        after = after.select("run_id", "n_done", "next_chunk", "escape", "raw_bytes", "ended", "locked",
                             F.coalesce("held", F.array().cast("array<string>")).alias("held"),
                             F.coalesce("tail", F.lit(b"")).alias("tail"))
        rest = placed.filter(~F.col("ready")).select("run_id", "chunk_no", "data", "is_last")
        self.state.write(batch_id, versions, touched, {"runs": after, "waiting": rest})

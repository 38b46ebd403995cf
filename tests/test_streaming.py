import pytest
from pyspark.sql import functions as F

from brevilog.operators.lines import lines_of_texts
from brevilog.functions.ansi import strip_ansi
from brevilog.functions.text import split_lines
from brevilog.plans import catalog
from brevilog.sources.journal import read_journal
from brevilog.streaming import live
from brevilog.streaming.chunks import ChunkCompactor, lines_of_chunks, newline_windows
from brevilog.streaming.state import BucketedState
from brevilog.streaming.windows import WindowCompactor, batch_windows, compact_windows, lock_archetypes
from . import brute

LOG = [f"2024-01-01T00:00:{i % 60:02}Z INFO item {i} é from 10.0.0.{i % 200}" for i in range(70)]
TEXTS = {
    "busy": "\n".join(LOG) + "\n",
    "mixed": "".join(f"{'  ' * (i % 5)}node {i:>20}\n" for i in range(30)) + "".join(f"row{i}   a    b\n" for i in range(40)),
    "brief": "one\ntwo\nthree",
    "exact": "".join(f"line {i} of the exact run, some words\n" for i in range(25)),
}
WINDOW = 25
SCHEMA = "run_id string, window_no bigint, n_lines int, archetype string, compacted string"


def expected():
    out = {}
    for run, text in TEXTS.items():
        lines = brute.lines_of(text)
        for w in range(0, len(lines), WINDOW):
            part = lines[w:w + WINDOW]
            joined = "\n".join(part)
            out[run, w // WINDOW] = (None, joined) if w == 0 and len(part) < 20 else brute.compact(joined)
    return out


def as_dict(df):
    rows = df.collect()
    got = {(r.run_id, r.window_no): (r.archetype, r.compacted) for r in rows}
    assert len(got) == len(rows), "a window was emitted twice"
    return got


@pytest.fixture(scope="module")
def lines(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "run_id string, text string")
    all_lines = lines_of_texts(texts, "run_id")
    n = all_lines.groupBy("run_id").agg(F.max("line_no").alias("line_no")).withColumn("is_last", F.lit(True))
    return all_lines.join(n, ["run_id", "line_no"], "left").fillna(False, ["is_last"]).select(
        "run_id", "line_no", "line", "is_last").cache()


def test_batch_windows(lines):
    assert as_dict(compact_windows(batch_windows(lines, window=WINDOW))) == expected()


@pytest.mark.parametrize("files", [1, 3, 10])
def test_stream_equals_batch(spark, lines, tmp_path, files):
    source = str(tmp_path / "in")
    # Files hold arbitrary lines, and one of them twice.
    lines.unionAll(lines.filter("run_id = 'busy' and line_no in (3, 60)")).repartition(files, F.hash("line")).write.parquet(source)
    stream = live.read_stream(spark, source, lines.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    live.start_window_compaction(stream, out, str(tmp_path / "cp"), window=WINDOW, once=True).awaitTermination()
    assert as_dict(spark.read.schema(SCHEMA).parquet(f"{out}/windows")) == expected()


def chunks_of(spark, size):
    rows = []
    for run, text in TEXTS.items():
        raw = text.replace("INFO", "\x1b[32mINFO\x1b[0m").encode()
        pieces = [raw[i:i + size] for i in range(0, len(raw), size)]
        rows += [(run, i, piece, i == len(pieces) - 1) for i, piece in enumerate(pieces)]
    return spark.createDataFrame(rows, "run_id string, chunk_no bigint, data binary, is_last boolean")


@pytest.mark.parametrize("size", [7, 100, 100_000])
def test_lines_of_chunks(spark, lines, size):
    got = {(r.run_id, r.line_no): r.line for r in lines_of_chunks(chunks_of(spark, size)).collect()}
    assert got == {(r.run_id, r.line_no): r.line for r in lines.collect()}


@pytest.mark.parametrize("size,cuts", [(64, [20]), (333, [1, 4])])
def test_chunk_stream_equals_batch(spark, tmp_path, size, cuts):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    chunks = chunks_of(spark, size).cache()
    for a, b in zip([0, *cuts], [*cuts, 1 << 40]):
        part = chunks.filter(F.col("chunk_no").between(a, b - 1))
        # A chunk of the batch before comes again, as after a restart of the source.
        part.unionAll(chunks.filter(F.col("chunk_no") == a - 1)).coalesce(1).write.mode("append").parquet(source)
    stream = live.read_stream(spark, source, chunks.schema, files_per_batch=1)
    live.start_chunk_compaction(stream, out, str(tmp_path / "cp"), window=WINDOW, once=True).awaitTermination()
    assert as_dict(spark.read.schema(SCHEMA).parquet(f"{out}/windows")) == expected()


def test_locked_archetype(lines):
    free = as_dict(compact_windows(batch_windows(lines, window=WINDOW)))
    locked = as_dict(lock_archetypes(batch_windows(lines, window=WINDOW)))
    assert free["mixed", 0][0] == "tree" and free["mixed", 2][0] != "tree"
    assert {a for (run, _), (a, _) in locked.items() if run == "mixed"} == {"tree"}
    assert locked["brief", 0] == (None, TEXTS["brief"])


def test_totals_and_live_tables(spark, tmp_path):
    chunks = chunks_of(spark, 50)
    source = str(tmp_path / "in")
    chunks.repartition(2).write.parquet(source)
    raw = str(tmp_path / "raw")
    stream = live.read_stream(spark, source, chunks.schema, files_per_batch=1)
    live.start_raw_sink(stream, raw, str(tmp_path / "cp"), once=True).awaitTermination()
    stored = spark.read.schema(chunks.schema).parquet(raw)
    sizes = {r.run_id: r.raw_bytes for r in live.raw_totals(stored).collect()}
    assert sizes["brief"] == len(TEXTS["brief"]) and set(sizes) == set(TEXTS)
    totals = {r.run_id: r for r in live.finished_totals(stored).collect()}
    assert totals["busy"].archetype == "linear-log" and totals["busy"].raw_bytes > totals["busy"].n_bytes

    journal = str(tmp_path / "journal")
    spark.range(50).select(
        (F.lit("2024-01-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 3).cast("int"))).alias("started_at"),
        F.lit(10).cast("bigint").alias("tokens_in"), F.lit(4).cast("bigint").alias("tokens_out")).repartition(2).write.parquet(journal)
    runs = live.read_stream(spark, journal, spark.read.parquet(journal).schema, files_per_batch=1)
    for name, metrics in (("daily", live.live_daily(runs)), ("summary", live.live_summary(runs))):
        live.start_live_table(metrics, str(tmp_path / name), str(tmp_path / f"cp-{name}"), once=True).awaitTermination()
    assert [r.runs for r in spark.read.parquet(str(tmp_path / "daily")).orderBy("day").collect()] == [17, 17, 16]
    s = spark.read.parquet(str(tmp_path / "summary")).first()
    assert (s.total_commands, s.tokens_saved, s.savings_pct) == (50, 300, 60.0)


def test_windows_that_end_with_a_chunk(spark):
    # Sizes in lines; True where the chunk ends with a line end.
    plan = [(3, True), (10, False), (4, True), (30, True), (60, False), (5, True), (2, False)]
    rows, lines = [], []
    for no, (n, ends) in enumerate(plan):
        part = [f"2024-01-01T00:00:00Z worker {len(lines) + i} waits for 10.0.0.1" for i in range(n)]
        rows.append(("r", no, ("\n".join(part) + "\n" if ends else "\n".join(part) + "\n" + "cut ").encode()))
        lines += part
    # A cut line is carried into the next chunk and ends there.
    lines = "".join(r[2].decode() for r in rows).split("\n")
    starts, done = [0], 0
    for n, ends in plan:
        done += n
        if ends:
            starts.append(done)
    expected, ready = [], False
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        for w in range(a, b, WINDOW):
            part = lines[w:min(w + WINDOW, b)]
            ready = ready or len(part) >= 20
            expected.append(brute.compact("\n".join(part)) if ready else (None, "\n".join(part)))
    df = spark.createDataFrame(rows, "run_id string, chunk_no bigint, data binary")
    got = newline_windows(df, window=WINDOW).orderBy("window_no").collect()
    assert [(r.archetype, r.compacted) for r in got] == expected
    assert [r.window_no for r in got] == list(range(len(got)))


CHUNKS = "run_id string, chunk_no bigint, data binary, is_last boolean"


def feed(spark, target, batches, schema=CHUNKS):
    for k, rows in enumerate(batches):
        target(spark.createDataFrame(rows, schema), k)


def lines_out(spark, out, run="r"):
    rows = spark.read.schema(SCHEMA).parquet(f"{out}/windows").filter(F.col("run_id") == run).orderBy("window_no").collect()
    return [x for r in rows for x in r.compacted.split("\n")]


def test_late_chunk_is_not_lost(spark, tmp_path):
    """Batches {0,2}, {1}, {3, last}, and one that comes again."""
    target = ChunkCompactor(str(tmp_path), window=20)
    one = lambda k: ("r", k, f"line {k}\n".encode(), k == 3)
    feed(spark, target, [[one(0), one(2)]])
    assert [tuple(r) for r in target.waiting(spark).collect()] == [("r", 1, 1, 2)]
    target(spark.createDataFrame([one(1), one(0)], CHUNKS), 1)
    assert target.waiting(spark).count() == 0
    target(spark.createDataFrame([one(3), one(2)], CHUNKS), 2)
    target(spark.createDataFrame([one(3), one(1)], CHUNKS), 3)
    assert lines_out(spark, tmp_path) == [f"line {k}" for k in range(4)]


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_shuffled_chunks(spark, tmp_path, batches):
    import random
    rows = [tuple(r) for r in chunks_of(spark, 97).collect()]
    random.Random(batches).shuffle(rows)
    rows += rows[::7]
    target = ChunkCompactor(str(tmp_path), window=WINDOW, buckets=3)
    feed(spark, target, [rows[k::batches] for k in range(batches)])
    assert as_dict(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/windows")) == expected()
    assert target.waiting(spark).count() == 0


def test_lasting_gap_is_listed_and_a_batch_may_run_again(spark, tmp_path):
    target = ChunkCompactor(str(tmp_path), window=20, buckets=2)
    rows = [("r", k, f"line {k}\n".encode(), k == 59) for k in range(60) if k != 41] + [("s", 0, b"x\n", True)]
    parts = [rows[:20], rows[20:50], rows[50:]]
    feed(spark, target, parts)
    target(spark.createDataFrame(parts[2], CHUNKS), 2)  # as after a lost driver
    assert [tuple(r) for r in target.waiting(spark).collect()] == [("r", 41, 18, 42)]
    assert lines_out(spark, tmp_path)[:2] == ["line 0", "line 1"] and lines_out(spark, tmp_path, "s") == ["x"]
    target(spark.createDataFrame([("r", 41, b"line 41\n", False)], CHUNKS), 3)
    rows = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/windows").filter("run_id = 'r'").orderBy("window_no").collect()
    assert [(r.window_no, r.n_lines) for r in rows] == [(0, 20), (1, 20), (2, 20)]


def test_state_is_written_for_touched_runs_only(spark, tmp_path):
    import os
    target = ChunkCompactor(str(tmp_path), window=20, buckets=8)
    feed(spark, target, [[(f"run{i}", 0, b"a\n", False) for i in range(40)]])
    before = target.state.versions(spark)
    assert len(before) > 4
    target(spark.createDataFrame([("run3", 1, b"b\n", False)], CHUNKS), 1)
    after = target.state.versions(spark)
    assert sum(after[b] != before[b] for b in after) == 1
    slots = [len(os.listdir(f"{tmp_path}/state/runs/{d}")) for d in os.listdir(f"{tmp_path}/state/runs") if d.startswith("bucket")]
    assert sorted(slots)[-2:] == [1, 2]


ESCAPED = [
    "plain \x1b[1;31mred\x1b[0m end\n", "a\x1b]0;title\x07b\n", "a\x1b]8;;http://x\x1b\\link\n", "a\x1bPq some\ndevice\nstring\x1b\\b\n", "x\x1b(By\x1b=z\n",
    "\x1b]0;never closed\nand on", "é\x1b[3é8mü\n", "\x1b\x1b[2Kq\x1b", "a\x1b_ap\x18c\x1b^p\x1ad", "\x1b[\x1b]\x1bP\x1b\x1b(\n", "\x1b \x1b F\x1b(0l\r\n", "t\x08\x07\x0b\tu\r\n",
    "\x1b[38;5;\n12mx", "a\x1b[?25l\x1b[12;4Hb\x1b]2;t\x1b[0mc\n",
]


def test_escapes_cut_at_every_byte(spark):
    """Whatever the cuts, the lines are those of the text stripped as a whole."""
    raw = "".join(ESCAPED)
    texts = [*ESCAPED, raw, raw[::-1]]
    rows = []
    for t, text in enumerate(texts):
        data = text.encode()
        for size in (1, 2, 3, 5):
            pieces = [data[i:i + size] for i in range(0, len(data), size)]
            pieces[1:1] = [b"", b""]
            rows += [(f"{t}/{size}", k, p) for k, p in enumerate(pieces)]
        if t < len(ESCAPED):
            for cut in range(1, len(data)):
                rows += [(f"{t}/at{cut}", 0, data[:cut]), (f"{t}/at{cut}", 1, data[cut:])]
    chunks = spark.createDataFrame(rows, "run_id string, chunk_no bigint, data binary")
    whole = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    # Valid UTF-8 again where a control split a character, as on the way of chunks.
    want = {r.t: r.lines for r in whole.select("t", split_lines(strip_ansi(F.col("text"))).alias("lines")).collect()}
    for span in (4096, 4):
        import brevilog.streaming.chunks as C
        old, C.CHUNK_SPAN = C.CHUNK_SPAN, span
        try:
            got = {}
            for r in lines_of_chunks(chunks).orderBy("run_id", "line_no").collect():
                got.setdefault(r.run_id, []).append(r.line)
        finally:
            C.CHUNK_SPAN = old
        for run in {r[0] for r in rows}:
            assert got.get(run, []) == want[int(run.split("/")[0])], run


def test_escape_state_lasts_over_batches(spark, tmp_path):
    text = "".join(ESCAPED[:5]) * 3
    data = text.encode()
    pieces = [data[i:i + 3] for i in range(0, len(data), 3)]
    rows = [("r", k, p, k == len(pieces) - 1) for k, p in enumerate(pieces)]
    target = ChunkCompactor(str(tmp_path), window=20)
    feed(spark, target, [rows[:7], rows[7:40], rows[40:]])
    want = spark.createDataFrame([(text,)], "t string").select(split_lines(strip_ansi(F.col("t"))).alias("x")).first().x
    got = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/windows").orderBy("window_no").collect()
    assert sum(r.n_lines for r in got) == len(want)
    assert got[0].n_lines < 20 and got[0].compacted.split("\n") == want


def test_lock_in_streams(spark, lines, tmp_path):
    """The first choice of a run holds for its later windows, in whatever order they come."""
    want = as_dict(lock_archetypes(batch_windows(lines, window=WINDOW)))
    rows = [tuple(r) for r in lines.collect()]
    target = WindowCompactor(f"{tmp_path}/lines", window=WINDOW, lock=True)
    feed(spark, target, [rows[::-1][k::2] for k in range(2)], lines.schema)
    assert as_dict(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/lines/windows")) == want
    chunks = [tuple(r) for r in chunks_of(spark, 200).collect()]
    feed(spark, ChunkCompactor(f"{tmp_path}/chunks", window=WINDOW, lock=True), [chunks[k::2] for k in range(2)])
    assert as_dict(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/chunks/windows")) == want


def test_expired_window_is_not_written_again(spark, tmp_path):
    schema = "run_id string, line_no bigint, line string, is_last boolean"
    target = WindowCompactor(str(tmp_path), window=20, expiry_ms=0)
    row = lambda k: ("r", k, f"line {k}", False)
    feed(spark, target, [[row(k) for k in range(1, 26) if k != 7]], schema)
    target(spark.createDataFrame([("other", 1, "x", False)], schema), 1)   # what is held is due by now
    target(spark.createDataFrame([row(7), row(3), row(22)], schema), 2)    # one too late, two again
    target(spark.createDataFrame([row(7), row(30)], schema), 3)
    rows = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/windows").filter("run_id = 'r'").orderBy("window_no").collect()
    assert [(r.window_no, r.n_lines) for r in rows] == [(0, 19), (1, 5)]
    assert {r.run_id: r.n_late for r in target.late(spark).collect()} == {"r": 2}


def test_window_streams_run_without_python(spark, lines):
    import inspect
    import brevilog.streaming.windows as W
    source = inspect.getsource(W)
    assert "Pandas" not in source and "udf" not in source.lower()


def run_info(spark):
    rows = [("busy", ["make", "all"], "/w", "2024-01-01 10:00:00", "2024-01-01 10:00:02", 0, "logs/busy.log", "debug:test-failure", False),
            ("mixed", ["ls"], "/w", "2024-01-01 11:00:00", "2024-01-01 11:00:01", 1, "logs/mixed.log", None, True),
            ("brief", ["true"], "/w", "2024-01-02 11:00:00", "2024-01-02 11:00:01", 0, "logs/brief.log", None, False),
            ("silent", ["true"], "/w", "2024-01-02 11:00:00", "2024-01-02 11:00:00", 0, "logs/silent.log", None, False)]
    return spark.createDataFrame(rows, "id string, argv array<string>, cwd string, s string, f string, exit_code int, log_path string, intent string, is_tty boolean").select(
        "id", "argv", "cwd", F.col("s").cast("timestamp_ntz").alias("started_at"), F.col("f").cast("timestamp_ntz").alias("finished_at"),
        "exit_code", "log_path", "intent", "is_tty")


def test_finished_runs_reach_the_journal_once(spark, tmp_path):
    chunks = [tuple(r) for r in chunks_of(spark, 300).collect()] + [("silent", 0, b"", True)]
    parts = [chunks[k::3] for k in range(3)]
    path = str(tmp_path / "journal")
    info = run_info(spark)
    from brevilog.sources.journal import append_new_runs
    target = ChunkCompactor(str(tmp_path / "out"), window=WINDOW,
                            on_finished=lambda _, ended: append_new_runs(live.finished_runs(ended, info), path))
    feed(spark, target, parts)
    got = {r.id: r for r in read_journal(spark, path).collect()}
    assert set(got) == {"busy", "mixed", "brief", "silent"}
    raw = {run: len(text.replace("INFO", "\x1b[32mINFO\x1b[0m").encode()) for run, text in TEXTS.items()}
    for run in ("busy", "brief"):
        kind, text = brute.compact(TEXTS[run], "debug:test-failure" if run == "busy" else None)
        r = got[run]
        assert (r.raw_bytes, r.archetype) == (raw[run], kind)
        assert (r.tokens_in, r.tokens_out) == ((len(TEXTS[run].encode()) + 3) // 4, (len(text.encode()) + 3) // 4)
    tty = got["mixed"]
    assert tty.tokens_in == tty.tokens_out == (raw["mixed"] + 3) // 4 and (tty.savings_pct, tty.archetype) == (0.0, "passthrough")
    assert (got["silent"].raw_bytes, got["silent"].tokens_in, got["busy"].wall_ms) == (0, 0, 2000)
    target(spark.createDataFrame(parts[2], CHUNKS), 2)  # the same batch again
    target(spark.createDataFrame(parts[0], CHUNKS), 3)  # the same chunks again
    assert read_journal(spark, path).count() == 4


def test_state_has_few_files(spark, tmp_path):
    """Tasks don't each write a file to every bucket, and a state not yet written is known to be empty."""
    state = BucketedState(str(tmp_path), {"t": "run_id string, n bigint"}, buckets=8)
    assert state.read(spark, "t", {}).columns == ["run_id", "n"]
    assert "LocalRelation <empty>" in state.read(spark, "t", {})._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(2000).repartition(16).select(F.col("id").cast("string").alias("run_id"), F.col("id").alias("n"))
    state.write(0, {}, list(range(8)), {"t": rows})
    assert len(list(tmp_path.glob("t/**/*.parquet"))) <= 16
    assert state.versions(spark) == {b: 1 for b in range(8)}
    assert sorted(r.n for r in state.read(spark, "t", state.versions(spark)).collect()) == list(range(2000))


def test_chunk_parts_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "scratch_path", lambda _, name: str(tmp_path / name))
    assert catalog.CATALOG["st08b_chunk_stream"][0](spark, "/root/testdata/sf0.001").count() > 0
    assert len(list(tmp_path.glob("chunks/*.parquet"))) > 3


def test_lines_of_finished_runs_are_made_once(spark):
    """One pass for the raw bytes; escapes are followed and lines put together once, whatever reads them."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def seen(data):
        read.add(1)
        return data
    chunks = chunks_of(spark, 200).repartition(2).cache().withColumn("data", seen(F.col("data")))
    lines_of_chunks(chunks, exact=True).write.format("noop").mode("overwrite").save()
    once = read.value
    assert len(live.finished_totals(chunks).collect()) == len(TEXTS)
    assert read.value - once <= once + chunks.count()

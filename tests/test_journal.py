import json

import pytest
from pyspark.sql import functions as F

from brevilog.plans import journal as J
from brevilog.schema import RUNS, RUNS_TEXT
from brevilog.sources import journal as S
from brevilog.sources import logs, reports


def text_row(id_, argv, started, tin, tout, wall=42, exit_code=0, tty=0, cwd="/tmp"):
    return (id_, argv, cwd, started, started, wall, exit_code, 4 * tin, tin, tout, 0.0, f"logs/{id_}.log", None, tty)


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        text_row("a", '["git","status"]', "2024-01-30T10:00:00Z", 100, 20),
        text_row("b", '["git","log"]', "2024-01-29T23:30:00-02:00", 50, 80),
        text_row("c", '["npm"]', "2024-01-28T00:00:00+00:00", 1000, 10),
        text_row("d", "broken", "2024-01-20T12:00:00Z", 10, 5),
        text_row("e", "[]", "2023-12-01T12:00:00Z", 7, 7, wall=-5),
    ]
    return S.from_text_rows(spark.createDataFrame(rows, RUNS_TEXT)).cache()


def test_text_rows(runs):
    got = {r.id: r for r in runs.collect()}
    assert got["b"].started_at.isoformat() == "2024-01-30T01:30:00"
    assert got["d"].argv == ["broken"] and got["e"].argv == [] and got["e"].wall_ms == 0


def test_instants_do_not_move_with_the_session_zone(spark, runs):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([text_row("x", "[]", "2024-03-10T02:30:00Z", 1, 1)], RUNS_TEXT)
        assert S.from_text_rows(rows).first().started_at.isoformat() == "2024-03-10T02:30:00"
        assert [str(r.day) for r in J.daily(runs, as_of="2024-01-30").collect()][-1] == "2024-01-30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_summary(spark, runs):
    r = J.summary(runs).first()
    assert (r.total_commands, r.tokens_in, r.tokens_out, r.tokens_saved) == (5, 1167, 122, 1045)
    assert r.avg_exec_ms == 42 * 4 // 5
    empty = J.summary(spark.createDataFrame([], RUNS)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0.0, 0, 0)
    two = S.from_text_rows(spark.createDataFrame(
        [text_row(i, '["echo","hello"]', "2024-01-01T00:00:00Z", 32, 6) for i in "ab"], RUNS_TEXT))
    r = J.summary(two).first()
    assert (r.total_commands, r.tokens_in, r.tokens_out, r.tokens_saved, r.savings_pct) == (2, 64, 12, 52, 81.25)


def test_history_and_daily(runs):
    assert [r.id for r in J.history(runs, 3).collect()] == ["a", "b", "c"]
    assert [r.tokens_saved for r in J.history(runs, 3).collect()] == [80, 0, 990]
    days = [(str(r.day), r.runs, r.tokens_saved) for r in J.daily(runs, as_of="2024-01-30").collect()]
    assert days == [("2024-01-20", 1, 5), ("2024-01-28", 1, 990), ("2024-01-30", 2, 50)]
    assert [str(r.day) for r in J.daily(runs, days=2).collect()] == ["2024-01-28", "2024-01-30"]
    peaks = J.daily_peaks(J.daily(runs)).collect()
    assert [r.is_peak for r in peaks] == [False, True, False] and peaks[1].fraction == 1.0


def test_daily_range_reaches_the_scan(spark, runs, tmp_path):
    path = str(tmp_path / "journal")
    S.append_runs(runs.withColumn("savings_pct", F.lit(0.0)), path)
    plan = J.daily(S.read_journal(spark, path), as_of="2024-01-30")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(started_at), GreaterThanOrEqual(started_at,2023-12-31T00:00)]" in plan


def test_weekly(runs):
    r = J.weekly_of(runs, "2024-01-30").first()  # a Tuesday: the week began on the 28th
    assert (r.saved_this_week, r.saved_last_week, r.runs_this_week, r.runs_last_week) == (1040, 0, 3, 0)
    assert r.change_pct is None and r.direction == "—"
    assert J.weekly_of(runs.filter("id = 'a'"), "2024-01-30").count() == 0


def test_top_commands(runs):
    full = [(r.command, r.runs, r.saved) for r in J.top_commands(runs, whole=True).collect()]
    assert full == [("npm", 1, 990), ("git", 2, 50), ("broken", 1, 5), ("unknown", 1, 0)]
    # All command lines are equally frequent, so the pick is by text: [], broken.
    assert {r.command for r in J.top_commands(runs, 2).collect()} == {"unknown", "broken"}
    shares = J.command_shares(J.top_commands(runs, whole=True), 2).collect()
    assert [r.command for r in shares] == ["npm", "git"]


def test_costs_and_kpis(spark, runs):
    totals = spark.createDataFrame([("gpt-4o", 2000), ("mystery", 2000)], "model string, tokens_saved bigint")
    assert {r.model: r.cost_saved for r in J.cost_saved(totals).collect()} == {"gpt-4o": 12.5, "mystery": 18.0}
    assert J.kpis(runs).first().cost_saved == 1045 / 1000 * 9


def test_logs_lookup_and_retention(spark):
    rows = [(f"logs/{i:03}.log", f"{i:03}", i * 600, i // 2) for i in range(120)]
    listing = spark.createDataFrame(rows, "path string, run_id string, length bigint, modified_at bigint")
    assert [r.run_id for r in J.retention_victims(listing).orderBy("path").collect()] == [f"{i:03}" for i in range(20)]
    assert J.retention_victims(listing.limit(100)).count() == 0
    assert [(r.run_id, r.outcome) for r in J.lookup_log(listing, "11").collect()] == [(f"11{i}", "many") for i in range(10)]
    assert [(r.outcome, r.size) for r in J.lookup_log(listing, "002").collect()] == [("one", "1.2 KB")]
    assert J.lookup_log(listing, "x").count() == 0
    assert tuple(J.purge_report(listing).first()) == (120, 600 * 119 * 60, "4.1 MB")


def test_snapshot(spark, runs):
    parts = J.snapshot(runs, as_of="2024-01-30")
    assert parts["summary"].first().has_data and parts["recent"].count() == 5
    assert not J.snapshot(spark.createDataFrame([], RUNS))["summary"].first().has_data


def test_append_and_ignore(spark, runs, tmp_path):
    path = str(tmp_path / "journal")
    rows = runs.withColumn("savings_pct", F.lit(0.0))
    S.append_new_runs(rows.filter("id in ('a', 'c')"), path)
    S.append_new_runs(rows.unionAll(rows), path)
    back = S.read_journal(spark, path)
    assert sorted(r.id for r in back.collect()) == list("abcde")
    assert [r.id for r in S.time_range(back, "2024-01-28", "2024-01-30").collect()] == ["c"]
    assert {r.root for r in S.read_journal(spark, path, path).select("root").collect()} == {path}
    assert S.read_journal(spark, path, path).count() == 10
    assert J.in_scope(back, "/none").count() == 0


def test_reports(spark, runs, tmp_path):
    rows = runs.withColumn("savings_pct", F.when(F.col("id") == "a", 81.25).otherwise(0.0))
    first = json.loads(reports.history_json(J.history(rows, 1)).first().json)
    assert first["started_at"] == "2024-01-30T10:00:00Z" and first["argv"] == ["git", "status"]
    assert json.loads(reports.summary_json(J.summary(rows)).first().json)["input_tokens"] == 1167
    path = str(tmp_path / "csv")
    quoted = rows.withColumn("argv", F.when(F.col("id") == "a", F.array(F.lit('say "hi", x'))).otherwise(F.col("argv")))
    reports.write_csv(J.history(quoted, 2), path)
    back = spark.read.option("escape", '"').csv(path, header=True).orderBy(F.desc("started_at")).collect()
    assert back[0].argv == 'say "hi", x' and back[0].savings_pct == "81.3"
    footer = json.loads(reports.footers(rows.withColumn("archetype", F.lit("tree")).filter("id = 'a'")).first().json)["run"]
    assert footer["savings_pct"] == "81.2" and footer["recover_full_output"] == {"command": "cat", "args": ["logs/a.log"]}


def test_log_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "ab1.log").write_bytes(b"\x1b[31mERROR\x1b[0m x\n" + b"tick 12\n" * 60 + b"bad \xff byte\n")
    (folder / "ab2.log").write_bytes(b"short\n")
    (folder / "note.txt").write_text("not a log\n")
    (folder / "blank.txt").write_text(" \n\n")
    scan = logs.scan_logs(spark, str(folder))
    assert sorted(r.run_id for r in scan.select("run_id").collect()) == ["ab1", "ab2"]
    r = logs.replay(scan, "ab1").first()
    assert r.outcome == "one" and r.archetype == "linear-log"
    assert r.compacted == "ERROR x\ntick 12  × 56\n--- last 5 lines ---\n" + "tick 12\n" * 4 + "bad \ufffd byte\n"
    assert [(r.run_id, r.length, r.outcome, r.compacted) for r in logs.replay(scan, "ab").collect()] == [
        (f, (folder / f"{f}.log").stat().st_size, "many", None) for f in ("ab1", "ab2")]
    assert {r.outcome for r in logs.replay_each(scan, "ab").collect()} == {"many"}
    assert logs.replay(scan, "zz").count() == 0
    texts = logs.read_texts(spark, f"{folder}/*.txt")
    assert [r.text for r in texts.collect()] == ["not a log\n"]
    assert [r.compacted for r in logs.compact_files(spark, f"{folder}/ab1.log", head=2).collect()] == ["\x1b[31mERROR\x1b[0m x\ntick 12"]


def test_accuracy(spark):
    df = spark.createDataFrame([("tree", "tree", 10, 5), ("tabular", "tree", 20, 5)], "expected string, archetype string, n_bytes bigint, out_bytes bigint")
    r = J.accuracy(df).first()
    assert (r.total, r.correct, r.accuracy_pct, r.size_ratio) == (2, 1, 50.0, 3.0)


@pytest.mark.parametrize("split", [None, 64, 1000])
def test_lines_of_large_files(spark, tmp_path, split):
    """Lines, numbers and sizes don't depend on how files are split; CRLF, a missing last line end and bad bytes are kept apart."""
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    files = {
        "a": b"".join(b"line %d of the log\n" % i for i in range(300)),
        "b": b"one\r\ntwo\n\n\r\nno end",
        "c": b"",
        "d": b"\n",
        "deep/e": "é x\x0by\rz\n".encode() * 40 + b"bad \xff byte\n" + b"w" * 5000 + b"\nend\r",
    }
    for name, data in files.items():
        (folder / f"{name}.log").write_bytes(data)
    (folder / "note.txt").write_text("not a log\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        scan = logs.scan_lines(spark, str(folder))
        got = {}
        for r in scan.lines.orderBy("run_id", "line_no").collect():
            got.setdefault(r.run_id, []).append((r.line_no, r.line, r.cr, r.lf))
        runs = {r.run_id: (r.n_lines, r.n_bytes, r.ends_newline) for r in scan.runs.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, data in files.items():
        parts = data.split(b"\n")
        ends = parts[-1] == b""
        parts = parts[:-1] if ends else parts
        want = [(k + 1, (p[:-1] if p.endswith(b"\r") else p).decode(errors="replace"), p.endswith(b"\r"), ends or k < len(parts) - 1)
                for k, p in enumerate(parts)]
        run = name.split("/")[-1]
        assert got.get(run, []) == want
        assert runs.get(run) == ((len(parts), len(data), ends) if data else None)


def test_append_reads_the_folders_of_its_ids_only(spark, runs, tmp_path):
    path = str(tmp_path / "journal")
    S.append_new_runs(runs.withColumn("savings_pct", F.lit(0.0)), path)
    plan = S.ids_like(spark, runs.filter("id = 'a'"), path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "ReadSchema: struct<id:string>" in plan
    ids = {r.id for r in S.ids_like(spark, runs.filter("id = 'a'"), path).collect()}
    assert "a" in ids and ids < set("abcde")


def test_new_runs_are_made_once(spark, runs, tmp_path):
    """Runs of a stream are the result of a whole compaction, which an append to a stored journal reads once."""
    path, made = str(tmp_path / "journal"), spark.sparkContext.accumulator(0)
    rows = runs.withColumn("savings_pct", F.lit(0.0))
    S.append_new_runs(rows.filter("id = 'a'"), path)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text
    S.append_new_runs(rows.withColumn("id", seen(F.col("id"))), path)
    assert made.value == rows.count()
    assert sorted(r.id for r in S.read_journal(spark, path).collect()) == ["a", "b", "c", "d", "e"]

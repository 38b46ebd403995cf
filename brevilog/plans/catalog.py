"""Registered queries: name -> (Spark query, DuckDB statement or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ansi, labels as L, redact as R, text as X, tokens as T
from ..functions.fingerprint import fingerprint
from ..operators import classify as C
from ..operators import compact as K
from ..operators import intents as I
from ..operators import lines as N
from ..operators import mining as M
from ..operators import sections as D
from ..operators import texts as W
from ..session import scratch_path, stash
from ..sources import logs as log_files
from ..sources import reports
from ..sources.journal import append_new_runs, append_runs, new_runs, read_journal
from ..streaming import chunks as live_chunks
from ..streaming import live
from ..streaming import windows as S
from . import journal as J
from . import oracle as O
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        CATALOG[name] = (fn, sql)
        return fn
    return add


def _r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def _iso(name: str) -> Column:
    return L.iso_text(F.col(name)).alias(name)


ISO = "strftime(started_at, '%Y-%m-%dT%H:%M:%S')"
SAVED = "greatest(tokens_in - tokens_out, 0)"
PCT = O.pct("tokens_in", "tokens_out")
RAW_PCT = "CASE WHEN tokens_in = 0 THEN 0e0 ELSE CAST(greatest(tokens_in - tokens_out, 0) AS DOUBLE) / CAST(tokens_in AS DOUBLE) * 100e0 END"
PER_DAY = f"""per_day AS (SELECT CAST(started_at AS DATE) AS day, count(*) AS runs, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM runs
  WHERE CAST(started_at AS DATE) >= DATE '{O.AS_OF}' - 30 GROUP BY 1),
daily AS (SELECT *, {SAVED} AS tokens_saved FROM per_day)"""
SUMMARY = f"""summary AS (SELECT count(*) AS total_commands, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(wall_ms) AS BIGINT) AS wall FROM runs)"""


# --- journal ----------------------------------------------------------------------

@register("a01_summary", f"""WITH {O.RUNS}, {SUMMARY} SELECT total_commands, tokens_in, tokens_out, {SAVED} AS tokens_saved,
  {PCT} AS savings_pct, wall AS total_exec_ms, wall // total_commands AS avg_exec_ms FROM summary""")
def a01(spark, sf):
    return J.summary(V.runs(spark, sf))


HISTORY = f"""SELECT id, {ISO} AS started_at, array_to_string(argv, ' ') AS argv, round({RAW_PCT}, 6) AS savings_pct,
  {SAVED} AS tokens_saved, tokens_in, tokens_out, wall_ms, exit_code, log_path FROM runs
  ORDER BY runs.started_at DESC, id LIMIT 20"""


@register("a02_history", f"WITH {O.RUNS} {HISTORY}")
def a02(spark, sf):
    h = J.history(V.runs(spark, sf))
    return h.withColumns({"started_at": _iso("started_at"), "argv": L.command_line(F.col("argv")),
                          "savings_pct": _r6("savings_pct")})


def _daily(spark, sf):
    return J.daily(V.runs(spark, sf), as_of=O.AS_OF)


@register("a03_daily", f"WITH {O.RUNS}, {PER_DAY} SELECT CAST(day AS VARCHAR) AS day, runs, tokens_in, tokens_out, tokens_saved FROM daily ORDER BY 1")
def a03(spark, sf):
    return _daily(spark, sf).withColumn("day", F.col("day").cast("string"))


@register("a04_daily_latest", f"""WITH {O.RUNS}, newest AS (SELECT CAST(max(started_at) AS DATE) AS d FROM runs)
  SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, count(*) AS runs, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out, greatest(CAST(sum(tokens_in) - sum(tokens_out) AS BIGINT), 0) AS tokens_saved
  FROM runs, newest WHERE strftime(started_at, '%Y-%m-%dT%H:%M:%S') >= strftime(d - 7, '%Y-%m-%d') GROUP BY 1 ORDER BY 1""")
def a04(spark, sf):
    return J.daily(V.runs(spark, sf), days=7).withColumn("day", F.col("day").cast("string"))


@register("a05_daily_peak", f"""WITH {O.RUNS}, {PER_DAY}, top AS (SELECT greatest(max(tokens_saved), 1) AS m FROM daily)
  SELECT CAST(day AS VARCHAR) AS day, runs, tokens_saved, round(CAST(tokens_saved AS DOUBLE) / m, 6) AS fraction,
  CAST(tokens_saved AS DOUBLE) / m >= 0.95e0 AS is_peak FROM daily, top ORDER BY 1""")
def a05(spark, sf):
    return J.daily_peaks(_daily(spark, sf)).select(
        F.col("day").cast("string").alias("day"), "runs", "tokens_saved", _r6("fraction"), "is_peak")


def _top_sql(inner: str, limit: str = "LIMIT 10") -> str:
    return f"""lines AS (SELECT argv, count(*) AS n, sum(tokens_in) AS ti, sum(tokens_out) AS tout FROM runs GROUP BY argv {inner}),
top AS (SELECT argv[1] AS command, CAST(sum(n) AS BIGINT) AS runs, greatest(CAST(sum(ti) - sum(tout) AS BIGINT), 0) AS saved,
  round(CASE WHEN sum(ti) = 0 THEN 0e0 ELSE CAST(sum(ti) - sum(tout) AS DOUBLE) / CAST(sum(ti) AS DOUBLE) * 100e0 END, 6) AS pct
  FROM lines GROUP BY 1 ORDER BY saved DESC, command {limit})"""


@register("a06_top_commands", f"WITH {O.RUNS}, {_top_sql('ORDER BY n DESC, argv LIMIT 10')} SELECT * FROM top")
def a06(spark, sf):
    return J.top_commands(V.runs(spark, sf))


@register("a06b_top_commands_full", f"WITH {O.RUNS}, {_top_sql('')} SELECT * FROM top")
def a06b(spark, sf):
    return J.top_commands(V.runs(spark, sf), whole=True)


@register("a07_weekly", f"""WITH {O.RUNS}, {PER_DAY},
  w AS (SELECT DATE '{O.AS_OF}' - CAST(dayofweek(DATE '{O.AS_OF}') AS INT) AS s),
  x AS (SELECT count(*) AS days,
    CAST(coalesce(sum(tokens_saved) FILTER (day >= s), 0) AS BIGINT) AS saved_this_week,
    CAST(coalesce(sum(tokens_saved) FILTER (day < s AND day >= s - 7), 0) AS BIGINT) AS saved_last_week,
    CAST(coalesce(sum(runs) FILTER (day >= s), 0) AS BIGINT) AS runs_this_week,
    CAST(coalesce(sum(runs) FILTER (day < s AND day >= s - 7), 0) AS BIGINT) AS runs_last_week FROM daily, w)
  SELECT saved_this_week, saved_last_week, runs_this_week, runs_last_week,
    CASE WHEN saved_last_week > 0 THEN round(CAST(saved_this_week - saved_last_week AS DOUBLE) / saved_last_week * 100e0, 6) END AS change_pct,
    CASE WHEN saved_last_week > 0 THEN CASE WHEN saved_this_week > saved_last_week THEN '▲' ELSE '▼' END ELSE '—' END AS direction
  FROM x WHERE days >= 2""")
def a07(spark, sf):
    return J.weekly_of(V.runs(spark, sf), O.AS_OF)


PRICE_SQL = """prices AS (SELECT * FROM (VALUES ('claude-sonnet-4', 3e0, 15e0), ('claude-opus-4', 15e0, 75e0), ('gpt-4o', 2.5e0, 10e0),
  ('gpt-4.1', 2e0, 8e0), ('gpt-4.1-mini', 0.4e0, 1.6e0), ('gpt-4.1-nano', 0.1e0, 0.4e0)) t(model, price_in, price_out))"""


@register("a08_cost_saved", f"""WITH {O.RUNS}, {PRICE_SQL}, asked AS (SELECT model FROM prices UNION ALL SELECT 'in-house'),
  saved AS (SELECT greatest(CAST(sum(tokens_in) - sum(tokens_out) AS BIGINT), 0) AS tokens_saved FROM runs)
  SELECT a.model, tokens_saved, coalesce(price_in, 3e0) AS price_in, coalesce(price_out, 15e0) AS price_out,
    round(tokens_saved / 1000e0 * (coalesce(price_in, 3e0) + coalesce(price_out, 15e0)) / 2, 6) AS cost_saved
  FROM asked a LEFT JOIN prices p ON a.model = p.model, saved""")
def a08(spark, sf):
    models = F.array(*[F.lit(m) for m in [*[r[0] for r in J.PRICE_ROWS], "in-house"]])
    totals = J.summary(V.runs(spark, sf)).select(F.explode(models).alias("model"), "tokens_saved")
    return J.cost_saved(totals).withColumn("cost_saved", F.round("cost_saved", 6))


@register("a09_kpis", f"""WITH {O.RUNS}, {SUMMARY} SELECT 'claude-sonnet-4' AS model, total_commands AS runs, {SAVED} AS tokens_saved,
  {PCT} AS savings_pct, tokens_out, round(CAST(tokens_out AS DOUBLE) / tokens_in * 100e0, 6) AS out_ratio_pct,
  round({SAVED} / 1000e0 * 9e0, 6) AS cost_saved, wall // total_commands AS avg_exec_ms,
  CASE WHEN {PCT} >= 80 THEN 'Superior' WHEN {PCT} >= 60 THEN 'Strong' WHEN {PCT} >= 40 THEN 'Solid'
       WHEN {PCT} >= 20 THEN 'Moderate' ELSE 'Low' END AS badge FROM summary""")
def a09(spark, sf):
    return J.kpis(V.runs(spark, sf))


@register("a10_top_command_share", f"""WITH {O.RUNS}, {_top_sql('ORDER BY n DESC, argv LIMIT 10')}
  SELECT command, saved, round(CAST(saved AS DOUBLE) / greatest(sum(saved) OVER (), 1) * 100e0, 6) AS share_pct
  FROM top ORDER BY saved DESC, command LIMIT 4""")
def a10(spark, sf):
    return J.command_shares(J.top_commands(V.runs(spark, sf)))


LISTING = "listing AS (SELECT log_path AS path, id AS run_id, raw_bytes AS length, finished_at AS modified_at FROM runs)"


@register("a13_log_lookup", f"""WITH {O.RUNS}, {LISTING}, f AS (SELECT * FROM listing WHERE starts_with(run_id, '42'))
  SELECT run_id, path, length AS size_bytes, {O.size_text('length')} AS size,
    CASE WHEN count(*) OVER () = 1 THEN 'one' ELSE 'many' END AS outcome FROM f ORDER BY run_id""")
def a13(spark, sf):
    return J.lookup_log(V.log_listing(spark, sf), "42")


@register("a14_retention", f"""WITH {O.RUNS}, {LISTING}, r AS (SELECT *, row_number() OVER (ORDER BY modified_at DESC, path DESC) AS rn FROM listing)
  SELECT path, run_id, length FROM r WHERE rn > 100""")
def a14(spark, sf):
    return J.retention_victims(V.log_listing(spark, sf)).select("path", "run_id", "length")


@register("a15_purge_report", f"""WITH {O.RUNS}, p AS (SELECT count(*) AS logs_purged, CAST(sum(raw_bytes) AS BIGINT) AS bytes_freed FROM runs)
  SELECT logs_purged, bytes_freed, {O.size_text('bytes_freed')} AS space_freed FROM p""")
def a15(spark, sf):
    return J.purge_report(V.log_listing(spark, sf))


@register("a16_accuracy", f"""WITH {O.LINES_TABLE}, {O.classified()}, {O.compacted()},
  sz AS (SELECT run_id, CAST(sum(strlen(line)) + count(*) AS BIGINT) AS b FROM outl GROUP BY run_id),
  x AS (SELECT archetype, n_bytes, b - CASE WHEN route = 'raw' AND NOT is_short THEN 1 ELSE 0 END AS out_bytes
        FROM routed JOIN sz USING (run_id))
  SELECT count(*) AS total, count(*) FILTER (archetype = 'tabular') AS correct, CAST(sum(n_bytes) AS BIGINT) AS bytes_in,
    CAST(sum(out_bytes) AS BIGINT) AS bytes_out,
    round(CAST(count(*) FILTER (archetype = 'tabular') AS DOUBLE) / count(*) * 100e0, 6) AS accuracy_pct,
    round(CAST(sum(n_bytes) AS DOUBLE) / sum(out_bytes), 6) AS size_ratio FROM x""")
def a16(spark, sf):
    done = K.compact_lines(V.lines_table(spark, sf))
    return J.accuracy(K.report(done).withColumn("expected", F.lit(C.TABULAR)))


# The archetype that each view is made to have.
KINDS = {"log": C.LINEAR, "table": C.TABULAR, "tree": C.TREE, "doc": C.PASSTHROUGH}


def _kinds_sql() -> str:
    views = {"log": O.LINES_LOG, "table": O.LINES_TABLE, "tree": O.LINES_TREE, "doc": O.LINES_DOC}
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS expected, archetype, n_bytes, out_bytes FROM ({O.report(views[v])})" for v, kind in KINDS.items())


@register("a16b_accuracy_of_kinds", f"""SELECT expected, count(*) AS total, count(*) FILTER (archetype = expected) AS correct,
  CAST(sum(n_bytes) AS BIGINT) AS bytes_in, CAST(sum(out_bytes) AS BIGINT) AS bytes_out,
  round(CAST(count(*) FILTER (archetype = expected) AS DOUBLE) / count(*) * 100e0, 6) AS accuracy_pct,
  round(CAST(sum(n_bytes) AS DOUBLE) / sum(out_bytes), 6) AS size_ratio FROM ({_kinds_sql()}) GROUP BY expected""")
def a16b(spark, sf):
    """Accuracy over runs of all four kinds, by the kind that is expected."""
    build = {"log": V.lines_log, "table": V.lines_table, "tree": V.lines_tree, "doc": V.lines_doc}
    done = [K.report(K.compact_lines(build[v](spark, sf))).select(F.lit(kind).alias("expected"), "archetype", "n_bytes", "out_bytes")
            for v, kind in KINDS.items()]
    rows = done[0].unionByName(done[1]).unionByName(done[2]).unionByName(done[3])
    right = F.count(F.when(F.col("archetype") == F.col("expected"), 1))
    total = rows.groupBy("expected").agg(
        F.count("*").alias("total"), right.alias("correct"), F.sum("n_bytes").alias("bytes_in"), F.sum("out_bytes").alias("bytes_out"))
    return total.withColumns({"accuracy_pct": F.round(F.col("correct") / F.col("total") * 100, 6),
                              "size_ratio": F.round(F.col("bytes_in").cast("double") / F.col("bytes_out"), 6)})


@register("a17_snapshot", f"""WITH {O.RUNS}, {SUMMARY}, {PER_DAY}, {_top_sql('ORDER BY n DESC, argv LIMIT 10')},
  h AS (SELECT id FROM runs ORDER BY started_at DESC, id LIMIT 30)
  SELECT 'summary' AS part, 'total' AS name, total_commands AS runs, {SAVED} AS tokens_saved FROM summary
  UNION ALL SELECT 'recent', id, 1, {SAVED} FROM runs WHERE id IN (SELECT id FROM h)
  UNION ALL SELECT 'daily', CAST(day AS VARCHAR), runs, tokens_saved FROM daily
  UNION ALL SELECT 'top_commands', command, runs, saved FROM top""")
def a17(spark, sf):
    parts = J.snapshot(V.runs(spark, sf), as_of=O.AS_OF)
    rows = lambda part, name, n, saved: parts[part].select(
        F.lit(part).alias("part"), name.alias("name"), n.cast("bigint").alias("runs"),
        F.col(saved).alias("tokens_saved"))
    return (
        rows("summary", F.lit("total"), F.col("total_commands"), "tokens_saved")
        .unionByName(rows("recent", F.col("id"), F.lit(1), "tokens_saved"))
        .unionByName(rows("daily", F.col("day").cast("string"), F.col("runs"), "tokens_saved"))
        .unionByName(rows("top_commands", F.col("command"), F.col("runs"), "saved"))
    )


# --- journal columns, sources and sinks -------------------------------------------

@register("p14_savings", f"WITH {O.RUNS} SELECT id, {PCT} AS savings_pct, {SAVED} AS tokens_saved FROM runs")
def p14(spark, sf):
    i, o = F.col("tokens_in"), F.col("tokens_out")
    return V.runs(spark, sf).select(
        "id", F.round(T.savings_pct(i, o), 6).alias("savings_pct"), T.tokens_saved(i, o).alias("tokens_saved"))


@register("p16_tiers", f"""WITH {O.RUNS}, p AS (SELECT id, {RAW_PCT} AS x FROM runs)
  SELECT id, CASE WHEN x >= 60 THEN 'high' WHEN x >= 20 THEN 'medium' ELSE 'low' END AS tier,
    CASE WHEN x >= 80 THEN 'Superior' WHEN x >= 60 THEN 'Strong' WHEN x >= 40 THEN 'Solid' WHEN x >= 20 THEN 'Moderate' ELSE 'Low' END AS badge,
    CASE WHEN x >= 60 THEN 'high' WHEN x >= 30 THEN 'mid' ELSE 'low' END AS badge_class FROM p""")
def p16(spark, sf):
    x = F.col("savings_pct")
    return V.runs(spark, sf).select(
        "id", L.savings_tier(x).alias("tier"), L.efficiency_badge(x).alias("badge"),
        L.efficiency_class(x).alias("badge_class"))


FULL = "'console-runner --project ' || cwd || ' ' || array_to_string(argv, ' ')"


@register("p19_labels", f"""WITH {O.RUNS}, x AS (SELECT *, {FULL} AS h, array_to_string(argv, ' ') AS c FROM runs)
  SELECT id, CASE WHEN strlen(h) > 40 THEN left(h, 37) || '...' ELSE h END AS history_label, left(c, 64) AS list_label,
    c AS table_label, argv[1] AS head, CASE WHEN exit_code = 0 THEN 'OK' ELSE 'ERR:' || exit_code END AS exit_label,
    strftime(started_at, '%m-%dT%H:%M') AS short_time FROM x""")
def p19(spark, sf):
    argv = F.col("argv")
    program = F.array(F.concat(F.lit("--project "), F.col("cwd")))
    return V.runs(spark, sf).select(
        "id", L.history_label(F.concat(program, argv), "console-runner").alias("history_label"),
        L.list_label(argv).alias("list_label"), L.table_label(argv).alias("table_label"),
        L.argv_head(argv).alias("head"), L.exit_label(F.col("exit_code")).alias("exit_label"),
        L.short_time(F.col("started_at")).alias("short_time"))


SCALED = "wall_ms * wall_ms * 13"


@register("p21_formats", f"""WITH {O.RUNS}, x AS (SELECT id, {SCALED} AS n FROM runs)
  SELECT id, format('{{:,}}', n) AS thousands,
    CASE WHEN n < 1000 THEN n || 'ms' WHEN n < 60000 THEN printf('%.1f', n / 1000e0) || 's'
         WHEN n < 3600000 THEN (n // 60000) || 'm ' || (n % 60000) // 1000 || 's'
         ELSE (n // 3600000) || 'h ' || (n % 3600000) // 60000 || 'm' END AS duration,
    {O.size_text('n')} AS size FROM x""")
def p21(spark, sf):
    n = F.col("n")
    return V.runs(spark, sf).select("id", (F.col("wall_ms") * F.col("wall_ms") * 13).alias("n")).select(
        "id", L.thousands(n).alias("thousands"), L.duration_text(n).alias("duration"), L.size_text(n).alias("size"))


@register("p23_argv_json", """SELECT CAST(event_id AS VARCHAR) AS id,
  CASE WHEN event_type = 'error' THEN props ELSE event_type || ' u' || user_id END AS command,
  CASE WHEN event_type = 'error' THEN props ELSE event_type END AS head,
  CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS n_args FROM events""")
def p23(spark, sf):
    # JSON argv as stored; rows of failed events hold an object, which is not an argv.
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.to_json(F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")))))
    rows = V.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), L.argv_from_json(raw).alias("argv"))
    return rows.select("id", L.command_line(F.col("argv")).alias("command"),
                       L.argv_head(F.col("argv")).alias("head"), F.size("argv").alias("n_args"))


INTENT_RAW = """CASE event_type WHEN 'error' THEN '  debug:test-failure ' WHEN 'view' THEN '   '
  WHEN 'click' THEN 'commit:generate' WHEN 'purchase' THEN 'refactor: ' || event_id END"""


@register("p11_intents", f"""WITH x AS (SELECT event_id, nullif(trim({INTENT_RAW}), '') AS intent FROM events)
  SELECT CAST(event_id AS VARCHAR) AS id, intent, CASE WHEN intent IS NULL THEN 'none' WHEN intent = 'debug:test-failure' THEN 'failure'
    WHEN intent = 'commit:generate' THEN 'diff' ELSE 'custom' END AS kind FROM x""")
def p11(spark, sf):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", "  debug:test-failure ").when(kind == "view", "   ")
        .when(kind == "click", "commit:generate")
        .when(kind == "purchase", F.concat(F.lit("refactor: "), F.col("event_id").cast("string"))))
    rows = V.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), L.parse_intent(raw).alias("intent"))
    return rows.withColumn("kind", L.intent_kind(F.col("intent")))


@register("s07_dedup_append", f"""WITH {O.RUNS}, stored AS (SELECT * FROM runs WHERE started_at < TIMESTAMP '2024-01-20'),
  batch AS (SELECT * FROM runs WHERE started_at >= TIMESTAMP '2024-01-10'), twice AS (SELECT * FROM batch UNION ALL SELECT * FROM batch)
  SELECT id, 'stored' AS origin, tokens_in, tokens_out FROM stored
  UNION ALL SELECT DISTINCT id, 'added', tokens_in, tokens_out FROM twice WHERE id NOT IN (SELECT id FROM stored)""")
def s07(spark, sf):
    runs = V.runs(spark, sf)
    stored = runs.filter("started_at < timestamp_ntz'2024-01-20'")
    batch = runs.filter("started_at >= timestamp_ntz'2024-01-10'")
    added = new_runs(batch.unionAll(batch), stored)
    pick = lambda df, origin: df.select("id", F.lit(origin).alias("origin"), "tokens_in", "tokens_out")
    return pick(stored, "stored").unionByName(pick(added, "added"))


WRITTEN = ["id", "tokens_in", "tokens_out", "raw_bytes", "exit_code", "is_tty"]
WRITTEN_SQL = "id, tokens_in, tokens_out, raw_bytes, exit_code, is_tty"


def _linear(runs: DataFrame) -> DataFrame:
    return runs.withColumn("archetype", F.lit(C.LINEAR))


@register("s06_written", f"WITH {O.RUNS} SELECT {WRITTEN_SQL}, {ISO} AS started_at, CAST(CAST(started_at AS DATE) AS VARCHAR) AS day FROM runs")
def s06(spark, sf):
    path = scratch_path(spark, "journal")
    append_runs(_linear(V.runs(spark, sf)), path)
    return read_journal(spark, path).select(*WRITTEN, _iso("started_at"), F.col("day").cast("string").alias("day"))


@register("s07_written", f"WITH {O.RUNS} SELECT {WRITTEN_SQL} FROM runs")
def s07_written(spark, sf):
    """Two batches that overlap, the second one twice: each run is there once."""
    path, runs = scratch_path(spark, "journal"), _linear(V.runs(spark, sf))
    append_new_runs(runs.filter("started_at < timestamp_ntz'2024-01-20'"), path)
    batch = runs.filter("started_at >= timestamp_ntz'2024-01-10'")
    append_new_runs(batch.unionAll(batch), path)
    append_new_runs(batch, path)
    return read_journal(spark, path).select(*WRITTEN)


@register("s09_two_roots", f"""WITH {O.RUNS} SELECT CASE WHEN user_half = 0 THEN 'even' ELSE 'odd' END AS root, count(*) AS runs,
  CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out
  FROM (SELECT *, CAST(right(cwd, 1) AS INT) % 2 AS user_half FROM runs) GROUP BY 1""")
def s09(spark, sf):
    """Two journals read as one, told apart by their root."""
    odd = F.right("cwd", F.lit(1)).cast("int") % 2
    runs, paths = _linear(V.runs(spark, sf)), [scratch_path(spark, "root") for _ in range(2)]
    for k, path in enumerate(paths):
        append_runs(runs.filter(odd == k), path)
    root = F.when(F.col("root") == paths[0], "even").otherwise("odd")
    return read_journal(spark, *paths).groupBy(root.alias("root")).agg(
        F.count("*").alias("runs"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@register("s08_scope", f"""WITH {O.RUNS}, r AS (SELECT * FROM runs WHERE cwd = 'proj3')
  SELECT 'proj3' AS scope, count(*) AS runs, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM r
  UNION ALL SELECT 'all', count(*), CAST(sum(tokens_in) AS BIGINT) FROM runs""")
def s08(spark, sf):
    runs = V.runs(spark, sf)
    row = lambda cwd, name: J.summary(J.in_scope(runs, cwd)).select(
        F.lit(name).alias("scope"), F.col("total_commands").alias("runs"), "tokens_in")
    return row("proj3", "proj3").unionByName(row(None, "all"))


@register("s10_daily_json", f"""WITH {O.RUNS}, {PER_DAY} SELECT '{{"day":"' || day || '","runs":' || runs || ',"tokens_in":' || tokens_in
  || ',"tokens_out":' || tokens_out || ',"tokens_saved":' || tokens_saved || '}}' AS json FROM daily""")
def s10(spark, sf):
    return reports.daily_json(_daily(spark, sf))


@register("s10b_summary_json", f"""WITH {O.RUNS}, {SUMMARY} SELECT total_commands, tokens_in AS input_tokens, tokens_out AS output_tokens,
  {SAVED} AS tokens_saved, {PCT} AS savings_pct, wall AS total_exec_ms, wall // total_commands AS avg_exec_ms FROM summary""")
def s10b(spark, sf):
    """The summary as one JSON object, read back."""
    kinds = ", ".join(f"{c} {'double' if c == 'savings_pct' else 'bigint'}" for c in reports.SUMMARY_FIELDS)
    back = reports.summary_json(J.summary(V.runs(spark, sf))).select(F.from_json("json", kinds).alias("j")).select("j.*")
    return back.withColumn("savings_pct", _r6("savings_pct"))


@register("s10c_history_json", f"""WITH {O.RUNS} SELECT id, {ISO} || 'Z' AS started_at, argv, round({RAW_PCT}, 6) AS savings_pct, {SAVED} AS tokens_saved,
  tokens_in, tokens_out, wall_ms, exit_code, log_path FROM runs ORDER BY runs.started_at DESC, id LIMIT 20""")
def s10c(spark, sf):
    """The history as JSON objects, read back."""
    kinds = ("id string, started_at string, argv array<string>, savings_pct double, tokens_saved bigint, tokens_in bigint, "
             "tokens_out bigint, wall_ms bigint, exit_code int, log_path string")
    back = reports.history_json(J.history(V.runs(spark, sf))).select(F.from_json("json", kinds).alias("j")).select("j.*")
    return back.withColumn("savings_pct", _r6("savings_pct"))


UP1 = f"""CASE WHEN ({RAW_PCT}) * 4 % 2 = 1 THEN printf('%.1f', (floor(({RAW_PCT}) * 10) + 1) / 10e0) ELSE printf('%.1f', {RAW_PCT}) END"""


@register("s11_csv_rows", f"""WITH {O.RUNS} SELECT {ISO} || 'Z' AS started_at, array_to_string(argv, ' ') AS argv, {UP1} AS savings_pct,
  tokens_in, tokens_out, {SAVED} AS tokens_saved, wall_ms, exit_code FROM runs ORDER BY runs.started_at DESC, id LIMIT 30""")
def s11(spark, sf):
    return reports.csv_rows(J.history(V.runs(spark, sf), 30))


@register("s12_footers", f"""WITH {O.RUNS} SELECT id, '{{"run":{{"version":"1","tokens_in":' || tokens_in || ',"tokens_out":' || tokens_out
  || ',"tokens_saved":' || {SAVED} || ',"savings_pct":"' || printf('%.1f', {RAW_PCT}) || '","archetype":"'
  || CASE WHEN is_tty THEN 'passthrough' ELSE 'linear-log' END || '","log_path":"' || log_path
  || '","recover_full_output":{{"command":"cat","args":["' || log_path || '"]}}}}}}' AS json FROM runs""")
def s12(spark, sf):
    kind = F.when(F.col("is_tty"), C.PASSTHROUGH).otherwise(C.LINEAR)
    return reports.footers(V.runs(spark, sf).withColumn("archetype", kind))


# --- text -------------------------------------------------------------------------

CRLF = O.conversation_texts("chr(13) || chr(10)")


@register("p01_lines", f"WITH {O.lines_of(CRLF)} SELECT run_id, line_no, line FROM lines")
def p01(spark, sf):
    return N.lines_of_texts(V.conversation_texts(spark, sf, "\r\n"), "doc_id")


@register("p02_head", f"WITH {O.LINES_DOC} SELECT run_id, line_no, line FROM lines WHERE line_no <= 3")
def p02(spark, sf):
    return N.head(V.lines_doc(spark, sf), 3)


@register("p03_not_blank", f"WITH {O.LINES_GAPS} SELECT run_id, line_no, line FROM lines WHERE regexp_matches(line, '\\S')")
def p03(spark, sf):
    return N.drop_blank_texts(V.lines_gaps(spark, sf), "line")


E = r"\x1b"


@register("p04_strip", f"""WITH {O.LINES_ANSI} SELECT run_id, line_no,
  regexp_replace(regexp_replace(line, '{E}\\[[0-9;]*[@-~]', '', 'g'), '{E}\\][^\\x07]*\\x07', '', 'g') AS text FROM lines""")
def p04(spark, sf):
    return V.lines_ansi(spark, sf).select("run_id", "line_no", ansi.strip_ansi(F.col("line")).alias("text"))


@register("p05_ansi_counts", f"""WITH {O.LINES_ANSI}, x AS (SELECT run_id, regexp_extract_all(line, '{E}\\[[0-9;]*m') AS sgr,
    regexp_extract_all(line, '{E}\\[[0-9;]*[A-Za-ln-z]') AS csi, regexp_extract_all(line, '{E}\\][^\\x07]*\\x07') AS osc,
    list_filter(string_split_regex(line, '{E}\\[[0-9;]*[A-Za-z]|{E}\\][^\\x07]*\\x07'), lambda p: p <> '') AS txt FROM lines)
  SELECT run_id, CAST(sum(len(txt)) AS BIGINT) AS text_events, CAST(sum(list_sum(list_transform(txt, lambda s: strlen(s)))) AS BIGINT) AS text_bytes,
    CAST(sum(len(sgr)) AS BIGINT) AS sgr_events, CAST(sum(list_sum(list_transform(sgr, lambda s: strlen(s)))) AS BIGINT) AS sgr_bytes,
    CAST(sum(len(csi) + len(osc)) AS BIGINT) AS control_events,
    CAST(sum(coalesce(list_sum(list_transform(csi, lambda s: strlen(s))), 0) + coalesce(list_sum(list_transform(osc, lambda s: strlen(s) + 1)), 0)) AS BIGINT) AS control_bytes
  FROM x GROUP BY run_id""")
def p05(spark, sf):
    counted = V.lines_ansi(spark, sf).select("run_id", ansi.token_counts(F.col("line")).alias("c")).select("run_id", "c.*")
    return counted.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]])


REPLAY_SQL = ansi.REPLAY.replace(r"\x5a", "Z").replace(r"\x5c", r"\x5c").replace("'", "''")


@register("p06_strip_replay", f"WITH {O.LINES_ANSI} SELECT run_id, line_no, regexp_replace(line, '{REPLAY_SQL}', '', 'g') AS text FROM lines")
def p06(spark, sf):
    return V.lines_ansi(spark, sf).select("run_id", "line_no", ansi.strip_replay(F.col("line")).alias("text"))


def _viewer_sql(x: str) -> str:
    for pattern in ansi.VIEWER_PASSES:
        x = f"regexp_replace({x}, {O.q(pattern)}, '', 'g')"
    return x


@register("p07_strip_viewer", f"WITH {O.LINES_ANSI} SELECT run_id, line_no, {_viewer_sql('line')} AS text FROM lines")
def p07(spark, sf):
    return V.lines_ansi(spark, sf).select("run_id", "line_no", ansi.strip_viewer(F.col("line")).alias("text"))


def _fingerprints(lines: DataFrame) -> DataFrame:
    return lines.select("run_id", "line_no", fingerprint(F.col("line")).alias("fp"))


@register("p08_fingerprint", f"WITH {O.LINES_DOC} SELECT run_id, line_no, {O.fp('line')} AS fp FROM lines")
def p08(spark, sf):
    return _fingerprints(V.lines_doc(spark, sf))


@register("p08b_fingerprint_log", f"WITH {O.LINES_LOG} SELECT run_id, line_no, {O.fp('line')} AS fp FROM lines")
def p08b(spark, sf):
    return _fingerprints(V.lines_log(spark, sf))


def _redact_sql(texts: str, key: str, out: str, gate: str = "true") -> str:
    ctes, prev = [], "texts"
    for i, (name, pattern) in enumerate(R.PATTERNS):
        ctes.append(
            f"r{i} AS (SELECT * REPLACE (CASE WHEN {gate} THEN regexp_replace(text, {O.q(pattern)}, '[REDACTED: {name}]', 'g') ELSE text END AS text), "
            f"CASE WHEN {gate} THEN len(regexp_extract_all(text, {O.q(pattern)})) ELSE 0 END AS {R.hits_column(name)} FROM {prev})")
        prev = f"r{i}"
    hits = [R.hits_column(name) for name, _ in R.PATTERNS]
    cols = {"texts": f"{key}, text AS redacted, CAST({' + '.join(hits)} AS BIGINT) AS hits",
            "counts": ", ".join(f"CAST(sum({h}) AS BIGINT) AS {h}" for h in hits)
                      + f", CAST(sum({' + '.join(hits)}) AS BIGINT) AS hits"}[out]
    return f"WITH {texts}, {', '.join(ctes)} SELECT {cols} FROM {prev}"


SECRETS_SQL = """texts AS (SELECT event_id AS doc_id, CASE event_type
  WHEN 'view' THEN 'push with ghp_' || md5('a' || event_id) || 'Ab0_ done'
  WHEN 'click' THEN 'key in use: sk-' || md5('b' || event_id) || ' and token=ghp_' || md5('c' || event_id) || 'Zz9_'
  WHEN 'error' THEN 'denied for AKIA' || upper(left(md5('d' || event_id), 16)) || chr(10) || '-----BEGIN RSA KEY-----' || chr(10) || 'password: ' || user_id
  WHEN 'purchase' THEN 'cookie eyJ' || md5('e' || event_id) || '.' || md5('f' || event_id) || '.' || md5('g' || event_id)
  ELSE 'Authorization: Bearer ' || md5('h' || event_id) || ' API_KEY = ''' || md5('i' || event_id) || '''' END AS text FROM events)"""


def _secrets(spark, sf):
    kind, eid = F.col("event_type"), F.col("event_id").cast("string")
    h = lambda salt: F.md5(F.concat(F.lit(salt), eid))
    text = (
        F.when(kind == "view", F.concat(F.lit("push with ghp_"), h("a"), F.lit("Ab0_ done")))
        .when(kind == "click", F.concat(F.lit("key in use: sk-"), h("b"), F.lit(" and token=ghp_"), h("c"), F.lit("Zz9_")))
        .when(kind == "error", F.concat(
            F.lit("denied for AKIA"), F.upper(F.left(h("d"), F.lit(16))), F.lit("\n-----BEGIN RSA KEY-----\npassword: "),
            F.col("user_id").cast("string")))
        .when(kind == "purchase", F.concat(F.lit("cookie eyJ"), h("e"), F.lit("."), h("f"), F.lit("."), h("g")))
        .otherwise(F.concat(F.lit("Authorization: Bearer "), h("h"), F.lit(" API_KEY = '"), h("i"), F.lit("'"))))
    return V.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), text.alias("text"))


def _redacted(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "redacted", "hits")


@register("p09_redact", _redact_sql(O.DOCUMENTS, "doc_id", "texts"))
def p09(spark, sf):
    return _redacted(R.redact(V.documents(spark, sf)))


def _hit_totals(df: DataFrame) -> DataFrame:
    hits = [R.hits_column(name) for name, _ in R.PATTERNS] + ["hits"]
    return df.agg(*[F.sum(h).alias(h) for h in hits])


@register("p09b_redact_counts", _redact_sql(O.DOCUMENTS, "doc_id", "counts"))
def p09b(spark, sf):
    return _hit_totals(R.redact(V.documents(spark, sf)))


@register("p09c_redact_secrets", _redact_sql(SECRETS_SQL, "doc_id", "texts"))
def p09c(spark, sf):
    return _redacted(R.redact(_secrets(spark, sf)))


@register("p09d_secret_counts", _redact_sql(SECRETS_SQL, "doc_id", "counts"))
def p09d(spark, sf):
    return _hit_totals(R.redact(_secrets(spark, sf)))


@register("p10_redact_gate", _redact_sql(
    "texts AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'on' ELSE 'off' END AS setting FROM documents)",
    "doc_id", "texts", "setting IN ('1', 'on', 'true', 'yes')"))
def p10(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id", "text", F.when(F.col("lang") == "en", "on").otherwise("off").alias("setting"))
    return _redacted(R.redact(docs, mode=F.col("setting")))


@register("p12_tokens", f"SELECT doc_id, {O.tokens('strlen(text)')} AS tokens FROM documents")
def p12(spark, sf):
    return V.documents(spark, sf).select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


# --- classification ---------------------------------------------------------------

VIEWS: dict[str, tuple[Query, str]] = {
    "log": (V.lines_log, O.LINES_LOG), "table": (V.lines_table, O.LINES_TABLE),
    "tree": (V.lines_tree, O.LINES_TREE), "diff": (V.lines_diff, O.LINES_DIFF),
    "doc": (V.lines_doc, O.LINES_DOC), "gaps": (V.lines_gaps, O.LINES_GAPS),
}


@register("c01_sample", f"WITH {O.LINES_LOG} SELECT run_id, line_no, line FROM lines WHERE line_no <= 20")
def c01(spark, sf):
    return N.head(V.lines_log(spark, sf), K.DEFAULTS.sample_lines)


def _score_query(name: str, view: str, column: str):
    build, sql = VIEWS[view]

    @register(name, f"WITH {sql}, {O.classified()} SELECT run_id, round({column}, 6) AS {column} FROM facts")
    def score(spark, sf):
        samples = C.with_scores(C.run_samples(build(spark, sf)))
        return samples.select("run_id", _r6(column))


_score_query("c02_tabular_score", "table", "tabular_score")
_score_query("c03_tree_score", "tree", "tree_score")
_score_query("c04_linear_score", "log", "linear_score")


def _archetype_query(view: str):
    build, sql = VIEWS[view]
    scores = "round(tabular_score, 6) AS tabular_score, round(tree_score, 6) AS tree_score, round(linear_score, 6) AS linear_score"

    @register(f"c05_archetype_{view}", f"WITH {sql}, {O.classified()} SELECT run_id, n_lines, n_bytes, {scores}, archetype FROM facts")
    def archetypes(spark, sf):
        return C.classify_runs(build(spark, sf)).select(
            "run_id", "n_lines", "n_bytes", _r6("tabular_score"), _r6("tree_score"), _r6("linear_score"), "archetype")

    @register(f"k18_census_{view}", f"""WITH {sql}, {O.classified()} SELECT archetype, count(*) AS runs, CAST(sum(n_lines) AS BIGINT) AS lines,
      CAST(sum(n_bytes) AS BIGINT) AS bytes, CAST(sum({O.tokens('n_bytes')}) AS BIGINT) AS tokens FROM facts GROUP BY archetype""")
    def census(spark, sf):
        return M.census(C.classify_runs(build(spark, sf)))


for _view in VIEWS:
    _archetype_query(_view)


# --- compaction -------------------------------------------------------------------

def _compact_query(name: str, view: str, force: str | None = None):
    build, sql = VIEWS[view]

    @register(name, O.out_lines(sql, force))
    def compacted(spark, sf):
        return K.number_lines(K.compact_lines(build(spark, sf), force=force))


_compact_query("k01_tabular", "table", C.TABULAR)
_compact_query("k03_linear", "log", C.LINEAR)
_compact_query("k03b_linear_doc", "doc", C.LINEAR)
_compact_query("k05_tree", "tree", C.TREE)
_compact_query("k05b_tree_diff", "diff", C.TREE)
_compact_query("k07_passthrough", "gaps", C.PASSTHROUGH)
for _view in VIEWS:
    _compact_query(f"k08_compact_{_view}", _view)


@register("k02_distribution", f"""WITH {O.LINES_TABLE}, {O.classified()}, {O.compacted(C.TABULAR)}
  SELECT run_id, line FROM outl WHERE ord = 9 AND run_id IN (SELECT run_id FROM routed WHERE route = 'tabular')""")
def k02(spark, sf):
    done = K.compact_lines(V.lines_table(spark, sf), force=C.TABULAR)
    return done.lines.filter(F.col("ord") == K.FOLD_ORD).select("run_id", "line")


@register("k04_tail", f"""WITH {O.LINES_LOG}, {O.classified()}, {O.compacted(C.LINEAR)}
  SELECT run_id, ord // 2 AS line_no, line FROM outl o WHERE ord > (SELECT 2 * (n_lines - 5) FROM routed r WHERE r.run_id = o.run_id AND r.route = 'linear-log')""")
def k04(spark, sf):
    done = K.compact_lines(V.lines_log(spark, sf), force=C.LINEAR)
    cuts = done.runs.filter(F.col("route") == C.LINEAR).select("run_id", (2 * (F.col("n_lines") - 5)).alias("cut"))
    return done.lines.join(cuts, "run_id").filter(F.col("ord") > F.col("cut")).select(
        "run_id", K.div(F.col("ord"), 2).alias("line_no"), "line")


def _failure_intent(lines: DataFrame) -> DataFrame:
    return lines.select("run_id", F.lit(L.FAILURE_INTENT).alias("intent")).distinct()


@register("k09_failure_focus", f"""WITH {O.LINES_LOG}, {O.classified()}, {O.compacted()}, {O.NUMBERED}, {O.focused('numbered_out')}
  SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY out_no) AS BIGINT) AS out_no, line FROM focus""")
def k09(spark, sf):
    lines = V.lines_log(spark, sf)
    return K.number_lines(K.compact_lines(lines, intent=_failure_intent(lines)))


NUMBERED_LINES = "nl AS (SELECT run_id, line_no AS out_no, line FROM lines)"


@register("k09b_focus_raw", f"WITH {O.LINES_DOC}, {NUMBERED_LINES}, {O.focused('nl')} SELECT run_id, out_no, line FROM focus")
def k09b(spark, sf):
    return I.focus_failures(V.lines_doc(spark, sf).withColumnRenamed("line_no", "out_no"))


@register("k09c_focus_log", f"WITH {O.LINES_LOG}, {NUMBERED_LINES}, {O.focused('nl')} SELECT run_id, out_no, line FROM focus")
def k09c(spark, sf):
    return I.focus_failures(V.lines_log(spark, sf).withColumnRenamed("line_no", "out_no"))


@register("k10_diff_strip", f"""WITH {O.LINES_DIFF}, {O.classified()}, {O.compacted()}, kept AS (SELECT * FROM outl
  WHERE starts_with(line, '+++') OR starts_with(line, '---') OR starts_with(line, 'diff ')
     OR NOT (starts_with(line, '+') OR starts_with(line, '-') OR starts_with(line, '@@')))
  SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ord) AS BIGINT) AS out_no, line FROM kept""")
def k10(spark, sf):
    lines = V.lines_diff(spark, sf)
    intent = lines.select("run_id", F.lit(L.DIFF_INTENT).alias("intent")).distinct()
    return K.number_lines(K.compact_lines(lines, intent=intent))


@register("k11_custom_intent", O.out_lines(O.LINES_TABLE))
def k11(spark, sf):
    lines = V.lines_table(spark, sf)
    intent = lines.select("run_id", F.lit("refactor:extract").alias("intent")).distinct()
    return K.number_lines(K.compact_lines(lines, intent=intent))


def _texts_out(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(F.col(key).alias("run_id"), "archetype", "compacted", "tokens_in", "tokens_out")


@register("k08_compact_texts", f"WITH {O.texts_compacted(O.DOCUMENTS)} SELECT run_id, archetype, compacted, {O.TOKEN_COLUMNS} FROM done")
def k08_texts(spark, sf):
    return _texts_out(W.compact_texts(V.documents(spark, sf)))


PARAGRAPHS = f"""{O.lines_of(O.conversation_texts('chr(10) || chr(10)'))},
marked AS (SELECT *, NOT regexp_matches(line, '\\S') AS blank FROM lines),
placed AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY run_id ORDER BY line_no) AS sec FROM marked),
glue AS (SELECT run_id, sec, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text
         FROM placed WHERE NOT blank GROUP BY run_id, sec)"""
WINDOWS5 = f"""{O.LINES_DOC}, glue AS (SELECT run_id, (line_no - 1) // 5 AS sec,
  regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text FROM lines GROUP BY 1, 2)"""


def _section_sql(glue: str) -> str:
    """Compaction of sections: each (document, section) pair is a run of its own."""
    texts = "texts AS (SELECT run_id || '/' || sec AS doc_id, text FROM glue WHERE text <> '')"
    return f"WITH {glue}, sections AS (WITH {O.texts_compacted(texts)} SELECT * FROM done)"


DISTILLED = f"SELECT regexp_extract(run_id, '^[^/]+') AS doc_id, archetype, text, compacted, {O.TOKEN_COLUMNS} FROM sections"
DISTILL_TOTALS = f"""SELECT doc_id, count(*) AS sections, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out, greatest(CAST(sum(tokens_in) - sum(tokens_out) AS BIGINT), 0) AS tokens_saved,
  {O.pct('sum(tokens_in)', 'sum(tokens_out)')} AS savings_pct FROM ({DISTILLED}) GROUP BY doc_id"""


def _distilled(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("string").alias("doc_id"), "archetype", "text", "compacted",
                     "tokens_in", "tokens_out")


def _distill_totals(df: DataFrame) -> DataFrame:
    return W.distill_report(df, "doc_id").withColumns(
        {"doc_id": F.col("doc_id").cast("string"), "savings_pct": F.round("savings_pct", 6)})


@register("k12_distill_paragraphs", f"{_section_sql(PARAGRAPHS)} {DISTILLED}")
def k12(spark, sf):
    return _distilled(W.distill(V.conversation_texts(spark, sf), "doc_id"))


@register("k12b_distill_totals", f"{_section_sql(PARAGRAPHS)} {DISTILL_TOTALS}")
def k12b(spark, sf):
    return _distill_totals(W.distill(V.conversation_texts(spark, sf), "doc_id"))


@register("k13_distill_windows", f"{_section_sql(WINDOWS5)} {DISTILLED}")
def k13(spark, sf):
    return _distilled(W.distill(V.documents(spark, sf), "doc_id", window_lines=5))


@register("k13b_window_totals", f"{_section_sql(WINDOWS5)} {DISTILL_TOTALS}")
def k13b(spark, sf):
    return _distill_totals(W.distill(V.documents(spark, sf), "doc_id", window_lines=5))


# The lines form of the same: sections found line by line, no text built.
PARAGRAPH_LINES = f"""{O.lines_of(O.conversation_texts('chr(10) || chr(10)')).replace('lines AS (', 'whole AS (')},
flagged AS (SELECT *, NOT regexp_matches(line, '\\S') AS blank, lag(NOT regexp_matches(line, '\\S')) OVER (PARTITION BY run_id ORDER BY line_no) AS after
            FROM whole),
placed AS (SELECT *, count(*) FILTER (NOT blank AND after AND line_no >= 3) OVER (PARTITION BY run_id ORDER BY line_no) AS sec FROM flagged)"""
WINDOW_LINES = f"""{O.LINES_DOC.replace('lines AS (', 'whole AS (')},
placed AS (SELECT *, (line_no - 1) // 5 AS sec, NOT regexp_matches(line, '\\S') AS blank FROM whole)"""
SECTION_LINES = """spans AS (SELECT run_id, sec, min(line_no) AS a, max(line_no) AS z FROM placed WHERE NOT blank GROUP BY run_id, sec),
cut AS (SELECT run_id || '/' || sec AS run_id, line_no - a + 1 AS line_no,
               CASE WHEN line_no = a THEN regexp_replace(line, '^\\s+', '') ELSE line END AS line, line_no = z AS final
        FROM placed JOIN spans USING (run_id, sec) WHERE line_no BETWEEN a AND z),
lines AS (SELECT run_id, line_no, CASE WHEN final THEN regexp_replace(line, '\\s+$', '') ELSE line END AS line FROM cut)"""
SECTION_BYTES = """SELECT run_id, CAST(sum(strlen(line)) + count(*) - 1 AS BIGINT) AS n_bytes, false AS ends_newline FROM lines GROUP BY run_id"""


def _section_lines_sql(placed: str) -> str:
    return f"""WITH {placed}, {SECTION_LINES}, {O.classified(SECTION_BYTES)}, {O.compacted()}, {O.NUMBERED}
SELECT regexp_extract(run_id, '^[^/]+') AS doc_id, CAST(regexp_extract(run_id, '[^/]+$') AS BIGINT) AS section_no, out_no, line FROM numbered_out"""


def _section_lines(done: K.Compacted) -> DataFrame:
    return K.number_lines(done).select(F.col("run_id.doc").cast("string").alias("doc_id"), F.col("run_id.section_no").alias("section_no"), "out_no", "line")


def _line_totals(done: K.Compacted) -> DataFrame:
    return D.distill_lines_report(done).withColumns({"doc_id": F.col("doc_id").cast("string"), "savings_pct": F.round("savings_pct", 6)})


@register("k12c_paragraph_lines", _section_lines_sql(PARAGRAPH_LINES))
def k12c(spark, sf):
    return _section_lines(D.distill_lines(V.lines_turns(spark, sf)))


@register("k12d_paragraph_line_totals", f"{_section_sql(PARAGRAPHS)} {DISTILL_TOTALS}")
def k12d(spark, sf):
    return _line_totals(D.distill_lines(V.lines_turns(spark, sf)))


@register("k13c_window_lines", _section_lines_sql(WINDOW_LINES))
def k13c(spark, sf):
    return _section_lines(D.distill_lines(V.lines_doc(spark, sf), 5))


@register("k13d_window_line_totals", f"{_section_sql(WINDOWS5)} {DISTILL_TOTALS}")
def k13d(spark, sf):
    return _line_totals(D.distill_lines(V.lines_doc(spark, sf), 5))


@register("k14_replay", f"""WITH raw AS (SELECT CAST(conv_id AS VARCHAR) AS run_id,
    string_agg(chr(27) || '[1m' || role || chr(27) || '[0m ' || text, chr(10) ORDER BY turn) || chr(10) AS raw
    FROM conversations GROUP BY conv_id HAVING starts_with(CAST(conv_id AS VARCHAR), '1')),
  {O.texts_compacted(f"texts AS (SELECT run_id AS doc_id, regexp_replace(raw, '{REPLAY_SQL}', '', 'g') AS text FROM raw)")}
  SELECT run_id, archetype, compacted, {O.TOKEN_COLUMNS}, CASE WHEN count(*) OVER () = 1 THEN 'one' ELSE 'many' END AS outcome FROM done""")
def k14(spark, sf):
    return log_files.replay_each(_conversation_logs(spark, sf), "1").select(
        "run_id", "archetype", "compacted", "tokens_in", "tokens_out", "outcome")


def _conversation_logs(spark, sf) -> DataFrame:
    turns = V.table(spark, sf, "conversations").withColumn("text", F.concat(
        F.lit("\x1b[1m"), "role", F.lit("\x1b[0m "), "text"))
    logs = turns.groupBy(F.col("conv_id").cast("string").alias("run_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select(
        "run_id", F.concat(F.array_join(F.transform("t", lambda t: t["text"]), "\n"), F.lit("\n")).cast("binary").alias("data"))
    return logs


RAW_LOGS = """raw AS (SELECT CAST(conv_id AS VARCHAR) AS run_id,
    string_agg(chr(27) || '[1m' || role || chr(27) || '[0m ' || text, chr(10) ORDER BY turn) || chr(10) AS raw FROM conversations GROUP BY conv_id)"""


@register("k14b_replay_one", f"""WITH {RAW_LOGS}, last_run AS (SELECT * FROM raw WHERE starts_with(run_id, (SELECT max(run_id) FROM raw))),
  {O.texts_compacted(f"texts AS (SELECT run_id AS doc_id, regexp_replace(raw, '{REPLAY_SQL}', '', 'g') AS text FROM last_run)")}
  SELECT run_id, archetype, compacted, {O.TOKEN_COLUMNS}, 'one' AS outcome FROM done""")
def k14b(spark, sf):
    """The log with the greatest id: no other id starts with it."""
    logs = _conversation_logs(spark, sf)
    prefix = V.table(spark, sf, "conversations").agg(F.max(F.col("conv_id").cast("string"))).scalar()
    return log_files.replay(logs, logs.sparkSession.range(1).select(prefix).first()[0]).select(
        "run_id", "archetype", "compacted", "tokens_in", "tokens_out", "outcome")


@register("k14c_replay_listing", f"""WITH {RAW_LOGS} SELECT run_id, CAST(strlen(raw) AS BIGINT) AS length, 'many' AS outcome
  FROM raw WHERE starts_with(run_id, '1')""")
def k14c(spark, sf):
    return log_files.replay(_conversation_logs(spark, sf), "1").select("run_id", "length", "outcome")


def _report_query(view: str):
    build, sql = VIEWS[view]

    @register(f"k15_savings_{view}", O.report(sql))
    def savings(spark, sf):
        return K.report(K.compact_lines(build(spark, sf))).withColumn("savings_pct", F.round("savings_pct", 6))


for _view in VIEWS:
    _report_query(_view)


@register("k15b_savings_by_archetype", f"""SELECT archetype, count(*) AS runs, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out, greatest(CAST(sum(tokens_in) - sum(tokens_out) AS BIGINT), 0) AS tokens_saved,
  {O.pct('sum(tokens_in)', 'sum(tokens_out)')} AS savings_pct FROM ({O.report(O.LINES_TABLE)}) GROUP BY archetype""")
def k15b(spark, sf):
    return M.savings_by_archetype(K.report(K.compact_lines(V.lines_table(spark, sf))))


@register("k16_tty_bypass", f"""WITH {O.RUNS} SELECT id, CASE WHEN is_tty THEN {O.tokens('raw_bytes')} ELSE tokens_in END AS tokens_in,
  CASE WHEN is_tty THEN {O.tokens('raw_bytes')} ELSE tokens_out END AS tokens_out,
  CASE WHEN is_tty THEN 0e0 ELSE {PCT} END AS savings_pct, CASE WHEN is_tty THEN 'passthrough' ELSE 'linear-log' END AS archetype FROM runs""")
def k16(spark, sf):
    return K.tty_bypass(V.runs(spark, sf).withColumn("archetype", F.lit(C.LINEAR))).select(
        "id", "tokens_in", "tokens_out", _r6("savings_pct"), "archetype")


def _template_query(name: str, view: str, top: int | None):
    build, sql = VIEWS[view]
    tail = f"ORDER BY lines DESC, template LIMIT {top}" if top else ""

    @register(name, f"""WITH {sql}, f AS (SELECT *, {O.fp('line')} AS template FROM lines),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY run_id, line_no) AS rn FROM f),
      g AS (SELECT template, count(*) AS lines, count(DISTINCT run_id) AS runs FROM f GROUP BY template)
      SELECT g.template, lines, runs, run_id AS first_run, line_no AS first_line_no, line AS sample
      FROM g JOIN firsts x ON g.template = x.template AND rn = 1 {tail}""")
    def mined(spark, sf):
        lines = build(spark, sf)
        return M.top_templates(lines, top) if top else M.templates(lines)


_template_query("k17_templates", "log", None)
_template_query("k17b_templates_doc", "doc", None)
_template_query("k17c_top_templates", "diff", 20)


# --- log files ---------------------------------------------------------------------

def _region_logs(spark, sf) -> str:
    """A log file for each region, from the listing of its suppliers."""
    folder = scratch_path(spark, "log-files")
    lines = V.lines_tree(spark, sf).repartition("run_id").sortWithinPartitions("run_id", "line_no")
    lines.select("run_id", "line").write.partitionBy("run_id").text(folder)
    return folder


def _region() -> Column:
    return F.regexp_extract("path", "run_id=([^/]+)", 1)


TEXT_RUN = "SELECT CAST(run_id AS VARCHAR) AS run_id"


@register("s01_log_lines", f"WITH {O.LINES_TREE} {TEXT_RUN}, line_no, line FROM lines")
def s01(spark, sf):
    return log_files.scan_lines(spark, _region_logs(spark, sf), "*.txt", _region()).lines.select("run_id", "line_no", "line")


@register("s01b_log_sizes", f"WITH {O.LINES_TREE} {TEXT_RUN}, count(*) AS n_lines, CAST(sum(strlen(line)) + count(*) AS BIGINT) AS n_bytes, true AS ends_newline FROM lines GROUP BY 1")
def s01b(spark, sf):
    return log_files.scan_lines(spark, _region_logs(spark, sf), "*.txt", _region()).runs.drop("path")


@register("s01c_log_savings", f"SELECT * REPLACE (CAST(run_id AS VARCHAR) AS run_id) FROM ({O.report(O.LINES_TREE)})")
def s01c(spark, sf):
    lines = log_files.scan_lines(spark, _region_logs(spark, sf), "*.txt", _region()).lines
    return K.report(K.compact_lines(lines)).withColumn("savings_pct", F.round("savings_pct", 6))


@register("s02_file_heads", f"""WITH {O.LINES_TREE} {TEXT_RUN}, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM lines WHERE line_no <= 50 GROUP BY 1""")
def s02(spark, sf):
    texts = log_files.read_texts(spark, f"{_region_logs(spark, sf)}/*/*.txt", head=50)
    return texts.select(_region().alias("run_id"), "text")


@register("s03_file_distill", f"""WITH {O.LINES_TREE}, joined AS (SELECT CAST(run_id AS VARCHAR) AS run_id, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS text
    FROM lines GROUP BY 1), {O.texts_compacted("texts AS (SELECT run_id AS doc_id, text FROM joined)").replace("lines AS (", "lines2 AS (", 1).replace("FROM lines ", "FROM lines2 ").replace("FROM lines)", "FROM lines2)")}
  SELECT run_id, archetype, compacted, {O.TOKEN_COLUMNS} FROM done""")
def s03(spark, sf):
    done = log_files.compact_files(spark, f"{_region_logs(spark, sf)}/*/*.txt")
    return done.select(_region().alias("run_id"), "archetype", "compacted", "tokens_in", "tokens_out")


# --- streams ----------------------------------------------------------------------

def _numbered_with_end(spark, sf) -> DataFrame:
    """Log lines with run ids as text and the last line of each run marked."""
    return V.lines_log_ends(spark, sf).select(F.col("run_id").cast("string").alias("run_id"), "line_no", "line", "is_last")


def _stored(df: DataFrame, name: str, batches: int, *keys: Column | str) -> tuple[str, DataFrame, int]:
    """Path and rows of a table in files for so many micro-batches, and the files of one; every core writes one of them."""
    path, files = scratch_path(df.sparkSession, name), max(1, df.sparkSession.sparkContext.defaultParallelism)
    df.repartition(batches * files, *keys).write.parquet(path)
    return path, df.sparkSession.read.parquet(path), files


def _windows_sql(size: int) -> str:
    key = "CAST(run_id AS VARCHAR) || '/' || ((line_no - 1) // {n})".format(n=size)
    texts = f"texts AS (SELECT {key} AS doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n_lines FROM lines GROUP BY 1)"
    return f"""WITH {O.LINES_LOG}, wins AS ({texts.split(' AS (', 1)[1][:-1]}),
      done2 AS (WITH {O.texts_compacted("texts AS (SELECT doc_id, text FROM wins)")} SELECT * FROM done),
      x AS (SELECT string_split(run_id, '/') AS k, w.n_lines, archetype, compacted, d.text FROM done2 d JOIN wins w ON w.doc_id = d.run_id)
    SELECT k[1] AS run_id, CAST(k[2] AS BIGINT) AS window_no, n_lines,
      CASE WHEN k[2] = '0' AND n_lines < 20 THEN NULL ELSE archetype END AS archetype,
      CASE WHEN k[2] = '0' AND n_lines < 20 THEN text ELSE compacted END AS compacted FROM x"""


WINDOW = 25


def _window_columns(df: DataFrame) -> DataFrame:
    return df.select("run_id", "window_no", F.col("n_lines").cast("bigint").alias("n_lines"), "archetype", "compacted")


@register("st01_batch_windows", _windows_sql(WINDOW))
def st01_batch(spark, sf):
    lines = V.lines_log(spark, sf).withColumn("run_id", F.col("run_id").cast("string"))
    return _window_columns(S.compact_windows(S.batch_windows(lines, window=WINDOW)))


@register("st01_stream_windows", _windows_sql(WINDOW))
def st01_stream(spark, sf):
    path, stored, files = _stored(_numbered_with_end(spark, sf), "lines", 3)
    out = scratch_path(spark, "windows")
    stream = live.read_stream(spark, path, stored.schema, files_per_batch=files)
    live.start_window_compaction(stream, out, f"{out}-checkpoint", window=WINDOW, once=True).awaitTermination()
    return _windows_of(spark, out)


def _windows_of(spark, out: str) -> DataFrame:
    return _window_columns(spark.read.schema(
        "run_id string, window_no bigint, n_lines int, archetype string, compacted string").parquet(f"{out}/windows"))


def _locked_sql(size: int) -> str:
    """Windows after the first one get its archetype, unless they are short."""
    lock = """shape AS (SELECT f.* REPLACE (CASE WHEN f.is_short THEN f.archetype ELSE coalesce(a.archetype, f.archetype) END AS archetype)
      FROM facts f LEFT JOIN (SELECT split_part(run_id, '/', 1) AS run, archetype FROM facts WHERE split_part(run_id, '/', 2) = '0' AND n_lines >= 20) a
        ON a.run = split_part(f.run_id, '/', 1))"""
    free = "shape AS (SELECT * FROM facts)"
    sql = _windows_sql(size)
    assert free in sql
    own = "CASE WHEN k[2] = '0' AND n_lines < 20 THEN NULL ELSE archetype END AS archetype"
    assert own in sql
    first = "first_value(CASE WHEN n_lines < 20 THEN NULL ELSE archetype END) OVER (PARTITION BY k[1] ORDER BY CAST(k[2] AS BIGINT)) AS archetype"
    return sql.replace(free, lock).replace(own, first)


@register("st04_locked_stream", _locked_sql(WINDOW))
def st04(spark, sf):
    path, stored, files = _stored(_numbered_with_end(spark, sf), "lines", 3)
    out = scratch_path(spark, "locked")
    stream = live.read_stream(spark, path, stored.schema, files_per_batch=files)
    live.start_window_compaction(stream, out, f"{out}-checkpoint", window=WINDOW, once=True, lock=True).awaitTermination()
    return _windows_of(spark, out)


def _chunks(spark, sf) -> DataFrame:
    """Log text in chunks that begin ten bytes into one line and end ten bytes into the next."""
    lines = _numbered_with_end(spark, sf)
    head = lines.select(F.col("run_id").alias("h_run"), (F.col("line_no") - 1).alias("h_no"), F.left("line", F.lit(10)).alias("head"))
    rest = lines.select("run_id", F.col("line_no").alias("chunk_no"), F.concat(F.expr("substring(line, 11)"), F.lit("\n")).alias("rest"), "is_last")
    same = F.col("run_id").eqNullSafe(F.col("h_run")) & (F.col("chunk_no") == F.col("h_no"))
    nothing = F.lit("")
    return rest.join(head, same, "full_outer").select(
        F.coalesce("run_id", "h_run").alias("run_id"), F.coalesce("chunk_no", "h_no").alias("chunk_no"),
        F.concat(F.coalesce("rest", nothing), F.coalesce("head", nothing)).cast("binary").alias("data"),
        F.coalesce("is_last", F.lit(False)).alias("is_last"))


@register("st08_chunk_lines", f"WITH {O.LINES_LOG} SELECT CAST(run_id AS VARCHAR) AS run_id, line_no, line FROM lines")
def st08_lines(spark, sf):
    return live_chunks.lines_of_chunks(_chunks(spark, sf))


@register("st08b_chunk_stream", _windows_sql(WINDOW))
def st08_stream(spark, sf):
    path, files = scratch_path(spark, "chunks"), max(1, spark.sparkContext.defaultParallelism)
    # Three parts in chunk order, as a live source would deliver them, each written by all cores.
    bounds = F.when(F.col("chunk_no") < 11, 0).when(F.col("chunk_no") < 47, 1).otherwise(2)
    source = stash(_chunks(spark, sf), "chunk-source").withColumn("part", bounds)
    for part in range(3):
        source.filter(F.col("part") == part).drop("part").repartition(files).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    out = scratch_path(spark, "chunk-windows")
    stream = live.read_stream(spark, path, schema, files_per_batch=files)
    live.start_chunk_compaction(stream, out, f"{out}-checkpoint", window=WINDOW, once=True).awaitTermination()
    return _window_columns(spark.read.schema(
        "run_id string, window_no bigint, n_lines int, archetype string, compacted string").parquet(f"{out}/windows"))


@register("st08c_shuffled_stream", _windows_sql(WINDOW))
def st08_shuffled(spark, sf):
    """Chunks dealt over three micro-batches by a hash, in any order."""
    path, stored, files = _stored(_chunks(spark, sf), "chunks", 3, F.xxhash64("run_id", "chunk_no"))
    out = scratch_path(spark, "chunk-windows")
    stream = live.read_stream(spark, path, stored.schema, files_per_batch=files)
    live.start_chunk_compaction(stream, out, f"{out}-checkpoint", window=WINDOW, once=True).awaitTermination()
    return _windows_of(spark, out)


@register("st08d_waiting_chunks", f"""WITH {O.LINES_LOG}, n AS (SELECT run_id, count(*) AS n FROM lines GROUP BY run_id)
  SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(7 AS BIGINT) AS next_chunk, n - 7 AS n_waiting, CAST(8 AS BIGINT) AS first_waiting FROM n WHERE n >= 8""")
def st08_waiting(spark, sf):
    """A run of n lines has chunks 0 to n here; without chunk 7, those from 8 on wait."""
    path, stored, files = _stored(_chunks(spark, sf).filter("chunk_no <> 7"), "chunks", 2, F.xxhash64("run_id", "chunk_no"))
    out = scratch_path(spark, "chunk-windows")
    stream = live.read_stream(spark, path, stored.schema, files_per_batch=files)
    live.start_chunk_compaction(stream, out, f"{out}-checkpoint", window=WINDOW, once=True).awaitTermination()
    return live_chunks.ChunkCompactor(out, window=WINDOW).waiting(spark)


TTY_RUN = "CAST(run_id AS BIGINT) % 10 = 0"


@register("st06_journal_rows", f"""WITH r AS ({O.report(O.LINES_LOG)})
  SELECT CAST(run_id AS VARCHAR) AS id, n_bytes AS raw_bytes, tokens_in, CASE WHEN {TTY_RUN} THEN tokens_in ELSE tokens_out END AS tokens_out,
    CASE WHEN {TTY_RUN} THEN 0e0 ELSE savings_pct END AS savings_pct, CASE WHEN {TTY_RUN} THEN 'passthrough' ELSE archetype END AS archetype,
    {TTY_RUN} AS is_tty, CAST(60000 AS BIGINT) AS wall_ms FROM r""")
def st06_journal(spark, sf):
    """Runs that end in a stream of chunks become journal rows, once each, though their chunks come twice."""
    journal, out = (scratch_path(spark, n) for n in ("journal", "recorded"))
    chunks = stash(_chunks(spark, sf), "chunk-source")
    path, stored, files = _stored(chunks, "chunks", 2, F.xxhash64("run_id", "chunk_no"))
    # A third micro-batch, whatever the size of the tables.
    chunks.filter("chunk_no % 3 = 0").repartition(files).write.mode("append").parquet(path)
    ids = V.table(spark, sf, "events").select(F.col("user_id").alias("u")).distinct()
    begun = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    runs = ids.select(
        F.col("u").cast("string").alias("id"), F.array(F.lit("job"), F.col("u").cast("string")).alias("argv"), F.lit("/srv").alias("cwd"),
        begun.alias("started_at"), (begun + F.make_dt_interval(mins=F.lit(1))).alias("finished_at"), F.lit(0).alias("exit_code"),
        F.lit("logs/x.log").alias("log_path"), F.lit(None).cast("string").alias("intent"), (F.col("u") % 10 == 0).alias("is_tty"))
    stream = live.read_stream(spark, path, stored.schema, files_per_batch=files)
    live.start_chunk_compaction(stream, out, f"{out}-checkpoint", window=WINDOW, once=True, runs=runs, journal=journal).awaitTermination()
    return read_journal(spark, journal).select("id", "raw_bytes", "tokens_in", "tokens_out", _r6("savings_pct"), "archetype", "is_tty", "wall_ms")


@register("st06_raw_totals", f"WITH {O.LINES_LOG} SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(sum(strlen(line)) + count(*) AS BIGINT) AS raw_bytes FROM lines GROUP BY run_id")
def st06(spark, sf):
    path, stored, files = _stored(_chunks(spark, sf), "raw-chunks", 2)
    out = scratch_path(spark, "raw")
    stream = live.read_stream(spark, path, stored.schema, files_per_batch=files)
    live.start_raw_sink(stream, out, f"{out}-checkpoint", once=True).awaitTermination()
    return live.raw_totals(spark.read.schema(stored.schema).parquet(out)).select("run_id", "raw_bytes")


@register("st09_live_daily", f"""WITH {O.RUNS} SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, count(*) AS runs,
  CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM runs GROUP BY 1""")
def st09(spark, sf):
    schema = V.table(spark, sf, "events").schema
    out = scratch_path(spark, "daily")
    events = live.read_stream(spark, sf, schema, glob="events.parquet")
    live.start_live_table(live.live_daily(V.runs_of(events)), out, f"{out}-checkpoint", once=True).awaitTermination()
    return spark.read.parquet(out).withColumn("day", F.col("day").cast("string"))

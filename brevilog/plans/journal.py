"""Analytics over the journal of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.tokens import savings_pct, tokens_saved
from ..sources.journal import DAY
from ..schema import CUSTOM_PRICE, PRICE_ROWS, PRICES

PCT_DIGITS = 6


def _saved() -> Column:
    return tokens_saved(F.col("tokens_in"), F.col("tokens_out"))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)


def in_scope(runs: DataFrame, cwd: str | None = None) -> DataFrame:
    """Whole journal, or the runs of one project; a plain predicate, so it is pushed down."""
    return runs if cwd is None else runs.filter(F.col("cwd") == cwd)


def summary(runs: DataFrame) -> DataFrame:
    """One row of totals, also for an empty journal."""
    sums = runs.agg(
        F.count("*").alias("total_commands"), _total("tokens_in"), _total("tokens_out"),
        _total("wall_ms"))
    at_least_0 = lambda c: F.greatest(F.col(c), F.lit(0).cast("bigint"))
    n = F.col("total_commands")
    return (
        sums.withColumns({c: at_least_0(c) for c in ("tokens_in", "tokens_out", "wall_ms")})
        .select(
            n, "tokens_in", "tokens_out", _saved().alias("tokens_saved"),
            F.round(savings_pct(F.col("tokens_in"), F.col("tokens_out")), PCT_DIGITS).alias("savings_pct"),
            F.col("wall_ms").alias("total_exec_ms"),
            F.when(n == 0, F.lit(0)).otherwise(F.floor(F.col("wall_ms") / n)).cast("bigint").alias("avg_exec_ms"))
    )


def history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs first."""
    at_least_0 = lambda c: F.greatest(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return runs.orderBy(F.desc("started_at"), "id").limit(limit).select(
        "id", "started_at", "argv", "savings_pct", _saved().alias("tokens_saved"),
        at_least_0("tokens_in"), at_least_0("tokens_out"), at_least_0("wall_ms"), "exit_code", "log_path")


def _as_of(runs: DataFrame, as_of: str | None) -> Column:
    if as_of is not None:
        return F.lit(as_of).cast("date")
    return runs.agg(F.max("started_at").cast("date")).scalar()


def daily(runs: DataFrame, days: int = 30, as_of: str | None = None) -> DataFrame:
    """Runs and tokens per UTC day, oldest first.

    With a given ``as_of`` the cutoff is a literal range on ``started_at``, which reaches
    the scan, and on the folder column of a stored journal, which prunes folders; without one it is the newest run of the journal.
    """
    first_day = F.date_sub(_as_of(runs, as_of), days)
    recent = F.col("started_at") >= first_day.cast("timestamp_ntz")
    if DAY in runs.columns:
        recent = recent & (F.col(DAY) >= first_day)
    return (
        runs.filter(recent)
        .groupBy(F.col("started_at").cast("date").alias("day"))
        .agg(F.count("*").alias("runs"), _total("tokens_in"), _total("tokens_out"))
        .withColumn("tokens_saved", _saved()).orderBy("day")
    )


def daily_peaks(per_day: DataFrame) -> DataFrame:
    """Share of the best day, with a flag for days at 95 % of it or more."""
    top = per_day.agg(F.greatest(F.coalesce(F.max("tokens_saved"), F.lit(1)), F.lit(1))).scalar()
    share = F.col("tokens_saved") / top
    return per_day.withColumn("fraction", share).withColumn("is_peak", share >= 0.95).orderBy("day")


def top_commands(runs: DataFrame, limit: int = 10, whole: bool = False) -> DataFrame:
    """Commands by saved tokens, rolled up to the first argument.

    The most frequent command lines are picked first and only those are rolled up; with
    ``whole`` every command line counts.
    """
    lines = runs.groupBy("argv").agg(
        F.count("*").alias("runs"), _total("tokens_in"), _total("tokens_out"))
    if not whole:
        lines = lines.orderBy(F.desc("runs"), "argv").limit(limit)
    tin, tout = F.col("tokens_in"), F.col("tokens_out")
    heads = lines.groupBy(L.argv_head(F.col("argv")).alias("command")).agg(
        F.sum("runs").alias("runs"), _total("tokens_in"), _total("tokens_out"))
    pct = F.when(tin == 0, F.lit(0.0)).otherwise((tin - tout).cast("double") / tin.cast("double") * 100.0)
    return heads.select(
        "command", "runs", _saved().alias("saved"), F.round(pct, PCT_DIGITS).alias("pct"),
    ).orderBy(F.desc("saved"), "command").limit(limit)


def command_shares(top: DataFrame, n: int = 4) -> DataFrame:
    """Share of the saved tokens held by each of the leading commands."""
    total = top.agg(F.greatest(F.coalesce(F.sum("saved"), F.lit(0)), F.lit(1))).scalar()
    return top.select(
        "command", "saved", F.round(F.col("saved") / total * 100.0, PCT_DIGITS).alias("share_pct"),
    ).orderBy(F.desc("saved"), "command").limit(n)


def weekly(per_day: DataFrame, as_of: Column) -> DataFrame:
    """This week against last week; weeks begin on Sunday. Needs two days of data."""
    this_week = F.date_sub(as_of, F.dayofweek(as_of) - 1)
    last_week = F.date_sub(this_week, 7)
    now, before = F.col("day") >= this_week, (F.col("day") < this_week) & (F.col("day") >= last_week)
    over = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    sums = per_day.agg(
        F.count("*").alias("days"),
        over(now, "tokens_saved").alias("saved_this_week"), over(before, "tokens_saved").alias("saved_last_week"),
        over(now, "runs").alias("runs_this_week"), over(before, "runs").alias("runs_last_week"))
    this, last = F.col("saved_this_week"), F.col("saved_last_week")
    return sums.filter(F.col("days") >= 2).select(
        this, last, "runs_this_week", "runs_last_week",
        F.when(last > 0, F.round((this - last) / last * 100.0, PCT_DIGITS)).alias("change_pct"),
        F.when(last > 0, F.when(this > last, "▲").otherwise("▼")).otherwise("—").alias("direction"))


def weekly_of(runs: DataFrame, as_of: str | None = None, days: int = 30) -> DataFrame:
    return weekly(daily(runs, days, as_of), _as_of(runs, as_of))


def prices(spark) -> DataFrame:
    """Price list; a handful of fixed rows."""
    return spark.createDataFrame(PRICE_ROWS, PRICES)


def cost_saved(totals: DataFrame, custom: tuple[float, float] = CUSTOM_PRICE, model: str = "model") -> DataFrame:
    """Money saved for rows of ``(model, tokens_saved)``; unknown models use ``custom``."""
    list_ = F.broadcast(prices(totals.sparkSession)).withColumnRenamed("model", "_model")
    priced = totals.join(list_, F.col(model) == F.col("_model"), "left").drop("_model")
    p_in = F.coalesce("price_in", F.lit(custom[0]))
    p_out = F.coalesce("price_out", F.lit(custom[1]))
    return priced.withColumns({"price_in": p_in, "price_out": p_out}).withColumn(
        "cost_saved", F.col("tokens_saved") / 1000 * (F.col("price_in") + F.col("price_out")) / 2)


def kpis(runs: DataFrame, model: str = "claude-sonnet-4") -> DataFrame:
    """Headline numbers of the journal for one model."""
    tin, tout = F.col("tokens_in"), F.col("tokens_out")
    return cost_saved(summary(runs).withColumn("model", F.lit(model))).select(
        "model", F.col("total_commands").alias("runs"), "tokens_saved", "savings_pct", "tokens_out",
        F.when(tin > 0, F.round(tout / tin * 100.0, PCT_DIGITS)).alias("out_ratio_pct"),
        F.round("cost_saved", PCT_DIGITS).alias("cost_saved"), "avg_exec_ms",
        L.efficiency_badge(F.col("savings_pct")).alias("badge"))


def lookup_log(listing: DataFrame, prefix: str) -> DataFrame:
    """Logs whose run id starts with ``prefix``, by id, with the outcome of the lookup.

    The outcome is ``one`` or ``many``; no rows mean none.
    """
    found = listing.filter(F.col("run_id").startswith(prefix))
    n = found.agg(F.count("*")).scalar()
    return found.select(
        "run_id", "path", F.col("length").alias("size_bytes"), L.size_text(F.col("length")).alias("size"),
        F.when(n == 1, "one").otherwise("many").alias("outcome")).orderBy("run_id")


def retention_victims(listing: DataFrame, keep: int = 100) -> DataFrame:
    """Logs to remove: all but the newest ``keep``, ties by path.

    The oldest log to keep is found with a top-k; the rest is a filter against it, so the
    listing is neither sorted nor shuffled as a whole.
    """
    age = F.struct("modified_at", "path")
    oldest_kept = (
        listing.orderBy(F.desc("modified_at"), F.desc("path")).limit(keep).agg(F.min(age)).scalar())
    return listing.filter(age < oldest_kept)


def purge_report(listing: DataFrame) -> DataFrame:
    freed = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint")
    return listing.agg(F.count("*").alias("logs_purged"), freed.alias("bytes_freed")).withColumn(
        "space_freed", L.size_text(F.col("bytes_freed")))


def snapshot(runs: DataFrame, recent: int = 30, days: int = 30, top: int = 10,
             as_of: str | None = None) -> dict[str, DataFrame]:
    """Four reports over one journal; each reads the columns and days it needs, nothing stays cached."""
    return {
        "summary": summary(runs).withColumn("has_data", F.col("total_commands") > 0),
        "recent": history(runs, recent),
        "daily": daily(runs, days, as_of),
        "top_commands": top_commands(runs, top),
    }


def accuracy(classified: DataFrame) -> DataFrame:
    """Right answers and size ratio over ``(expected, archetype, n_bytes, out_bytes)``."""
    right = F.count_if(F.col("expected") == F.col("archetype"))
    return classified.agg(
        F.count("*").alias("total"), right.alias("correct"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("bigint").alias("bytes_in"),
        F.coalesce(F.sum("out_bytes"), F.lit(0)).cast("bigint").alias("bytes_out"),
    ).withColumns({
        "accuracy_pct": F.round(F.col("correct") / F.nullif(F.col("total"), F.lit(0)) * 100.0, PCT_DIGITS),
        "size_ratio": F.when(F.col("bytes_out") > 0,
                             F.round(F.col("bytes_in") / F.col("bytes_out"), PCT_DIGITS)).otherwise(0.0),
    })

"""Journal, log and text inputs derived from the given tables.

Every view reads whole tables; line numbers come from ``number_by_size``, so a user or an
order that holds a third of the rows is still numbered in many tasks. Numbered lines are written
once, since compaction and streams read them several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import iso_text
from ..functions.text import drop_cr
from ..functions.tokens import savings_pct
from ..operators.blocks import div, number_by_size, number_within
from ..operators.lines import lines_of_texts
from ..session import stash

ESC, BEL = "\x1b", "\x07"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(e: DataFrame) -> DataFrame:
    """Journal: one run per event, for a table or a stream of events."""
    whole = F.floor("value").cast("bigint")
    tokens_in = F.lit(40) + 7 * F.regexp_extract("props", "[0-9]+", 0).cast("bigint") + whole
    tokens_out = F.lit(20) + (F.col("event_id") * 37) % 200
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("argv"),
        F.concat(F.lit("proj"), (F.col("user_id") % 8).cast("string")).alias("cwd"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=whole / 1000)).alias("finished_at"),
        whole.alias("wall_ms"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
        (tokens_in * 4).alias("raw_bytes"),
        tokens_in.alias("tokens_in"),
        tokens_out.alias("tokens_out"),
        savings_pct(tokens_in, tokens_out).alias("savings_pct"),
        F.concat(F.lit("logs/"), F.col("event_id").cast("string"), F.lit(".log")).alias("log_path"),
        F.when(F.col("event_type") == "error", "debug:test-failure").alias("intent"),
        (F.col("user_id") % 10 == 0).alias("is_tty"),
    )


def log_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-log listing: path, size and modification time of each run's log."""
    return runs(spark, sf_dir).select(
        F.col("log_path").alias("path"), F.col("id").alias("run_id"),
        F.col("raw_bytes").alias("length"), F.col("finished_at").alias("modified_at"))


def _event_lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """Lines of events by user; ``line`` is built from the numbered events, so that no sort carries it."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", "event_type",
        # Hour of the event: rises with the order and splits a busy user.
        F.left(F.col("ts").cast("string"), F.lit(13)).alias("hour"))
    numbered = number_by_size(e, ["run_id"], ["hour"], ["ts", "event_id"], "line_no", last="is_last")
    lines = numbered.withColumn("user_id", F.col("run_id")).select("run_id", "line_no", line.alias("line"), "is_last")
    return stash(lines, "event-lines")


def log_line() -> Column:
    kind = F.col("event_type")
    said = (
        F.when(kind == "error", "ERROR upstream timeout")
        .when(kind == "purchase", "INFO charge accepted")
        .otherwise(F.concat(F.lit("INFO "), kind))
    )
    return F.concat(
        iso_text(F.col("ts")), F.lit("Z "), said,
        F.lit(" from 10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
        (F.col("event_id") % 256).cast("string"), F.lit(":443 path /srv/app/"), kind,
        F.lit(" id "), F.col("event_id").cast("string"))


def lines_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_log_ends(spark, sf_dir).drop("is_last")


def lines_log_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with the last line of each run marked."""
    return _event_lines(spark, sf_dir, log_line())


def lines_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id")
    line = F.concat(
        F.lit(ESC), F.when(kind == "error", "[1;31m").otherwise("[32m"), F.upper(kind),
        F.lit(ESC + "[0m user "), F.col("user_id").cast("string"),
        F.when(eid % 50 == 0, ESC + "[2K").otherwise(""),
        F.when(eid % 97 == 0, F.concat(F.lit(ESC + "]0;t"), eid.cast("string"), F.lit(BEL))).otherwise(""))
    return _event_lines(spark, sf_dir, line).drop("is_last")


def lines_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order listing per customer under a header row."""
    o = table(spark, sf_dir, "orders")
    body = o.select(
        F.col("o_custkey").alias("run_id"), "o_orderkey", "o_orderpriority", "o_orderstatus",
        div(F.col("o_orderkey"), 100_000).alias("span"))
    rows = number_by_size(body, ["run_id"], ["span"], ["o_orderkey"], "nr")
    line = F.concat(F.rpad(F.col("o_orderkey").cast("string"), 12, " "),
                    F.rpad("o_orderpriority", 20, " "), F.col("o_orderstatus"))
    header = o.select(F.col("o_custkey").alias("run_id")).distinct().select(
        "run_id", F.lit(1).cast("bigint").alias("line_no"),
        F.lit("ORDER".ljust(12) + "PRIORITY".ljust(20) + "STATUS").alias("line"))
    return stash(header.unionByName(rows.select("run_id", (F.col("nr") + 1).alias("line_no"), line.alias("line"))), "table-lines")


def lines_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, supplier, part and lot as an indented listing per region."""
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("run_id"), F.lit("").alias("name"),
        F.lit(-1).cast("bigint").alias("supp"), F.lit("").alias("k"),
        F.lit(0).alias("depth"), F.col("r_name").alias("label"))
    n = table(spark, sf_dir, "nation")
    nation = n.select(
        F.col("n_regionkey").alias("run_id"), F.col("n_name").alias("name"),
        F.lit(-1).cast("bigint").alias("supp"), F.lit("").alias("k"),
        F.lit(1).alias("depth"), F.col("n_name").alias("label"))
    # Suppliers are the large side; the join key is the nation, of which there are few,
    # and AQE broadcasts the nation table by its real size.
    supp = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("run_id"), F.col("n_name").alias("name"),
        F.col("s_suppkey").alias("supp"), F.col("s_name").alias("s_name"))
    key = F.col("supp").cast("string")
    items = F.array_compact(F.array(
        F.struct(F.lit("").alias("k"), F.lit(2).alias("depth"), F.col("s_name").alias("label")),
        *[F.when(F.col("supp") % 2 == 0, F.struct(
            F.lit(f"/{i}").alias("k"), F.lit(3).alias("depth"),
            F.concat(F.lit("part "), key, F.lit(f"-{i}")).alias("label"))) for i in (1, 2)],
        F.when(F.col("supp") % 4 == 0, F.struct(
            F.lit("/2/0").alias("k"), F.lit(4).alias("depth"),
            F.concat(F.lit("lot "), key).alias("label")))))
    below = supp.withColumn("item", F.explode(items)).select(
        "run_id", "name", "supp", F.col("item.k").alias("k"), F.col("item.depth").alias("depth"),
        F.col("item.label").alias("label"))
    rows = region.unionByName(nation).unionByName(below).select(
        "run_id", "name", "supp", "k", div(F.col("supp") + 1, 10_000).alias("span"),
        F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("label")).alias("line"))
    numbered = number_within(rows, ["run_id"], ["name", "span"], ["supp", "k"], "line_no")
    return stash(numbered.select("run_id", "line_no", "line"), "tree-lines")


def lines_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines dressed up as diffs, fifty orders to a run."""
    li = table(spark, sf_dir, "lineitem").select(
        div(F.col("l_orderkey"), 50).alias("run_id"), "l_orderkey", "l_linenumber", "l_partkey",
        "l_suppkey", "l_returnflag", "l_linestatus")
    rows = number_by_size(
        li, ["run_id"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "line_no")
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    kind = (F.col("line_no") - 1) % 8
    line = (
        F.when(kind == 0, F.concat(F.lit("diff --git a/f"), p, F.lit(" b/f"), p))
        .when(kind == 1, F.concat(F.lit("--- a/f"), p))
        .when(kind == 2, F.concat(F.lit("+++ b/f"), p))
        .when(kind == 3, "@@ -1,3 +1,4 @@")
        .when(kind == 4, F.concat(F.lit("-old "), s))
        .when(kind == 5, F.concat(F.lit("+new "), s))
        .otherwise(F.concat(F.lit("context "), F.col("l_returnflag"), F.col("l_linestatus")))
    )
    return stash(rows.select("run_id", "line_no", line.alias("line")), "diff-lines")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def lines_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_texts(documents(spark, sf_dir), "doc_id")


def conversation_texts(spark: SparkSession, sf_dir: str, gap: str = "\n\n") -> DataFrame:
    """Turns of each conversation in order, joined into one text."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return turns.select("doc_id", F.array_join(F.transform("turns", lambda t: t["text"]), gap).alias("text"))


def lines_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with trailing blanks and double empty lines between turns."""
    return lines_of_texts(conversation_texts(spark, sf_dir, " \n\n\n"), "doc_id")


def lines_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations, a blank line after each turn; no conversation is joined into one row."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), "turn", F.posexplode(F.split(F.concat("text", F.lit("\n")), "\n", -1)).alias("pos", "line"))
    rows = number_within(turns.withColumn("line", drop_cr(F.col("line"))), ["run_id"], ["turn"], ["pos"], "line_no")
    return rows.select("run_id", "line_no", "line")

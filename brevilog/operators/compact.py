"""Compaction of a lines table: tables fold, logs dedupe, trees prune, prose is cleaned."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..functions.labels import intent_kind
from ..functions.text import drop_cr, octets, trim_end
from ..functions.tokens import savings_pct, tokens_from_bytes, tokens_saved
from ..params import DEFAULTS, Params
from ..session import cut_lineage
from . import intents
from .blocks import block_of_line, block_of_ord, carries, div, number_by_range, per_block  # noqa: F401
from .classify import LINEAR, PASSTHROUGH, TABULAR, TREE, classify_runs

# Marks written into the output.
LAST_TOKEN = r"(?U)(?<!\S)\S++(?=\s*+\z)"
INDENT = r"^[ \t│├└─]*"
ONE_COLUMN = " ─"
RAW = "raw"
FOLD_ORD = 2 * (1 + DEFAULTS.table_head) + 1


def repeat_suffix(count: Column) -> Column:
    return F.when(count > 1, F.concat(F.lit("  × "), count.cast("string"))).otherwise("")


def separator(p: Params) -> str:
    return f"--- last {p.log_tail} lines ---"


def fold_note(folded: Column, note: Column) -> Column:
    counted = F.concat(F.lit("... ["), folded.cast("string"), F.lit(" rows folded"))
    return F.when(note.isNull(), F.concat(counted, F.lit("] ..."))).otherwise(
        F.concat(counted, F.lit(": "), note, F.lit("] ...")))


def inline_note(count: Column, p: Params) -> Column:
    return F.concat(F.lit("  " * (p.tree_depth + 1) + "... ["), count.cast("string"), F.lit(" more]"))


def final_note(count: Column, depth: Column) -> Column:
    return F.concat(
        F.repeat(F.lit("  "), (depth - 1).cast("int")), F.lit("... ["), count.cast("string"),
        F.lit(" more at depth "), depth.cast("string"), F.lit("]"))


def line_depth(line: Column) -> Column:
    """Indentation columns halved: space and dash count 1, tab and branch marks 4."""
    prefix = F.regexp_extract(line, INDENT, 0)
    wide = F.char_length(F.translate(prefix, ONE_COLUMN, ""))
    return F.floor((F.char_length(prefix) + 3 * wide) / 2).cast("bigint")


class Compacted(NamedTuple):
    """``runs``: one row per run; ``lines``: output lines keyed by (run_id, ord)."""

    runs: DataFrame
    lines: DataFrame
    any_long: bool


def _routes(runs: DataFrame, p: Params) -> DataFrame:
    """Branch of each run; needs ``is_short``."""
    whole = (
        F.col("is_short")
        | ((F.col("archetype") == TABULAR) & (F.col("n_lines") <= 1 + p.table_head + p.table_tail))
        | ((F.col("archetype") == LINEAR) & (F.col("n_lines") <= p.log_tail))
    )
    # Untouched tables and logs are joined without a final line end.
    ends = F.when(F.col("is_short"), F.col("text_ends")).when(whole, F.lit(False)).otherwise(True)
    return (
        runs.withColumn("route", F.when(whole, RAW).otherwise(F.col("archetype")))
        .withColumn("ends_newline", ends)
        .withColumn("is_long", F.col("n_lines") > p.block_lines)
    )


CARRIED = ["is_long", "kind"]


def _row(line_no: Column, line: Column) -> list[Column]:
    return ["run_id", "block", (line_no * 2).alias("ord"), line.alias("line"), *CARRIED]


def keep_lines(rows: DataFrame, p: Params) -> DataFrame:
    """What is decided by a line and its place alone: all lines of untouched runs, first and last rows of tables, last lines
    of logs, lines of prose that aren't blank. One pass over runs of all these kinds."""
    n, at, route, line = F.col("n_lines"), F.col("line_no"), F.col("route"), F.col("line")
    text = F.when(route == PASSTHROUGH, trim_end(line)).otherwise(line)
    rows = rows.filter(
        F.when(route == TABULAR, (at <= 1 + p.table_head) | (at > n - p.table_tail))
        .when(route == LINEAR, at > n - p.log_tail).otherwise(route.isin(RAW, PASSTHROUGH)))
    return rows.withColumn("line", text).filter((route != PASSTHROUGH) | (line != "")).select(*_row(at, line))


def fold_tables(rows: DataFrame, runs: DataFrame, p: Params) -> DataFrame:
    """One line for the rows between the first and last ones of each table."""
    head, tail = 1 + p.table_head, p.table_tail
    n, at = F.col("n_lines"), F.col("line_no")
    token = F.regexp_extract("line", LAST_TOKEN, 0)
    counts = (
        rows.filter((at > head) & (at <= n - tail))
        .select("run_id", token.alias("token")).filter(F.col("token") != "")
        .groupBy("run_id", "token").agg(F.count("*").alias("n"))
    )
    # Only the first max_distinct + 1 values of a run travel: the rank limit is applied
    # before the shuffle as well, so a table with millions of values stays bounded.
    rank = Window.partitionBy("run_id").orderBy(F.desc("n"), "token")
    few = (
        counts.withColumn("r", F.row_number().over(rank))
        .filter(F.col("r") <= p.table_max_distinct + 1)
        .groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("r", "n", "token"))).alias("top"))
        .filter(F.size("top") <= p.table_max_distinct)
        .select("run_id", F.array_join(F.transform(
            "top", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["token"])), ", ").alias("note"))
    )
    return (
        runs.filter(F.col("route") == TABULAR).join(few, "run_id", "left")
        .select(
            "run_id", F.lit(2 * head // (2 * p.block_lines)).cast("bigint").alias("block"),
            F.lit(2 * head + 1).cast("bigint").alias("ord"),
            fold_note(n - head - tail, F.col("note")).alias("line"), *CARRIED)
    )


def dedupe_logs(rows: DataFrame, runs: DataFrame, p: Params) -> DataFrame:
    """First line of each template with its count, and a separator; the last lines are left out."""
    n, at = F.col("n_lines"), F.col("line_no")
    cut = n - p.log_tail
    templates = (
        rows.filter(at <= cut)
        .groupBy("run_id", *CARRIED, fingerprint(F.col("line")).alias("fp"))
        .agg(F.min("line_no").alias("first_no"), F.min_by("line", "line_no").alias("line"),
             F.count("*").alias("count"))
        .withColumn("block", block_of_line(F.col("first_no"), p.block_lines))
        .select(*_row(F.col("first_no"), F.concat("line", repeat_suffix(F.col("count")))))
    )
    mark = cut * 2 + 1
    marks = runs.filter(F.col("route") == LINEAR).select(
        "run_id", block_of_ord(mark, p.block_lines).alias("block"), mark.alias("ord"),
        F.lit(separator(p)).alias("line"), *CARRIED)
    return templates.unionByName(marks)


def prune_trees(rows: DataFrame, p: Params, any_long: bool) -> DataFrame:
    """Lines down to the depth limit, with notes about what was left out.

    A visible line whose previous visible line sits at the limit closes the count of
    lines one level deeper; that count is written before it. What is still open at the
    end is listed per depth.
    """
    limit, deeper = p.tree_depth, p.tree_depth + 1
    key = ["run_id", "block"]
    order = Window.partitionBy(*key).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    at, depth = F.col("line_no"), F.col("depth")
    visible = depth <= limit
    shown = F.when(visible, depth)
    is_deeper = (depth == deeper).cast("bigint")
    zero = F.lit(0).cast("bigint")

    rows = rows.select(*key, "line_no", "line", "n_lines", *CARRIED,
                       line_depth(F.col("line")).alias("depth"))
    if any_long:
        rows = rows.join(carries(rows.filter("is_long"), {
            "deep_before": (F.sum(is_deeper), "sum"),
            "shown_before": (F.max_by(shown, F.when(visible, at)), "last"),
        }), key, "left")
    else:
        rows = rows.withColumns({"deep_before": zero, "shown_before": F.lit(None).cast("bigint")})
    rows = (
        rows.withColumn("deep", F.sum(is_deeper).over(upto) + F.coalesce("deep_before", zero))
        .withColumn("prev", F.coalesce(F.last(shown, True).over(earlier), F.col("shown_before")))
        .withColumn("flush", F.coalesce(visible & (F.col("prev") == limit), F.lit(False)))
        .drop("deep_before", "shown_before", "prev")
    )
    at_flush = F.when(F.col("flush"), F.col("deep"))
    # "deep" never falls along a run, so the latest flush is the largest value.
    closed = F.max(at_flush).over(earlier)
    if any_long:
        rows = rows.join(
            carries(rows.filter("is_long"), {"closed_before": (F.max(at_flush), "max")}), key, "left")
        closed = F.coalesce(closed, F.col("closed_before"))
    pending = F.when(F.col("flush"), F.col("deep") - F.coalesce(closed, zero))
    noted = rows.withColumn("pending", pending)

    note = F.when(F.col("pending") > 0, F.struct(
        (at * 2 - 1).alias("ord"), inline_note(F.col("pending"), p).alias("line")))
    own = F.struct((at * 2).alias("ord"), F.col("line").alias("line"))
    kept = noted.filter(visible).select(
        *key, F.inline(F.array_compact(F.array(note, own))), *CARRIED)

    # One row per run and depth after partial aggregation.
    per_run = Window.partitionBy("run_id")
    done = F.sum("noted").over(per_run)
    finals = (
        noted.groupBy("run_id", "n_lines", *CARRIED, depth)
        .agg(F.count("*").alias("count"), F.coalesce(F.sum("pending"), zero).alias("noted"))
        .withColumn("count", F.when(depth == deeper, F.col("count") - done).otherwise(F.col("count")))
        .filter((depth >= deeper) & (F.col("count") > 0))
        .select("run_id", block_of_line(F.col("n_lines"), p.block_lines).alias("block"),
                (F.col("n_lines") * 2 + depth).alias("ord"),
                final_note(F.col("count"), depth).alias("line"), *CARRIED)
    )
    return kept.unionByName(finals)


def blank_lines(rows: DataFrame, p: Params, any_long: bool) -> DataFrame:
    """Of consecutive blank lines of prose the first. Numbers are dense, so blank lines tell by their numbers alone
    which of them follow another; no other line is moved."""
    key, at = ["run_id", "block"], F.col("line_no")
    order = Window.partitionBy(*key).orderBy("line_no")
    rows = rows.select(*key, "line_no", trim_end(F.col("line")).alias("line"), *CARRIED).filter(F.col("line") == "")
    after_blank = F.lag(at).over(order) == at - 1
    if any_long:
        # Blank state across a block edge: the last line of the block before.
        edges = (
            rows.filter(F.col("is_long") & (F.pmod("line_no", F.lit(p.block_lines)) == 0))
            .select("run_id", (F.col("block") + 1).alias("block"), (at + 1).alias("edge"))
        )
        rows = rows.join(edges, key, "left")
        after_blank = F.coalesce(after_blank, F.col("edge") == at)
    return (
        rows.withColumn("after_blank", F.coalesce(after_blank, F.lit(False)))
        .filter(~F.col("after_blank"))
        .select(*_row(at, F.col("line")))
    )


def compact_lines(
    lines: DataFrame,
    p: Params = DEFAULTS,
    ends_newline: bool = True,
    intent: DataFrame | None = None,
    force: str | None = None,
) -> Compacted:
    """Classify every run and compact it; each run takes exactly one branch.

    ``intent(run_id, intent)`` biases the output of the runs it names. ``force`` treats
    every run, short ones included, as the given archetype. Lines whose numbers have gaps, repeats or a late start
    are counted in the order of their numbers, so that none is lost. ``cr`` and ``lf`` of lines, see ``run_totals``.
    """
    runs = classify_runs(lines, p, ends_newline)
    is_short = F.col("n_bytes") < p.short_bytes
    if force:
        runs, is_short = runs.withColumn("archetype", F.lit(force)), F.lit(False)
    runs = _routes(runs.withColumn("is_short", is_short), p)
    if intent is None:
        runs = runs.withColumn("kind", F.lit("none"))
    else:
        # One kind for each run, whatever the number of its intent rows: the first by name.
        asked = intent.groupBy("run_id").agg(F.min(intent_kind(F.col("intent"))).alias("kind"))
        # Short runs never reach the intent step.
        runs = runs.join(asked, "run_id", "left").withColumn("kind", F.when(
            F.col("is_short") | F.col("kind").isNull(), "none").otherwise(F.col("kind")))
    runs = cut_lineage(runs)
    # At most one row per route and intent kind: which branches the plan needs at all.
    n_blocks = block_of_line(F.col("n_lines"), p.block_lines) + 1
    census = runs.groupBy("route", "kind").agg(
        F.max("is_long").alias("is_long"), F.sum(n_blocks).alias("blocks"),
        F.min("dense").alias("dense")).collect()
    if not all(r.dense for r in census):
        flags = [c for c in ("cr", "lf") if c in lines.columns]
        # Any number of lines may share a number, so numbers don't bound the rows of a task.
        counted = number_by_range(lines, ["run_id"], [F.col(c) for c in ("line_no", "line", *flags)], "_counted")
        lines = counted.select("run_id", F.col("_counted").cast("bigint").alias("line_no"), "line", *flags)
        return compact_lines(lines, p, intent=intent, force=force, ends_newline=ends_newline)
    routes = {r.route: any(x.is_long for x in census if x.route == r.route) for r in census}
    any_long = any(routes.values())

    facts = per_block(
        runs.select("run_id", "n_lines", "route", *CARRIED), "n_lines", p.block_lines)
    keyed = lines.select(
        "run_id", block_of_line(F.col("line_no"), p.block_lines).alias("block"), "line_no", "line")

    def rows(*names: str) -> DataFrame:
        """Lines of the runs of these routes."""
        part = facts.filter(F.col("route").isin(*names))
        # The exact number of fact rows is known by now; beyond the limit the join is a
        # shuffle on (run_id, block), whose keys hold at most one block of lines each.
        few = sum(r.blocks for r in census if r.route in names) <= p.broadcast_rows
        return keyed.join(F.broadcast(part) if few else part, ["run_id", "block"])
    branch = {
        TABULAR: lambda: fold_tables(rows(TABULAR), runs, p),
        LINEAR: lambda: dedupe_logs(rows(LINEAR), runs, p),
        TREE: lambda: prune_trees(rows(TREE), p, routes[TREE]),
        PASSTHROUGH: lambda: blank_lines(rows(PASSTHROUGH), p, routes[PASSTHROUGH]),
    }
    # A run takes exactly one route. Without any run the plan of RAW gives the schema.
    by_line = sorted(set(routes) - {TREE}) or ([] if routes else [RAW])
    out = reduce(DataFrame.unionByName, [
        *([keep_lines(rows(*by_line), p)] if by_line else []), *(branch[name]() for name in sorted(routes) if name in branch)])
    if {r.kind for r in census} & {"failure", "diff"}:
        runs, out = _bias(runs, out, p, any_long)
    return Compacted(runs, out, any_long)


def _bias(runs: DataFrame, out: DataFrame, p: Params, any_long: bool) -> tuple[DataFrame, DataFrame]:
    """Apply failure focus and diff stripping to the runs that ask for them."""
    cols = ["run_id", "block", "ord", "line", *CARRIED]
    of = lambda kind: out.filter(F.col("kind") == kind)
    plain = out.filter(~F.col("kind").isin("failure", "diff"))
    diff = intents.strip_diff(of("diff").withColumn("line", drop_cr(F.col("line"))))
    failing = Compacted(runs, of("failure"), any_long)
    numbered = number_lines(failing, keep=["block", "ord", *CARRIED])
    focus = intents.focus_failures(numbered, p)
    runs = runs.withColumn(
        "ends_newline", F.col("kind").isin("failure", "diff") | F.col("ends_newline"))
    return runs, plain.select(*cols).unionByName(diff.select(*cols)).unionByName(focus.select(*cols))


def number_lines(done: Compacted, keep: list[str] | None = None) -> DataFrame:
    """Dense output numbers: ``(run_id, out_no, line)``.

    Numbered inside each block; only runs of more than one block need offsets.
    """
    key, lines = ["run_id", "block"], done.lines
    number = F.row_number().over(Window.partitionBy(*key).orderBy("ord")).cast("bigint")
    if done.any_long:
        offsets = carries(lines.filter("is_long"), {"offset": (F.count("*"), "sum")})
        lines = lines.join(offsets, key, "left")
        number = number + F.coalesce("offset", F.lit(0))
    return lines.withColumn("out_no", number).select("run_id", "out_no", "line", *(keep or []))


def report(done: Compacted) -> DataFrame:
    """Bytes and tokens before and after, per run, without building any text."""
    sizes = done.lines.groupBy("run_id").agg(
        F.count("*").alias("out_lines"), F.sum(octets(F.col("line"))).alias("out_octets"))
    out_lines = F.coalesce("out_lines", F.lit(0)).cast("bigint")
    joined = done.runs.join(sizes, "run_id", "left")
    # Line ends: one per line, but for the last line of a text that has none there.
    ends = F.when(out_lines == 0, 0).otherwise(out_lines - F.when(F.col("ends_newline"), 0).otherwise(1))
    out_bytes = F.when(F.col("is_short"), F.col("n_bytes")).otherwise(F.coalesce("out_octets", F.lit(0)) + ends)
    base = joined.select(
        "run_id", "archetype", "n_lines", "n_bytes", out_lines.alias("out_lines"),
        out_bytes.cast("bigint").alias("out_bytes"))
    tin, tout = F.col("tokens_in"), F.col("tokens_out")
    return (
        base.withColumn("tokens_in", tokens_from_bytes(F.col("n_bytes")))
        .withColumn("tokens_out", tokens_from_bytes(F.col("out_bytes")))
        .withColumn("tokens_saved", tokens_saved(tin, tout))
        .withColumn("savings_pct", savings_pct(tin, tout))
    )


def tty_bypass(runs: DataFrame) -> DataFrame:
    """Interactive runs are never compacted: tokens out are the tokens of the raw bytes."""
    tty, raw = F.col("is_tty"), tokens_from_bytes(F.col("raw_bytes"))
    return runs.withColumns({
        "tokens_in": F.when(tty, raw).otherwise(F.col("tokens_in")),
        "tokens_out": F.when(tty, raw).otherwise(F.col("tokens_out")),
        "savings_pct": F.when(tty, F.lit(0.0)).otherwise(F.col("savings_pct")),
        "archetype": F.when(tty, PASSTHROUGH).otherwise(F.col("archetype")),
    })

"""Compaction of one-text-per-row tables, entirely inside the row.

Same results as the lines form, for inputs where each text already is one row: files
read whole, documents, live windows. Everything is array expressions, so there is no
shuffle at all. Every step is linear or a sort; arrays that a lambda looks into are
materialised as columns first and looked up by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..functions.labels import intent_kind
from ..functions.text import octets, split_lines, trim_both, trim_end
from ..functions.tokens import approx_tokens, savings_pct, tokens_saved
from ..params import DEFAULTS, Params
from .classify import LINEAR, PASSTHROUGH, TABULAR, TREE, archetype_of, with_scores
from .compact import (
    LAST_TOKEN, final_note, fold_note, inline_note, line_depth, repeat_suffix, separator)
from .intents import GAP_LINE, diff_keep, is_failure


def _group_starts(name: str, key: Callable[[Column], Column]) -> Column:
    """Positions at which a sorted array column begins a new group."""
    items = F.col(name)
    return F.array_compact(F.transform(
        items, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(items, i - 1))), i)))


def _groups(name: str, starts: str) -> Column:
    """``(item, n)`` for the first item of each group of a sorted array column."""
    items, at = F.col(name), F.col(starts)
    return F.transform(at, lambda s, k: F.struct(
        F.get(items, s).alias("item"),
        (F.coalesce(F.get(at, k + 1), F.size(items)) - s).cast("bigint").alias("n")))


def _on(route: str, value: Column) -> Column:
    return F.when(F.col("_route") == route, value)


def _log_lines(df: DataFrame, p: Params) -> DataFrame:
    lines, n = F.col("_lines"), F.size("_lines")
    head = F.slice(lines, F.lit(1), n - p.log_tail)
    # The classifier has made the first ones.
    keyed = F.transform(head, lambda l, i: F.struct(F.coalesce(F.get("_prints", i), fingerprint(l)).alias("fp"), i.alias("i")))
    df = df.withColumn("_fp", _on(LINEAR, F.sort_array(keyed)))
    df = df.withColumn("_fp_at", _group_starts("_fp", lambda x: x["fp"]))
    templates = F.sort_array(F.transform(
        _groups("_fp", "_fp_at"), lambda g: F.struct(g["item"]["i"].alias("i"), g["n"].alias("n"))))
    shown = F.transform(templates, lambda t: F.concat(F.get(lines, t["i"]), repeat_suffix(t["n"])))
    tail = F.slice(lines, -p.log_tail, p.log_tail)
    return df.withColumn("_log", F.concat(shown, F.array(F.lit(separator(p))), tail)).drop("_fp", "_fp_at")


def _table_lines(df: DataFrame, p: Params) -> DataFrame:
    lines, n = F.col("_lines"), F.size("_lines")
    head, tail = 1 + p.table_head, p.table_tail
    folded = F.slice(lines, F.lit(head + 1), n - head - tail)
    tokens = F.filter(
        F.transform(folded, lambda l: F.regexp_extract(l, LAST_TOKEN, 0)), lambda t: t != "")
    df = df.withColumn("_tok", _on(TABULAR, F.sort_array(tokens)))
    df = df.withColumn("_tok_at", _group_starts("_tok", lambda x: x))
    few = F.size("_tok_at").between(1, p.table_max_distinct)
    ranked = F.sort_array(F.transform(
        _groups("_tok", "_tok_at"), lambda g: F.struct((-g["n"]).alias("m"), g["item"].alias("token"))))
    note = F.when(few, F.array_join(F.transform(
        ranked, lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), x["token"])), ", "))
    fold = fold_note((n - head - tail).cast("bigint"), note)
    return df.withColumn("_table", _on(TABULAR, F.concat(
        F.slice(lines, 1, head), F.array(fold), F.slice(lines, -tail, tail)))).drop("_tok", "_tok_at")


def _tree_lines(df: DataFrame, p: Params) -> DataFrame:
    limit, deeper = p.tree_depth, p.tree_depth + 1
    lines = F.col("_lines")
    df = df.withColumn("_d", _on(TREE, F.transform(lines, line_depth)))
    placed = F.transform("_d", lambda d, i: F.struct(i.alias("i"), d.alias("d")))
    df = df.withColumns({
        "_shown": F.filter(placed, lambda x: x["d"] <= limit),
        "_deep": F.transform(F.filter(placed, lambda x: x["d"] == deeper), lambda x: x["i"]),
        "_deepest": F.sort_array(F.filter("_d", lambda d: d > deeper)),
    })
    shown = F.col("_shown")
    # Lines at which the pending count is written out.
    df = df.withColumn("_flush", F.array_compact(F.transform(
        shown, lambda x, k: F.when(F.get(shown, k - 1)["d"] == limit, x["i"]))))
    # Sorted together with the flush lines, the k-th flush has as many deep lines before
    # it as its position minus k.
    merged = F.sort_array(F.concat(
        F.transform("_flush", lambda i: F.struct(i.alias("i"), F.lit(1).alias("f"))),
        F.transform("_deep", lambda i: F.struct(i.alias("i"), F.lit(0).alias("f")))))
    placed_flush = F.filter(
        F.transform(merged, lambda x, j: F.struct(x["i"].alias("i"), x["f"].alias("f"), j.alias("j"))),
        lambda x: x["f"] == 1)
    df = df.withColumn("_c", F.transform(
        placed_flush, lambda x, k: F.struct(x["i"].alias("i"), (x["j"] - k).cast("bigint").alias("c"))))
    closed = F.col("_c")
    zero = F.lit(0).cast("bigint")

    def note(x: Column, k: Column) -> Column:
        pending = x["c"] - F.coalesce(F.get(closed, k - 1)["c"], zero)
        return F.when(pending > 0, F.struct(
            (x["i"] * 2 - 1).cast("bigint").alias("ord"), inline_note(pending, p).alias("line")))

    rest = F.size("_deep") - F.coalesce(F.get(closed, F.size(closed) - 1)["c"], zero)
    df = df.withColumn("_deepest_at", _group_starts("_deepest", lambda x: x))
    end = F.size(lines) * 2

    def final(depth: Column, count: Column) -> Column:
        return F.struct((end + depth).cast("bigint").alias("ord"),
                        final_note(count, depth).alias("line"))

    deeper_lit = F.lit(deeper).cast("bigint")
    finals = F.concat(
        F.array_compact(F.array(F.when(rest > 0, final(deeper_lit, rest)))),
        F.transform(_groups("_deepest", "_deepest_at"), lambda g: final(g["item"], g["n"])))
    kept = F.transform(shown, lambda x: F.struct(
        (x["i"] * 2).cast("bigint").alias("ord"), F.get(lines, x["i"]).alias("line")))
    out = F.sort_array(F.concat(kept, F.array_compact(F.transform(closed, note)), finals))
    return df.withColumn("_tree", F.transform(out, lambda x: x["line"])).drop(
        "_d", "_shown", "_deep", "_deepest", "_deepest_at", "_flush", "_c")


def _prose_lines(df: DataFrame) -> DataFrame:
    df = df.withColumn("_trim", _on(PASSTHROUGH, F.transform("_lines", trim_end)))
    trimmed = F.col("_trim")
    return df.withColumn("_prose", F.filter(
        trimmed, lambda x, i: ~((x == "") & (i > 0) & (F.get(trimmed, i - 1) == "")))).drop("_trim")


def _terminated(lines: Column) -> Column:
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def _bias(df: DataFrame, p: Params) -> DataFrame:
    reach = p.context_lines
    asks = F.col("_kind").isin("failure", "diff")
    df = df.withColumn("_o", F.when(asks, split_lines(F.col("compacted"))))
    df = df.withColumn("_hit", F.when(F.col("_kind") == "failure", F.transform("_o", is_failure)))
    hit = F.col("_hit")

    def near(_: Column, i: Column) -> Column:
        first = F.greatest(i - reach, F.lit(0))
        return F.array_contains(F.slice(hit, first + 1, i + reach - first + 1), True)

    df = df.withColumn("_near", F.when(F.array_contains(hit, True), F.transform(hit, near)))
    kept = F.col("_near")
    focus = F.array_compact(F.transform("_o", lambda l, i: F.when(F.get(kept, i), l).when(
        F.get(kept, i - 1), F.lit(GAP_LINE))))
    return df.withColumn(
        "compacted",
        F.when(kept.isNotNull(), _terminated(focus))
        .when(F.col("_kind") == "diff", _terminated(F.filter("_o", diff_keep)))
        .otherwise(F.col("compacted")),
    ).drop("_o", "_hit", "_near")


def compact_texts(
    df: DataFrame,
    text: str = "text",
    intent: Column | None = None,
    p: Params = DEFAULTS,
    count_tokens: Callable[[Column], Column] = approx_tokens,
    archetype: Column | None = None,
) -> DataFrame:
    """Add ``archetype``, ``compacted`` and the token columns to a table of texts.

    Where ``archetype`` is given and not null it replaces the classifier's choice.
    """
    given = df.columns
    short = octets(F.col(text)) < p.short_bytes
    df = df.withColumn("_lines", F.when(~short, split_lines(F.col(text))))
    # Lines are scored only where the scores decide.
    scored = F.col("_lines") if archetype is None else F.when(archetype.isNull(), F.col("_lines"))
    df = df.withColumn("_sample", F.slice(scored, 1, p.sample_lines))
    df = df.withColumn("_prints", F.transform("_sample", fingerprint))
    df = with_scores(df, "_sample", p, F.col("_prints"))
    chosen = archetype_of(p) if archetype is None else F.coalesce(archetype, archetype_of(p))
    df = df.withColumn("_archetype", F.when(short, PASSTHROUGH).otherwise(chosen))
    kind, n = F.col("_archetype"), F.size("_lines")
    whole = ((kind == TABULAR) & (n <= 1 + p.table_head + p.table_tail)) | (
        (kind == LINEAR) & (n <= p.log_tail))
    df = df.withColumn("_route", F.when(~short & ~whole, kind))
    df = _prose_lines(_tree_lines(_table_lines(_log_lines(df, p), p), p))
    out = F.coalesce("_log", "_table", "_tree", "_prose")
    df = df.withColumn(
        "compacted",
        F.when(short, F.col(text)).when(F.col("_route").isNull(), F.array_join("_lines", "\n"))
        .otherwise(_terminated(out)))
    if intent is not None:
        df = _bias(df.withColumn("_kind", F.when(~short, intent_kind(intent))), p)
    tin, tout = F.col("tokens_in"), F.col("tokens_out")
    return (
        df.select(*given, F.col("_archetype").alias("archetype"), "compacted")
        .withColumn("tokens_in", count_tokens(F.col(text)))
        .withColumn("tokens_out", count_tokens(F.col("compacted")))
        .withColumn("tokens_saved", tokens_saved(tin, tout))
        .withColumn("savings_pct", savings_pct(tin, tout))
    )


# Two or more line ends with nothing but white space between them.
PARAGRAPH_BREAK = r"(?U)\n\s*\n"


def sections(texts: DataFrame, doc: str, text: str = "text", window_lines: int = 0) -> DataFrame:
    """``(doc, section_no, text)``: paragraphs, or chunks of ``window_lines`` lines.

    Sections are trimmed; blank ones are dropped but keep their number.
    """
    df = texts.select(doc, split_lines(F.col(text)).alias("_lines"))
    lines, n = F.col("_lines"), F.size("_lines")
    if window_lines > 0:
        chunks = F.when(n > 0, F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / window_lines).cast("int")),
            lambda k: F.array_join(F.slice(lines, k * window_lines + 1, window_lines), "\n")))
    else:
        chunks = F.split(F.array_join(lines, "\n"), PARAGRAPH_BREAK, -1)
    rows = df.select(doc, F.posexplode(chunks).alias("section_no", "text"))
    return rows.withColumn("text", trim_both(F.col("text"))).filter(F.col("text") != "")


def distill(
    texts: DataFrame, doc: str, text: str = "text", window_lines: int = 0,
    intent: Column | None = None, p: Params = DEFAULTS,
) -> DataFrame:
    """Each section compacted on its own."""
    return compact_texts(sections(texts, doc, text, window_lines), "text", intent, p)


def distill_report(distilled: DataFrame, doc: str) -> DataFrame:
    """Tokens of a document, summed over its sections."""
    tin, tout = F.col("tokens_in"), F.col("tokens_out")
    return (
        distilled.groupBy(doc)
        .agg(F.count("*").alias("sections"), F.sum("tokens_in").alias("tokens_in"),
             F.sum("tokens_out").alias("tokens_out"))
        .withColumn("tokens_saved", tokens_saved(tin, tout))
        .withColumn("savings_pct", savings_pct(tin, tout))
    )

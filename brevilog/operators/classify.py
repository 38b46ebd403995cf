"""Archetype of a run, from its first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..functions.text import octets
from ..params import DEFAULTS, Params

# Fixed values.
TABULAR, LINEAR, TREE, PASSTHROUGH = "tabular", "linear-log", "tree", "passthrough"
TREE_MARKS = ["  ", "\t", "├", "└", "│"]
GAP = " {2,}"


def column_signature(line: Column, p: Params = DEFAULTS) -> Column:
    """Bucketed byte columns at which runs of two or more spaces begin, as text.

    A run that begins the line does not count. Empty text means no such run.
    """
    between = F.split(line, GAP, -1)
    gaps = F.regexp_extract_all(line, F.lit(GAP), F.lit(0))
    steps = F.zip_with(
        between, gaps, lambda a, g: F.struct(F.octet_length(a).alias("a"), F.octet_length(g).alias("g"))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("sig"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["a"]
        return F.struct(
            (begin + F.coalesce(x["g"], F.lit(0))).alias("at"),
            F.when(x["g"].isNull() | (begin == 0), acc["sig"])
            .otherwise(F.concat(acc["sig"], F.floor(begin / p.column_bucket).cast("string"), F.lit(",")))
            .alias("sig"),
        )

    return F.when(line.contains("  "), F.aggregate(steps, start, step)["sig"]).otherwise("")


def _table_share(sigs: Column, usable: Column, p: Params) -> Column:
    """Share of the most common of the signatures among the ``usable`` lines."""
    # At most sample_lines signatures, so counting each against all stays tiny.
    counts = F.aggregate(
        sigs, F.create_map().cast("map<string,int>"),
        lambda acc, s: F.map_concat(
            F.map_filter(acc, lambda k, v: k != s),
            F.create_map(s, F.coalesce(F.try_element_at(acc, s), F.lit(0)) + 1)),
    )
    top = F.coalesce(F.array_max(F.map_values(counts)), F.lit(0))
    return F.when(usable < p.table_min_rows, F.lit(0.0)).otherwise(top.cast("double") / usable.cast("double"))


def tabular_score(sample: Column, p: Params = DEFAULTS) -> Column:
    """Share of the longer lines that have the most common non-empty signature."""
    usable = F.filter(sample, lambda l: F.octet_length(l) >= p.table_min_bytes)
    sigs = F.filter(F.transform(usable, lambda l: column_signature(l, p)), lambda s: s != "")
    return _table_share(sigs, F.size(usable), p)


def _tree_marked(line: Column) -> Column:
    hit = line.startswith(TREE_MARKS[0])
    for mark in TREE_MARKS[1:]:
        hit = hit | line.startswith(mark)
    return hit


def _tree_share(marked: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(marked.cast("double") / n.cast("double"))


def tree_score(sample: Column) -> Column:
    """Share of lines that begin with an indent or a branch mark."""
    return _tree_share(F.size(F.filter(sample, _tree_marked)), F.size(sample))


def _linear_share(distinct: Column, size: Column, p: Params) -> Column:
    n = size.cast("double")
    density = F.least(n, F.lit(float(p.sample_lines))) / float(p.sample_lines)
    score = (F.lit(p.linear_base) + F.lit(p.linear_dup_weight) * (F.lit(1.0) - distinct.cast("double") / n)) * density
    return F.when(size < p.linear_min_lines, F.lit(0.0)).otherwise(score)


def linear_score(sample: Column, p: Params = DEFAULTS, prints: Column | None = None) -> Column:
    """Grows with the share of lines whose fingerprint repeats and with sample size; ``prints``: the fingerprints, if known."""
    distinct = F.size(F.array_distinct(F.transform(sample, fingerprint) if prints is None else prints))
    return _linear_share(distinct, F.size(sample), p)


def pick(tabular: Column, tree: Column, linear: Column, p: Params = DEFAULTS) -> Column:
    """Best score wins if it reaches the floor; a tie goes to linear, then tree."""
    best = F.greatest(tabular, tree, linear)
    return (
        F.when(best < p.confidence_floor, PASSTHROUGH)
        .when(linear == best, LINEAR).when(tree == best, TREE).otherwise(TABULAR)
    )


def with_scores(df: DataFrame, sample: str = "sample", p: Params = DEFAULTS, prints: Column | None = None) -> DataFrame:
    """Add the three scores of the sampled lines; ``prints``: their fingerprints, if known."""
    s = F.col(sample)
    return (
        df.withColumn("tabular_score", tabular_score(s, p))
        .withColumn("tree_score", tree_score(s))
        .withColumn("linear_score", linear_score(s, p, prints))
    )


def archetype_of(p: Params = DEFAULTS) -> Column:
    """Archetype from the score columns; an empty sample is passthrough."""
    return pick(F.col("tabular_score"), F.col("tree_score"), F.col("linear_score"), p)


def _hashed(no: Column) -> Column:
    return F.xxhash64(no)


def _halves(h: Column) -> tuple[Column, Column]:
    """Two numbers of 31 bits."""
    return h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)


def run_totals(lines: DataFrame, ends_newline: bool = True) -> DataFrame:
    """Lines and text bytes of each run (line ends included), and whether lines are numbered 1, 2, 3 ... without gap or repeat.

    ``lines`` may tell for each line whether a CR was dropped from it (``cr``) and whether it has a line end
    (``lf``); then bytes are exact. Without these, lines end with LF, but for the last one if not ``ends_newline``.

    Numbers are dense if the least is 1, the greatest the count, and the steps of a hash from each number to the
    next add up to the step from the first to one after the last (two sums of 31 bits each).
    """
    given, at = lines.columns, F.col("line_no")
    count, zero = F.count("*"), F.lit(0)
    n_cr = F.sum(F.col("cr").cast("bigint")) if "cr" in given else zero
    n_lf = F.sum(F.col("lf").cast("bigint")) if "lf" in given else count - (0 if ends_newline else 1)
    ends = F.min("lf") if "lf" in given else F.lit(ends_newline)
    steps = [b - a for a, b in zip(_halves(_hashed(at)), _halves(_hashed(at + 1)), strict=True)]
    totals = lines.groupBy("run_id").agg(
        count.alias("n_lines"), (F.sum(octets(F.col("line"))) + n_cr + n_lf).alias("n_bytes"), ends.alias("text_ends"),
        F.min("line_no").alias("_first"), F.max("line_no").alias("_last"), *[F.sum(s).alias(f"_s{k}") for k, s in enumerate(steps)])
    one, after = _halves(_hashed(F.lit(1).cast("bigint"))), _halves(_hashed(F.col("n_lines") + 1))
    dense = (F.col("_first") == 1) & (F.col("_last") == F.col("n_lines"))
    for k in range(2):
        dense = dense & (F.col(f"_s{k}") == after[k] - one[k])
    return totals.withColumn("dense", dense).drop("_first", "_last", "_s0", "_s1")


def run_samples(lines: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """First lines of each run as an array of bounded size."""
    first = lines.filter(F.col("line_no") <= p.sample_lines)
    grouped = first.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_rows"))
    return grouped.select("run_id", F.transform("_rows", lambda r: r["line"]).alias("sample"))


def sample_facts(lines: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """What the scores need of the first lines of each run; the lines themselves are not moved.

    ``_n`` lines, of which ``_usable`` may be table rows and ``_marked`` begin like a tree; the signatures, and the
    distinct fingerprints by 128 bits of two hashes.
    """
    first = lines.filter(F.col("line_no") <= p.sample_lines)
    line, usable = F.col("line"), F.octet_length("line") >= p.table_min_bytes
    facts = first.select(
        "run_id", usable.alias("usable"), _tree_marked(line).alias("marked"), F.when(usable, column_signature(line, p)).alias("sig"),
        fingerprint(line).alias("print"))
    return facts.groupBy("run_id").agg(
        F.count("*").alias("_n"), F.count_if("usable").alias("_usable"), F.count_if("marked").alias("_marked"),
        F.collect_list(F.when(F.col("sig") != "", F.col("sig"))).alias("_sigs"),
        F.collect_set(F.struct(F.xxhash64("print").alias("a"), F.xxhash64(F.lit(1), "print").alias("b"))).alias("_prints"))


def classify_runs(lines: DataFrame, p: Params = DEFAULTS, ends_newline: bool = True) -> DataFrame:
    """Size, scores and archetype of each run; scores of short runs are still reported.

    The classifier only ever sees facts of ``sample_lines`` rows per run; totals use partial
    aggregation. Both end up partitioned by ``run_id``, so their join adds no shuffle.
    """
    runs = run_totals(lines, ends_newline).join(sample_facts(lines, p), "run_id", "left")
    n, marked, usable = (F.coalesce(c, F.lit(0)) for c in ("_n", "_marked", "_usable"))
    sigs, prints = F.coalesce("_sigs", F.array().cast("array<string>")), F.coalesce(F.size("_prints"), F.lit(0))
    scored = runs.withColumns({
        "tabular_score": _table_share(sigs, usable, p), "tree_score": _tree_share(marked, n), "linear_score": _linear_share(prints, n, p),
    }).withColumn("scored_archetype", archetype_of(p))
    return scored.withColumn(
        "archetype",
        F.when(F.col("n_bytes") < p.short_bytes, PASSTHROUGH).otherwise(F.col("scored_archetype")),
    ).drop("_n", "_usable", "_marked", "_sigs", "_prints")

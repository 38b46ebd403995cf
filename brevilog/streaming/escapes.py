"""Escape state over chunk edges.

A chunk maps the state it is entered in to the state it is left in. Only its last ESC decides the state it leaves; without
an ESC a sequence that was open goes on, unless some character of the chunk ends it. So the state before a chunk
follows from two kinds of facts about earlier chunks, both of them maxima: the last chunk whose state is known
whatever came before, and the last chunk that ends each kind of sequence. Maxima over spans of chunks are carried
from span to span, and no run is read in order by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ansi import strip_ansi
from ..operators.blocks import carries

# States: plain text; right after ESC; ESC and intermediates; control sequence; operating-system command; device string.
GROUND, AFTER_ESC, ESC_MIDDLE, CSI, OSC, STRING = range(6)
# What, at the end of a text, leaves it in a state; and a text that does so.
OPEN_AT_END = {
    AFTER_ESC: r"\x1b\z", ESC_MIDDLE: r"\x1b[\x20-\x2f]+\z", CSI: r"\x1b\[[\x20-\x3f]*\z",
    OSC: r"\x1b\][^\x07\x18\x1a\x1b]*\z", STRING: r"\x1b[PX^_][^\x18\x1a\x1b]*\z",
}
OPENERS = {GROUND: "", AFTER_ESC: "\x1b", ESC_MIDDLE: "\x1b ", CSI: "\x1b[", OSC: "\x1b]", STRING: "\x1bP"}
# A text without ESC that has one of these ends the sequence that is open.
ENDS = {ESC_MIDDLE: r"[^\x20-\x2f]", CSI: r"[^\x20-\x3f]", OSC: r"[\x07\x18\x1a]", STRING: r"[\x18\x1a]"}


def state_after(text: Column) -> Column:
    """State at the end of a text that begins in plain text."""
    out = F.lit(GROUND)
    for state, pattern in OPEN_AT_END.items():
        out = F.when(text.rlike(pattern), F.lit(state)).otherwise(out)
    return F.when(text.contains("\x1b"), out).otherwise(F.lit(GROUND))


def resumed(state: Column, text: Column) -> Column:
    """The text, begun in plain text, that means the same as ``text`` begun in ``state``."""
    opener = F.element_at(F.array(*[F.lit(o) for o in OPENERS.values()]), state + 1)
    return F.when(state == GROUND, text).otherwise(F.concat(opener, text))


def strip_resumed(state: Column, text: Column) -> Column:
    return strip_ansi(resumed(state, text))


def with_entry_state(chunks: DataFrame, span: Column, start: Column | None = None) -> DataFrame:
    """``chunks(run_id, chunk_no, text, ...)`` with ``entry``: the state at the beginning of each chunk.

    ``span`` is a number that rises with ``chunk_no`` and cuts a run into pieces of bounded size. ``start`` is the state
    before the first chunk of the run at hand, on every row of it.
    """
    kept = [c for c in chunks.columns]
    start = F.coalesce(start, F.lit(GROUND)) if start is not None else F.lit(GROUND)
    text, no = F.col("text"), F.col("chunk_no")
    some = text != ""
    rows = chunks.withColumns({"block": span, "_start": start})
    order = Window.partitionBy("run_id", "block").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    cut = text.endswith("\x1b")

    rows = rows.join(carries(rows, {"_cut_before": (F.max_by(cut, F.when(some, no)), "last")}), ["run_id", "block"], "left")
    follows_esc = F.coalesce(F.last(F.when(some, cut), True).over(order), F.col("_cut_before"), F.col("_start") == AFTER_ESC)
    rows = rows.withColumn("_after_esc", some & follows_esc)
    sure = F.when(F.col("_after_esc"), state_after(F.concat(F.lit("\x1b"), text))).when(text.contains("\x1b"), state_after(text))
    rows = rows.withColumn("_known", F.when(sure.isNotNull(), F.struct(no.alias("at"), sure.alias("state"))))
    for state, pattern in ENDS.items():
        rows = rows.withColumn(f"_end{state}", F.when(text.rlike(pattern), no))
    facts = ["_known", *[f"_end{s}" for s in ENDS]]
    rows = rows.join(carries(rows, {f"{c}_before": (F.max(c), "max") for c in facts}), ["run_id", "block"], "left")
    # What a span knows of itself is later than what earlier spans know.
    rows = rows.withColumns({f"{c}_last": F.coalesce(F.max(c).over(order), F.col(f"{c}_before")) for c in facts})
    known = F.coalesce(F.col("_known_last"), F.struct(F.lit(-1).cast("bigint").alias("at"), F.col("_start").alias("state")))
    rows = rows.withColumn("_open", known)
    over = F.lit(False)
    for state in ENDS:
        over = over | ((F.col("_open.state") == state) & F.coalesce(F.col(f"_end{state}_last") > F.col("_open.at"), F.lit(False)))
    entry = F.when(over, F.lit(GROUND)).otherwise(F.col("_open.state"))
    return rows.withColumn("entry", entry.cast("int")).select(*kept, "entry")

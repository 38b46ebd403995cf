"""Quality rules by weak supervision.

Each rule looks at one signal of a text and votes good (1) or bad (0), or abstains (null). Nobody
labels anything: expectation-maximisation over the table of vote patterns estimates how common good texts are and
how often each rule that votes calls a good text bad and a bad text bad. A text is kept when its posterior
probability of being good reaches ``threshold``, so a vote of bad may be outweighed by others.

All of this is estimated freely. One thing is taken for granted: no rule calls good texts bad more often than bad ones;
a rule for which that came out counts for nothing. EM starts from each pair of ``STARTS`` and ``PRIORS``; the fit with the highest
likelihood is taken. An abstention says nothing.

The patterns are counted by one grouped aggregate. There are at most 3 to the power of the number of
rules of them, whatever the corpus holds, so the estimation itself runs on the driver over that small table;
the verdict is a column expression with the estimated weights as constants.

Cases: a null or empty text has no words, so every rule abstains and the base rule drops it; ties in the posterior
keep; a table without rows leaves the first start; repeated rows are judged alike; all other columns pass
through ``filter_documents`` unchanged, whatever their names; a very long text is taken apart alone, with about
100 bytes of arrays for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_hashes, gram_hashes, mix, pieces, rows_of, split_words, stash, tidied, word_hashes

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct",
           "n_marked", "n_letters")
REPEAT_WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 256)]] = True  # characters beyond ASCII count as letters
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False  # bytes that go on with a character


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offs])


def _within(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signal_columns(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The signals of each text, in the order of SIGNALS."""
    texts = len(offs) - 1
    starts, ends, first = split_words(data, offs)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(texts), n_words)
    head = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_HEAD[data], out=head[1:])
    word_chars = np.bincount(doc, weights=head[ends] - head[starts], minlength=texts).astype(np.int64)
    # lines: cut at LF and at the borders of texts
    cut = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([cut + 1, offs[:-1]]))
    line_starts = line_starts[line_starts < len(data)]
    line_doc = np.searchsorted(offs, line_starts, "right") - 1
    line_ends = np.append(line_starts[1:], len(data))
    lf = (line_ends > line_starts) & (data[np.maximum(line_ends, 1) - 1] == 10) if len(data) else np.zeros(0, bool)
    line_ends = line_ends - lf
    some = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[some], line_ends[some], line_doc[some]
    n_lines = np.bincount(line_doc, minlength=texts)
    _, at = np.unique(_within(byte_hashes(data, line_starts, line_ends, 3), line_doc), return_index=True)
    n_dup = n_lines - np.bincount(line_doc[at], minlength=texts)
    # words in windows that occur again
    hashes = word_hashes(data, starts, ends)
    repeat = np.zeros(texts, np.int64)
    runs = gram_hashes(hashes, REPEAT_WINDOW, 1)
    at = np.flatnonzero(doc[: len(runs)] == doc[REPEAT_WINDOW - 1 : len(runs) + REPEAT_WINDOW - 1])
    if len(at):
        _, which, n = np.unique(_within(runs[at], doc[at]), return_inverse=True, return_counts=True)
        at = at[n[which] > 1]
        edge = np.zeros(len(starts) + 1, np.int64)
        edge[at] += 1
        edge[at + REPEAT_WINDOW] -= 1
        repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=texts)
    _, at = np.unique(_within(hashes, doc), return_index=True)
    distinct = np.bincount(doc[at], minlength=texts)
    symbols = np.append(0, np.cumsum(_SYMBOL[data]))
    marked = np.bincount(doc[symbols[ends] > symbols[starts]], minlength=texts)
    return [n_words, word_chars, np.diff(symbols[offs]), n_dup, repeat, n_lines, _per_text(_UPPER[data], offs),
            distinct, marked, _per_text(_LETTER[data], offs)]


def signals(docs: DataFrame, text_col: str = "text", name: str = "signals") -> DataFrame:
    """``docs`` with one more column, a struct of the signals."""
    kind = T.StructType([T.StructField(s, T.LongType()) for s in SIGNALS])
    out = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in pieces(b.column(place)):
                made = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in signal_columns(data, offs)],
                                                  list(SIGNALS))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])
    return docs.mapInArrow(tidied(run), out)


def rules(s: Column) -> dict[str, Column]:
    """Votes: 1 good, 0 bad, null abstains: between the two, or no words to judge by."""
    words, chars, letters = s["n_words"], s["word_chars"], s["n_letters"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(words > 0, F.when(bad, 0).when(good, 1)).cast("int")

    return {
        "symbols": vote(20 * s["n_symbols"] > chars, 200 * s["n_symbols"] <= chars),
        "marked": vote(5 * s["n_marked"] > words, 50 * s["n_marked"] <= words),
        "letters": vote(10 * letters < 9 * chars, 100 * letters >= 95 * chars),
        "lines": vote(10 * s["n_dup_lines"] > 3 * s["n_lines"], 20 * s["n_dup_lines"] <= s["n_lines"]),
        "repeats": vote(5 * s["n_repeat_words"] > words, 50 * s["n_repeat_words"] <= words),
        "word_length": vote((2 * chars < 5 * words) | (chars > 12 * words), (chars >= 3 * words) & (chars <= 10 * words)),
        "capitals": vote(4 * s["n_upper"] > chars, 10 * s["n_upper"] <= chars),
        "variety": vote((words >= 40) & (words < 1000) & (10 * s["n_distinct"] < 4 * words),
                        (words >= 40) & (10 * s["n_distinct"] >= 6 * words)),
    }


# Where EM starts: how often a rule calls a bad text bad, and the share of good texts; a good text is called bad with FALSE_ALARM.
STARTS, PRIORS, FALSE_ALARM = (0.2, 0.5, 0.8), (0.85, 0.6, 0.95), 0.05


@dataclass(frozen=True)
class Model:
    prior: float                             # share of good texts
    bad_rate: dict[str, tuple[float, float]]  # rule -> share of votes of bad among its votes on bad texts, on good texts

    def weight(self, name: str) -> tuple[float, float]:
        """Log-odds of good that a vote of bad adds, and a vote of good."""
        on_bad, on_good = self.bad_rate[name]
        return math.log(on_good / on_bad), math.log((1 - on_good) / (1 - on_bad))

    def log_odds(self, votes: dict[str, Column]) -> Column:
        """Of good against bad, given the votes."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, v in votes.items():
            bad, good = self.weight(name)
            total = total + F.when(v == 0, F.lit(bad)).when(v == 1, F.lit(good)).otherwise(F.lit(0.0))
        return total


def _climb(bad: np.ndarray, good: np.ndarray, count: np.ndarray, start: float, prior: float, steps: int):
    """EM from one start: likelihood, share of good texts, and votes of bad on bad (row 0) and good texts (row 1) by rule."""
    rate = np.array([[start], [FALSE_ALARM]]).repeat(bad.shape[1], 1)
    last = -np.inf
    for _ in range(steps):
        each = np.log(rate) @ bad.T + np.log1p(-rate) @ good.T + np.log([[1 - prior], [prior]])
        both = np.logaddexp(each[0], each[1])
        likely = float(count @ both)
        if likely - last <= 1e-10 * abs(likely):
            break
        last = likely
        weight = count * np.exp(each - both)
        prior = float((weight[1].sum() + 0.5) / (count.sum() + 1))
        # half a vote of either kind for each class, so that no rate is 0 or 1
        votes_bad, votes = weight @ bad + 0.5, weight @ (bad + good) + 1
        rate = np.where(votes_bad[0] / votes[0] < votes_bad[1] / votes[1], votes_bad.sum(0) / votes.sum(0), votes_bad / votes)
    return likely, prior, rate


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], names: list[str], steps: int = 500) -> Model:
    """EM over (votes, count): the model of the most likely of all starts, the first of equals."""
    if not patterns:
        return Model(PRIORS[0], {n: (STARTS[0], FALSE_ALARM) for n in names})
    cast = np.array([[-1 if v is None else v for v in p] for p, _ in patterns]).reshape(len(patterns), -1)
    bad, good, count = (cast == 0).astype(float), (cast == 1).astype(float), np.array([n for _, n in patterns], float)
    fits = [_climb(bad, good, count, start, prior, steps) for start in STARTS for prior in PRIORS]
    _, prior, rate = max(fits, key=lambda f: round(f[0], 3))
    return Model(prior, {n: (float(a), float(b)) for n, a, b in zip(names, *rate, strict=True)})


def fit(with_signals: DataFrame, name: str = "signals") -> Model:
    """Estimate the rules' accuracies. Collects the vote patterns, at most 3 to the power of the number of rules."""
    votes = rules(F.col(name))
    rows = with_signals.groupBy(*[v.alias(n) for n, v in votes.items()]).agg(F.count("*").alias("n")).collect()
    rows = sorted(((tuple(r)[:-1], r["n"]) for r in rows), key=repr)  # one order, so that sums come out alike
    return estimate(rows, list(votes))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def posterior(model: Model, s: Column) -> Column:
    return 1 / (1 + F.exp(-model.log_odds(rules(s))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, signals, posterior, base_failed, kept. Runs jobs while the plan is built."""
    seen = stash(signals(docs.select(id_col, text_col)).drop(text_col), "signals")
    s, model = F.col("signals"), fit(seen)
    return (seen.withColumn("posterior", posterior(model, s)).withColumn("base_failed", base_failed(s))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def filter_documents(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, all columns as they were.

    Runs jobs while the plan is built: signals are taken once, and written beside the rows to the shared folder.
    """
    name = "signals"
    while name in docs.columns:
        name += "_"
    seen = stash(signals(docs, text_col, name), "signals")
    s, model = F.col(name), fit(seen, name)
    return seen.where(~base_failed(s) & (posterior(model, s) >= threshold)).drop(name)

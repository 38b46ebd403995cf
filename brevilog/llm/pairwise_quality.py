"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in its features. The chance that a good document is preferred to a bad one
is the logistic function of the difference of their strengths, so the weights are fitted by logistic loss on
feature differences of preference pairs. A document's score is its strength, mapped to 0..1 by a logistic curve fitted
to the same labelled rows; documents are then accepted from a quantile of all scores on.

Features are counts of characters, words and lines of the whole text, each put in bins whose borders are
quantiles of the training rows (so a weight for each bin). Language, source, id and labels are no features.

The fit uses at most ``MAX_LABELLED`` labelled rows, those whose ids have the smallest hashes, and ``PAIRS`` pairs
of them; both bounds keep it on the driver. Everything else covers all rows.

Cases: null and empty texts have features of zero and get a score like others; without labelled rows of both kinds all
weights are zero and every score is the share of good rows (0.5 without any); conflicting labels of one id count both; a
null id is scored and never trained on; repeated rows score alike; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, rows_of, split_words, stash, word_hashes
from .quality_rules import signal_columns

MAX_LABELLED, PAIRS, BINS = 20_000, 60_000, 10
FEATURES = ("size", "word_size", "symbols", "dup_lines", "repeats", "line_size", "capitals", "variety", "digits", "bangs", "bars",
            "stops", "commas", "high", "twins", "long_words")


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_COUNTED = [_flag(b"0123456789"), _flag(b"!"), _flag(b"|"), _flag(b".?!"), _flag(b",;:"), _flag(bytes(range(0xC0, 256)))]


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    words, chars, symbols, dups, repeats, lines, upper, distinct = (c.astype(np.float64) for c in signal_columns(data, offs)[:8])
    starts, ends, first = split_words(data, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[offs]).astype(np.float64)
    digits, bangs, bars, stops, commas, high = (per_text(f[data]) for f in _COUNTED)
    h = word_hashes(data, starts, ends)
    twins = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(offs) - 1)
    long_words = np.bincount(doc[ends - starts > 14], minlength=len(offs) - 1)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(words), chars / w, symbols / c, dups / np.maximum(lines, 1), repeats / w, np.log1p(words / np.maximum(lines, 1)),
                     upper / c, distinct / w, digits / c, bangs / w, bars / w, stops / w, commas / w, high / c, twins / w, long_words / w], axis=1)


def with_features(docs: DataFrame, text_col: str = "text", name: str = "features") -> DataFrame:
    """``docs`` with a column of features."""
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in pieces(b.column(place)):
                x = features(data, offs)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])
    return docs.mapInArrow(run, out)


@dataclass(frozen=True)
class Model:
    borders: np.ndarray   # features x borders
    weights: np.ndarray   # features x (borders + 1)
    slope: float
    shift: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return sum((w[np.searchsorted(b, x[:, j], "left")] for j, (b, w) in enumerate(zip(self.borders, self.weights, strict=True))),
                   np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.strength(x) + self.shift, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, bins: int = BINS, ridge: float = 1.0, seed: int = 7) -> Model:
    """Weights from rows of features and their labels (1 good, 0 bad)."""
    n = x.shape[1]
    if not len(x) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return Model(np.zeros((n, 0)), np.zeros((n, 1)), 0.0, float(np.log(share / (1 - share))))
    # borders: quantiles of bad and of good rows, so that the rare kind is told apart as finely
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    borders = np.sort(np.concatenate([np.quantile(x[y == k], cuts, axis=0) for k in (0, 1)]).T, axis=1)
    cells = borders.shape[1] + 1
    z = np.zeros((len(x), n * cells), np.float32)
    for j in range(n):
        z[np.arange(len(x)), j * cells + np.searchsorted(borders[j], x[:, j], "left")] = 1
    rng = np.random.default_rng(seed)
    good, bad = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    w = np.zeros(z.shape[1])
    for _ in range(12):  # Newton steps; pairs are taken in parts
        grad, hess = -ridge * w, ridge * np.eye(len(w))
        for lo in range(0, pairs, 10_000):
            d = z[good[lo : lo + 10_000]] - z[bad[lo : lo + 10_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w.astype(np.float32), -30, 30)))  # of the wrong preference
            grad += (d * p[:, None]).sum(0)
            hess += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    slope, shift = _curve((z @ w.astype(np.float32)).astype(np.float64), y)
    return Model(borders, w.reshape(n, cells), slope, shift)


def _curve(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from strengths to labels; labels are softened, so that a clean split has one too."""
    good = y.sum()
    soft = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    mean, scale = s.mean(), max(s.std(), 1e-9)
    m = np.stack([(s - mean) / scale, np.ones(len(s))], 1)

    def loss(a: np.ndarray) -> float:
        t = m @ a
        return float((np.logaddexp(0, t) - soft * t).sum() + 0.005 * a[0] ** 2)
    a = np.array([1.0, float(np.log(soft.mean() / (1 - soft.mean())))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -500, 500)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag([0.01, 1e-9]), m.T @ (soft - p) - [0.01 * a[0], 0.0])
        now, size = loss(a), 1.0
        while size > 1e-6 and loss(a + size * step) > now:
            size /= 2
        a = a + size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
    return float(a[0] / scale), float(a[1] - a[0] * mean / scale)


def fold(id_col: str, parts: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % parts


_SCORED = "doc_id long, score double"
_SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def train(known: DataFrame, labels: DataFrame, label_col: str = "quality", limit: int = MAX_LABELLED) -> Model:
    """Fit on at most ``limit`` rows of ``known`` (doc_id, features) that have a label."""
    rows = (known.join(labels.where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).alias("y")), "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit).select("features", "y").toArrow())
    x = rows.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x, rows.column("y").to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             held_out: tuple[int, int] = (5, 0), threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, accepted.

    Labels of rows whose fold (crc32 of the id as text, modulo the first number) is the second number are never
    learned from. accepted: the score reaches the quantile of all scores below which the labelled share of bad lies.
    Runs jobs while the plan is built.
    """
    seen = stash(with_features(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("text"), "features")
    usable = labels.where(fold("doc_id", held_out[0]) != held_out[1])
    model = train(seen, usable, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield rows_of(_SCORED_ARROW, b.column("doc_id"), model.score(x))
    scored = stash(seen.mapInArrow(run, _SCORED), "scores")
    bad = usable.agg(F.avg((F.col(label_col) == 0).cast("double"))).first()[0] or 0.0
    least = (scored.approxQuantile("score", [bad], 0.001) or [0.0])[0]
    return scored.select("doc_id", (fold("doc_id", held_out[0]) == held_out[1]).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") > least).alias("accepted"))

"""Hard negatives by exact integer scores: Strassen products of anchor-candidate tiles, then mergeable heaps.

1. Vectors become whole numbers (``quantized``). Anchors are dealt into blocks of about ``ANCHOR_BLOCK`` rows, candidates into
   blocks of about ``CANDIDATE_BLOCK``; each pair of blocks is one group of a cogrouped shuffle, so every anchor meets every
   candidate once and a group's size is that of two blocks, whatever the table holds. No table is broadcast or collected.
2. In a group, tiles of int64 scores are made by Strassen's recursion: odd sides are padded with a zero row or column, seven
   half-size products replace eight, and all sums are exact (whole numbers modulo 2^64, so what an intermediate sum may
   exceed does not matter; that no score exceeds 2^55 is checked first). From ``LEAF`` on, numpy multiplies.
3. First pass: each group keeps a heap of the best positives of each anchor (same label, other id), by score, then id.
   Heaps of the groups are merged by a ranked window, whose partial limit runs before its shuffle.
4. Second pass: each positive gives a window of scores, low * p <= 100 * n <= high * p. Groups keep a heap of the best rows of
   another label in each window; heaps are merged in the same way.

Cost: anchors times candidates, twice. Traffic: each candidate goes once to each block of anchors and the other way round.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of different length are
padded with zeros; ties go by id; candidate rows that repeat take a rank each, and rows with the anchor's own id are never its
positives; anchors that are equal in id, label and vector count once; anchors without positives or without negatives
have no rows; an empty table gives an empty result; a score that might exceed 2^55 raises ValueError; other columns are not
read. Very long vectors are taken whole; blocks hold a number of rows, so very long ones need smaller blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

ANCHOR_BLOCK, CANDIDATE_BLOCK = 2048, 8192
# Rows and columns of a tile of scores, and the side from which numpy multiplies.
TILE_ANCHORS, TILE_CANDIDATES, LEAF = 256, 2048, 16
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
_FIRST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for int64 matrices with seven half-size products at each level."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((2 * i, 2 * l), np.int64)
    c11, c12, c21, c22 = out[:i, :l], out[:i, l:], out[i:, :l], out[i:, l:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


class Heaps:
    """The best ``size`` entries (score, then id) of each of n heaps; takes entries in bulk, and so merges other heaps."""

    def __init__(self, n: int, size: int) -> None:
        self.n, self.size = n, size
        self.heap, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, _FIRST)  # a score below this can't enter

    def take(self, heap: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(heap):
            return
        heap, score, ids = (np.concatenate(x) for x in ((self.heap, heap), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, heap))
        heap = heap[order]
        rank = np.arange(len(heap)) - np.searchsorted(heap, heap)
        order, heap = order[rank < self.size], heap[rank < self.size]
        self.heap, self.score, self.id = heap, score[order], ids[order]
        full = rank[rank < self.size] == self.size - 1
        self.least[heap[full]] = self.score[full]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row for each vector, padded with zeros."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _tiles(anchors: pa.Table, rows: pa.Table, width: int):
    """Slices of anchors, ids and labels of candidates, and their scores; candidates come by id."""
    rows = rows.sort_by("id")
    a, c = _matrix(anchors.column("vector"), width), _matrix(rows.column("vector"), width)
    ids, labels = _longs(rows, "id"), _longs(rows, "label")
    for lo in range(0, len(c), TILE_CANDIDATES):
        part = slice(lo, lo + TILE_CANDIDATES)
        turned = np.ascontiguousarray(c[part].T)
        for at in range(0, len(a), TILE_ANCHORS):
            some = slice(at, at + TILE_ANCHORS)
            yield some, ids[part], labels[part], strassen(a[some], turned)


_POSITIVE = "anchor long, anchor_id long, score long, id long"


def _positives(width: int, size: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = _longs(anchors, "id"), _longs(anchors, "label")
        best = Heaps(len(ids), size)
        for some, c_ids, c_labels, scores in _tiles(anchors, rows, width) if len(ids) and rows.num_rows else ():
            fits = (labels[some, None] == c_labels) & (ids[some, None] != c_ids) & (scores >= best.least[some, None])
            i, j = np.nonzero(fits)
            best.take(i + some.start, scores[i, j], c_ids[j])
        return pa.table({"anchor": _longs(anchors, "anchor")[best.heap], "anchor_id": ids[best.heap], "score": best.score, "id": best.id})
    return run


_NEGATIVE = "anchor long, place int, anchor_id long, positive_id long, positive_score long, score long, id long"


def bounds(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest n with low * p <= 100 * n <= high * p."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(width: int, places: int, size: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = _longs(anchors, "id"), _longs(anchors, "label")
        scores_of, ids_of = (_matrix(anchors.column(c), places) for c in ("p_scores", "p_ids"))
        known = np.arange(places) < np.array(anchors.column("p_scores").combine_chunks().value_lengths(), np.int64)[:, None]
        least, most = bounds(scores_of, low, high)
        least, most = np.where(known, least, _LAST), np.where(known, most, _FIRST)
        best = Heaps(len(ids) * places, size)
        for some, c_ids, c_labels, scores in _tiles(anchors, rows, width) if len(ids) and rows.num_rows else ():
            other = labels[some, None] != c_labels
            for k in range(places):
                low_k = np.maximum(least[some, k], best.least[np.arange(*some.indices(len(ids))) * places + k])
                i, j = np.nonzero(other & (scores >= low_k[:, None]) & (scores <= most[some, k][:, None]))
                best.take((i + some.start) * places + k, scores[i, j], c_ids[j])
        at, place = np.divmod(best.heap, places)
        return pa.table({"anchor": _longs(anchors, "anchor")[at], "place": place.astype(np.int32), "anchor_id": ids[at],
                         "positive_id": ids_of[at, place], "positive_score": scores_of[at, place], "score": best.score, "id": best.id})
    return run


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, vector) with components floor(scale * x), of the rows that take part."""
    held = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    held = held.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", _finite))
    return held.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("vector"))


def _met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Both sides dealt into blocks, every block of one with every block of the other."""
    across, down = -(-n_anchors // ANCHOR_BLOCK), -(-n_rows // CANDIDATE_BLOCK)
    part = lambda number, n: F.pmod(F.xxhash64(number), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"a": part(F.col("anchor"), across)}).withColumn("c", every(down))
    right = rows.withColumn("c", part(F.monotonically_increasing_id(), down)).withColumn("a", every(across))
    return left.groupBy("a", "c").cogroup(right.groupBy("a", "c"))


def _best(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Merge the heaps of all groups."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return rows.withColumn(name, rank).where(F.col(name) <= size)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of ``anchors`` among ``rows``; both have id, label and a vector of whole numbers.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank). ``rows`` should come from
    a scan or a written table: it is read once for each pass.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    size = F.transform("vector", F.abs)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    of_rows = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(F.array_max(size)).alias("most")).first()
    held = stash(anchors.select("id", "label", "vector").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    of_anchors = held.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(total(size)).alias("sum")).first()
    if not of_rows["n"] or not of_anchors["n"]:
        return spark.createDataFrame([], result)
    if (of_rows["most"] or 0) * (of_anchors["sum"] or 0) >= 2**55:
        raise ValueError("scores may be too large for whole numbers of 64 bits")
    width = max(of_rows["width"], of_anchors["width"])
    kind = "array<smallint>" if (of_rows["most"] or 0) < 2**15 else "array<bigint>"  # fewer bytes to shuffle
    rows = rows.select("id", "label", F.col("vector").cast(kind).alias("vector"))
    found = _met(held, rows, of_anchors["n"], of_rows["n"]).applyInArrow(_positives(width, positives), _POSITIVE)
    best = _best(found, ["anchor"], positives, "place")
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("p"))
    lists = stash(lists.select("anchor", F.col("p.score").alias("p_scores"), F.col("p.id").alias("p_ids")), "positives")
    hunting = held.join(lists, "anchor")
    found = _met(hunting, rows, of_anchors["n"], of_rows["n"]).applyInArrow(_negatives(width, positives, negatives, low, high), _NEGATIVE)
    best = _best(found, ["anchor", "place"], negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score"), (F.col("place") + 1).alias("positive_rank"))

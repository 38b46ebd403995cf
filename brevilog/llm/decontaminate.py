"""Benchmark decontamination by size-partitioned MinHash containment search.

Sets are the distinct five-word shingles (A-Z lower-cased) of items and of documents. An item is contained
in a document when at least ``percent`` of its set is in the document's set. A document may be thousands of times
longer than an item, so that their similarity says nothing; what is searched for is the item's sketch.

1. Items are partitioned by the power of two of their set's size. Each partition has a sketch of
   its own size (the smallest hashes of the set; small sets are kept whole) and its own number of sketch values that a
   document must hold. For whole sets that number is exact; for sketches an item that is contained falls below it with a
   chance under one in a million.
2. The sketches form an index value -> items. A bitmap of ``BITS`` bits of its values, of fixed size whatever the
   number of items, is broadcast; shingles of documents that miss it are dropped where they are read.
3. The rest meets the index in a join by value; counts by document and item give candidates.
4. Candidates are confirmed on the full sets.

Cases: null and empty texts have no shingles: such items are never found, such documents hold nothing; a text with
one to four words has its whole sequence as its one shingle; rows with equal id and text give one pair; a null item id is
an item like others; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, pieces, rows_of, same_row, signed, split_words, stash, tidied, word_hashes, gram_hashes, span_hashes, LOWER
from .minhash_dedup import SHINGLE, shingle_sets

PERCENT = 80
BITS = 1 << 22
WHOLE = 32       # sets up to this size are their own sketch
SKETCH = 64      # sketch of the largest sets

_INDEX = "i1 long, i2 long, n long, part int, need int, v long"
_INDEX_ARROW = pa.schema([("i1", pa.int64()), ("i2", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("need", pa.int32()),
                          ("v", pa.int64())])


def sketch_size(n: int) -> int:
    """Of a set in the partition of sizes from the power of two below ``n`` on."""
    return n if n <= WHOLE else min(SKETCH, max(WHOLE, 1 << (n.bit_length() - 1)))


def needed(n: int, percent: int) -> int:
    """Sketch values that a document must hold."""
    if n <= WHOLE:
        return max(1, -(-percent * n // 100))
    s, share = sketch_size(n), percent / 100
    return max(1, math.floor(s * share - 5 * math.sqrt(s * share * (1 - share))))


def _index(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in pieces(b.column("text")):
                h, first = shingle_sets(data, offs)
                n = np.diff(first)
                kept = np.array([sketch_size(int(x)) for x in n], np.int64)
                need = np.array([needed(int(x), percent) for x in n], np.int32)
                part = np.array([int(x).bit_length() for x in n], np.int32)
                item = np.repeat(np.arange(hi - lo), n)
                take = np.arange(len(h)) - first[item] < kept[item]
                item = item[take]
                rows = pa.array(item + lo)
                yield rows_of(_INDEX_ARROW, b.column("k1").take(rows), b.column("k2").take(rows), n[item], part[item], need[item],
                              signed(h[take]))
    return run


def index(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(i1, i2, n, part, need, v): sketch values of keyed items."""
    return items.mapInArrow(tidied(_index(percent)), _INDEX).distinct()


def bitmap(values: DataFrame) -> np.ndarray:
    """Which of BITS buckets hold a value. Collects at most BITS / 64 numbers."""
    shift = 64 - (BITS.bit_length() - 1)
    spot = F.shiftrightunsigned("v", shift)
    words = values.groupBy((spot / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(v, {shift}) % 64 as int))")).alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for w, bits in words:
        out[w] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


_HIT = "k1 long, k2 long, v long"
_HIT_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("v", pa.int64())])


def _hits(held, shingle: int = SHINGLE):
    shift = np.uint64(64 - (BITS.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            for lo, hi, data, offs in pieces(b.column("text")):
                starts, ends, first = split_words(LOWER[data], offs)
                sizes = np.diff(first)
                hashes = word_hashes(LOWER[data], starts, ends)
                doc = np.repeat(np.arange(hi - lo), sizes)
                grams = gram_hashes(hashes, shingle, 1)
                at = np.flatnonzero(bits[grams >> shift] & (doc[: len(grams)] == doc[shingle - 1 : len(grams) + shingle - 1]))
                short = np.flatnonzero((sizes > 0) & (sizes < shingle))
                whole = span_hashes(hashes, first[short], first[short] + sizes[short], 1)
                ok = bits[whole >> shift]
                h, d = np.concatenate([grams[at], whole[ok]]), np.concatenate([doc[at], short[ok]])
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                rows = pa.array(d[new] + lo)
                yield rows_of(_HIT_ARROW, b.column("k1").take(rows), b.column("k2").take(rows), signed(h[new]))
    return run


_FOUND = "k1 long, k2 long, i1 long, n_item long, shared long"
_FOUND_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("i1", pa.int64()), ("n_item", pa.int64()), ("shared", pa.int64())])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                both = []
                for side in ("item", "text"):
                    sets = []
                    for _, _, data, offs in pieces(part.column(side)):
                        h, first = shingle_sets(data, offs)
                        sets += [h[first[i] : first[i + 1]] for i in range(len(offs) - 1)]
                    both.append(sets)
                shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*both, strict=True)], np.int64)
                n = np.array([len(x) for x in both[0]], np.int64)
                ok = (shared > 0) & (100 * shared >= percent * n)
                if ok.any():
                    rows = pa.array(np.flatnonzero(ok))
                    yield rows_of(_FOUND_ARROW, *[part.column(c).take(rows) for c in ("k1", "k2", "i1")], n[ok], shared[ok])
    return run


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(k1, k2, i1, n_item, shared): documents (id, text hash) and the items they contain. Runs jobs while the plan is built."""
    rows, wanted = keyed(docs, id_col, text_col), keyed(items, item_col, item_text_col).toDF("k1", "k2", "text")
    held = stash(index(wanted, percent), "index")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(held))
    hits = rows.mapInArrow(tidied(_hits(bits)), _HIT)
    likely = (hits.join(held, "v").groupBy("k1", "k2", "i1", "i2", "need").agg(F.countDistinct("v").alias("c")).where("c >= need")
              .select("k1", "k2", "i1", "i2"))
    likely = stash(likely, "candidates")
    texts = rows.join(likely, same_row(rows, likely)).select(rows["k1"], rows["k2"], "text", "i1", "i2")
    named = wanted.toDF("j1", "j2", "item").distinct()
    return (texts.join(named, F.col("i1").eqNullSafe(F.col("j1")) & (F.col("i2") == F.col("j2")))
            .select("k1", "k2", "i1", "text", "item").mapInArrow(tidied(_confirm(percent)), _FOUND).distinct())


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item, all columns as they were."""
    bad = contained(docs, items, id_col, text_col, **options).select("k1", "k2").distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["k1"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["k2"]),
                     "left_anti")

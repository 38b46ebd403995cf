"""Substring dedup by relative Lempel-Ziv parsing.

Every document is a reference for every other. A reference block is a stretch of words that
is chosen by its content: among the 28 eight-word runs of a window the one with the smallest hash
(the last one on a tie) is the window's anchor, and the windows that share an anchor form one block
of 35 to 62 words. Equal windows have equal anchors wherever they stand, so two texts that share 35
words share an anchor at the same place.

1. All blocks of all documents are indexed by (anchor, hash of the block). Counting them is a
   grouped aggregate with partial sums, which also keeps the first and the last place of each block; anchors that
   occur once drop out.
2. A document is factored greedily from left to right against that index: a block that occurs elsewhere opens a factor,
   a copy from that place, and following blocks extend it as long as they stand next to each other and are copied
   from the same document at the same distance. A factor has a source, a place in it and a length in words; those of
   ``window`` words or more are duplicate spans.
3. At the boundaries of factors (anchors that stand in different blocks) the index can't tell how far
   a copy reaches. There single windows are hashed and counted.

Blocks and windows are told apart by 128 bits (an anchor and a window, from two independent hashes of words). No pair of
documents is ever formed, so a passage in a third of all documents costs one row for each of them.

A very long text is taken alone in its task: its words and blocks are arrays there (about 60 bytes for each word).
Cases: a null or empty text has no words and no factors; a text shorter than the window is kept;
a passage repeated within one document counts, overlapping ones too; rows with equal id and text
are two documents, so both lose their windows; null ids are kept; other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (gram_hashes, keyed, pieces, ranges, rows_of, same_row, signed, span_hashes, split_words, stash,
                     strings, text_hash, tidied, word_hashes)

WINDOW, ANCHOR = 35, 8

# Independent hashes of words: for anchors, and for blocks and windows.
BY_ANCHOR, BY_BLOCK = 0, 4

_BLOCK = "k1 long, k2 long, lo int, hi int, anchor long, block long"
_BLOCK_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()),
                          ("anchor", pa.int64()), ("block", pa.int64())])
_WINDOW = "k1 long, k2 long, at int, anchor long, win long, whole boolean, src long"
_WINDOW_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("anchor", pa.int64()),
                           ("win", pa.int64()), ("whole", pa.bool_()), ("src", pa.int64())])


def last_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the smallest, the last one on a tie."""
    v, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = v[step:] <= v[:-step]
        v, at = np.where(right, v[step:], v[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at


def blocks_of_words(hashes: np.ndarray, others: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """(text, lo, hi, anchor hash, block hash): blocks of windows lo..hi, in words from the start of all texts.

    ``others`` are the words' hashes of the second kind.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    runs = gram_hashes(hashes, anchor, 1)
    place = last_smallest(runs, window - anchor + 1)
    sizes = np.maximum(np.diff(first) - window + 1, 0)
    text = np.flatnonzero(sizes)
    at, which = ranges(first[:-1][text], first[:-1][text] + sizes[text] - 1)
    at = at.astype(np.int64)
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    chosen = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (which[1:] != which[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(at)) - 1
    lo, hi = at[begins], at[ends]
    return text[which[begins]], lo, hi, runs[chosen[begins]], span_hashes(others, lo, hi + window, 2)


def _index(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column("k1"), b.column("k2")
            for lo, hi, data, offs in pieces(b.column("text")):
                starts, ends, first = split_words(data, offs)
                text, a, z, key, block = blocks_of_words(word_hashes(data, starts, ends, BY_ANCHOR), word_hashes(data, starts, ends, BY_BLOCK),
                                                            first, window, anchor)
                rows = pa.array(text + lo)
                yield rows_of(_BLOCK_ARROW, k1.take(rows), k2.take(rows), (a - first[text]).astype(np.int32),
                              (z - first[text]).astype(np.int32), signed(key), signed(block))
    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, parts = b.column("k1"), b.column("k2"), b.column("parts")
            of = parts.offsets.to_numpy()
            flat = parts.values
            cols = {n: flat.field(n) for n in ("lo", "hi", "anchor", "whole", "src")}
            for lo, hi, data, offs in pieces(b.column("text")):
                starts, ends, first = split_words(data, offs)
                p0, p1 = of[lo], of[hi]
                row = np.repeat(np.arange(hi - lo), np.diff(of[lo : hi + 1]))
                a, z = (cols[n].slice(p0, p1 - p0).to_numpy() for n in ("lo", "hi"))
                at, which = ranges(a.astype(np.int64), z.astype(np.int64))
                here = at + first[row[which]]
                win = gram_hashes(word_hashes(data, starts, ends, BY_BLOCK), window, 3)[here]
                pick, part = pa.array(row[which] + lo), pa.array(which + p0)
                yield rows_of(_WINDOW_ARROW, k1.take(pick), k2.take(pick), at.astype(np.int32),
                              cols["anchor"].take(part), signed(win), cols["whole"].take(part), cols["src"].take(part))
    return run


def blocks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Every reference block of keyed documents."""
    return docs.mapInArrow(tidied(_index(window, anchor)), _BLOCK)


def parse(again: DataFrame, window: int = WINDOW) -> DataFrame:
    """Greedy factors (k1, k2, lo, hi, src, src_lo, n_words) of blocks that are copies of a place (src, src2, src_lo).

    A factor goes on while blocks follow each other both in the document and in its source.
    """
    order = Window.partitionBy("k1", "k2").orderBy("lo", "hi")
    shift = F.col("src_lo") - F.col("lo")
    goes_on = ((F.lag("hi").over(order) + 1 == F.col("lo")) & (F.lag(shift).over(order) == shift)
               & F.lag("src").over(order).eqNullSafe(F.col("src")) & (F.lag("src2").over(order) == F.col("src2")))
    placed = again.withColumn("opens", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    placed = placed.withColumn("factor", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n_words = F.col("hi") - F.col("lo") + window
    return (placed.groupBy("k1", "k2", "factor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("src").alias("src"), F.min("src_lo").alias("src_lo"))
            .select("k1", "k2", "lo", "hi", "src", "src_lo", n_words.alias("n_words")).where(n_words >= window))


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
            anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, lo, hi, src): windows lo..hi of a document stand elsewhere too, in document ``src`` among others.

    Runs jobs while the plan is built: the repeated blocks are written to the shared folder.
    """
    rows = keyed(docs, id_col, text_col)
    every = blocks(rows, window, anchor)
    known = (every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("least"), F.max("block").alias("most"))
             .where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("mixed")))
    # Counts are written before they are joined back, so that Spark may split the rows of an anchor that is everywhere.
    known = stash(known, "anchors")
    again = stash(every.join(known, "anchor"), "blocks")
    place = F.struct("k1", "k2", "lo")
    copies = (again.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("n > 1")
              .select("anchor", "block", "first", "last", F.lit(True).alias("whole")))
    copies = stash(copies, "copies")
    # A document copies from the first place of a block; the first place itself from the last one.
    src = F.when(F.col("first") == place, F.col("last")).otherwise(F.col("first"))
    found = stash(again.join(copies, ["anchor", "block"], "left").where("mixed or whole")
                  .select("k1", "k2", "lo", "hi", "anchor", F.coalesce("whole", F.lit(False)).alias("whole"), "mixed", (F.col("first") == place).alias("is_first"),
                          src["k1"].alias("src"), src["k2"].alias("src2"), src["lo"].alias("src_lo")), "factors")
    # Ends of factors. One copy of a repeated block stands for all of them.
    open_ = (found.where("mixed and (not whole or is_first)").groupBy("k1", "k2")
             .agg(F.collect_list(F.struct("lo", "hi", "anchor", "whole", "src")).alias("parts")))
    single = stash(rows.join(open_, same_row(rows, open_)).select(rows["k1"], rows["k2"], "text", "parts")
                   .mapInArrow(tidied(_windows(window)), _WINDOW), "windows")
    hits = (single.groupBy("anchor", "win").agg(F.count("*").alias("n"), F.max("whole").alias("sure"), F.min("k1").alias("src"))
            .where("n > 1 or sure").select("anchor", "win", "src"))
    hits = stash(hits, "hits")
    ends = (single.where("not whole").drop("src").join(hits, ["anchor", "win"])
            .select("k1", "k2", F.col("at").alias("lo"), F.col("at").alias("hi"), "src"))
    whole = found.where("whole").select("k1", "k2", "lo", "hi", "src", "src2", "src_lo")
    return parse(whole, window).select("k1", "k2", "lo", "hi", "src").unionByName(ends)


_KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                         ("spans", _SPANS)])


def keep_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray):
    """Kept words of each text joined by one space: bytes and offsets."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s, e, text = starts[keep], ends[keep], text[keep]
    inner = np.zeros(len(s), bool)
    inner[:-1] = text[1:] == text[:-1]
    edge = np.zeros(len(data) + 1, np.int32)
    edge[s] += 1
    edge[e] -= 1
    taken = np.cumsum(edge[:-1]) > 0
    out = data.copy()
    out[e[inner]] = 0x20  # a byte that parts two words of one text
    taken[e[inner]] = True
    sizes = np.bincount(text, weights=(e - s) + inner, minlength=len(first) - 1).astype(np.int64)
    return out[taken], np.append(0, np.cumsum(sizes))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts = b.column("k1"), b.column("parts")
            of, flat = parts.offsets.to_numpy(), parts.values
            lo_of, hi_of = flat.field("lo"), flat.field("hi")
            empty = parts.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in pieces(b.column("text")):
                starts, ends, first = split_words(data, offs)
                cover = np.zeros(len(starts) + 1, np.int64)
                p0, p1 = of[lo], of[hi]
                sizes = np.diff(of[lo : hi + 1]) * ~empty[lo:hi]
                row = np.repeat(np.arange(hi - lo), sizes)
                if len(row):
                    np.add.at(cover, lo_of.slice(p0, p1 - p0).to_numpy() + first[row], 1)
                    np.add.at(cover, hi_of.slice(p0, p1 - p0).to_numpy() + first[row] + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                text, text_offs = keep_words(data, starts, ends, first, ~gone)
                sums = np.append(0, np.cumsum(gone))
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                start = gone.copy()
                start[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
                stop = gone.copy()
                stop[:-1] &= ~gone[1:] | (doc[1:] != doc[:-1])
                s, e = np.flatnonzero(start), np.flatnonzero(stop)
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(s, first).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array((s - first[doc[s]]).astype(np.int32)),
                                                pa.array((e + 1 - first[doc[e]]).astype(np.int32))], ["start", "stop"]))
                yield rows_of(_KEPT_ARROW, ids.slice(lo, hi - lo), np.diff(first), np.diff(sums[first]),
                              strings(text, text_offs), spans.cast(_SPANS))
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated words taken out of the texts, all other columns as they were.

    Texts without a repeated window stay as they are; of others the kept words are joined by one space.
    """
    found = factors(docs, id_col, text_col, window, anchor).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    place = docs.columns.index(text_col)
    joined = docs.join(found, docs[id_col].cast("long").eqNullSafe(found["k1"]) & (text_hash(text_col) == found["k2"]), "left")
    joined = joined.select(*[docs[c] for c in docs.columns], found["k1"].alias("k1"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
                           found["parts"].alias("parts"))
    width, docs_names, cut = len(docs.columns), docs.columns, _cut(window)
    joined = joined.toDF(*[f"c{i}" for i in range(width + 3)])  # names of documents may be those of helpers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.RecordBatch.from_arrays(b.columns[width:], names=["k1", "text", "parts"])
            done = pa.Table.from_batches(list(cut(iter([own])))).combine_chunks()
            changed = pc.greater(done.column("n_removed"), 0).combine_chunks()
            texts = pc.if_else(changed, done.column("kept").combine_chunks(), b.column(place).cast(pa.string()))
            cols = b.columns[:width]
            cols[place] = texts
            yield pa.RecordBatch.from_arrays(cols, names=docs_names)
    return joined.mapInArrow(tidied(run), docs.schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          anchor: int = ANCHOR) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (text), spans (words start..stop that were removed)."""
    rows = keyed(docs, id_col, text_col)
    parts = (factors(docs, id_col, text_col, window, anchor).groupBy("k1", "k2")
             .agg(F.collect_list(F.struct("lo", "hi")).alias("parts")))
    return (rows.join(parts, same_row(rows, parts), "left").select(rows["k1"], "text", "parts")
            .mapInArrow(tidied(_cut(window)), _KEPT))

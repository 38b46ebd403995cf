"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles (A-Z lower-cased). Its sketch is the
``k`` smallest values of one hash over that set.

1. Documents with equal sets (equal size and 128-bit digest) are one class; its smallest id represents it.
2. Inverted lists: retained value -> classes. Values held by one class drop out. Of what is left a class
   is listed only under its rarest values: two sets that are similar enough share at least
   ``list_share`` of their retained values (half at a similarity of 0.85 and k = 32; the chance of fewer is below one in a
   million), so they must meet in the rarest of them, the rest plus one. A passage common to many texts
   is a frequent value and opens no list for texts that are mostly their own.
3. Each list compares its members with one hub, the member whose values are most shared. Links found
   give components; a list whose members are all in one component is done; the others go on with other
   hubs. So thousands of near copies of one text cost one comparison each and list, not one for each pair.
   Classes that are still in lists of several components get lists by their full sets, where only the rarest
   15 % of a set count; members of different components are compared there.
4. A pair is compared only if the sizes allow it; with hubs also only if the estimate from the sketch of the union is
   near the threshold. Then the full sets decide. What the estimate leaves out goes on to the lists by full sets.

Cases: a text without words, or null, has an empty set and is linked with nothing; with one to four words the
whole sequence is the one shingle; rows with equal ids are one document; rows without an id are linked
with nothing and kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (LOWER, gram_hashes, keyed, mix, pieces, rows_of, signed, span_hashes, split_words, stash, tidied, word_hashes)
from .components import components

SHINGLE, SKETCH, PERCENT = 5, 32, 85
HUB_ROUNDS = 1    # rounds in which lists compare with hubs only

_SKETCH = "id long, k2 long, n long, d1 long, d2 long, sketch array<long>"
_SKETCH_ARROW = pa.schema([("id", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                           ("sketch", pa.list_(pa.int64()))])


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by text and value, and the place of the first one of each text."""
    data = LOWER[data]
    texts = len(offs) - 1
    starts, ends, first = split_words(data, offs)
    sizes = np.diff(first)
    hashes = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(texts), sizes)
    grams = gram_hashes(hashes, k, 1)
    at = np.flatnonzero(doc[: len(grams)] == doc[k - 1 : len(grams) + k - 1])
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    h = np.concatenate([grams[at], span_hashes(hashes, first[short], first[short] + sizes[short], 1)])
    d = np.concatenate([doc[at], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(texts + 1))


def _sketches(k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in pieces(b.column("text")):
                h, first = shingle_sets(data, offs, shingle)
                n = np.diff(first)
                digests = []
                for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt))))
                    digests.append(signed(sums[first[1:]] - sums[first[:-1]]))
                held = np.arange(len(h)) - np.repeat(first[:-1], n) < k
                sketch = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(n, k))).astype(np.int32)),
                                                  pa.array(signed(h[held])))
                yield rows_of(_SKETCH_ARROW, b.column("k1").slice(lo, hi - lo), b.column("k2").slice(lo, hi - lo), n,
                              *digests, sketch)
    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH,
             shingle: int = SHINGLE) -> DataFrame:
    """(id, k2, n, d1, d2, sketch): set size, digest of the set, its ``k`` smallest hashes in rising order."""
    return keyed(docs, id_col, text_col).mapInArrow(tidied(_sketches(k, shingle)), _SKETCH)


def estimate(a: Column, b: Column, k: int) -> Column:
    """Similarity from the sketch of the union: the share of its values that both sketches hold.

    Hashes are compared as signed numbers, which orders them otherwise than the sketches' own
    unsigned order; adding the lowest long restores it.
    """
    low = F.lit(-(2**63)).cast("long")
    flip = lambda c: F.transform(c, lambda v: v.bitwiseXOR(low))
    union = F.slice(F.array_sort(F.array_union(flip(a), flip(b))), 1, k)
    return F.size(F.array_intersect(F.array_intersect(flip(a), flip(b)), union)) / F.size(union)


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


_LINK = "a long, b long"
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(percent: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                both = []
                for side in ("text_a", "text_b"):
                    sets = []
                    for _, _, data, offs in pieces(part.column(side)):
                        h, first = shingle_sets(data, offs, shingle)
                        sets += [h[first[i] : first[i + 1]] for i in range(len(offs) - 1)]
                    both.append(sets)
                ok = []
                for x, y in zip(*both, strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                if any(ok):
                    yield part.select(["a", "b"]).filter(pa.array(ok)).cast(_LINK_ARROW)
    return run


def likely(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate is near the threshold. Says which pairs are worth a look first, and decides nothing."""
    s = reps.select("id", "sketch")
    a, b = s.toDF("a", "sketch_a"), s.toDF("b", "sketch_b")
    share = percent / 100
    margin = 5 * (share * (1 - share) / k) ** 0.5  # five standard deviations of the estimate
    return (pairs.join(a, "a").join(b, "b").where(estimate(F.col("sketch_a"), F.col("sketch_b"), k) >= share - margin)
            .select("a", "b").distinct())


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    return (pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
            .select("a", "b", "text_a", "text_b").mapInArrow(tidied(_confirm(percent, shingle)), _LINK))


def list_share(k: int, percent: int) -> float:
    """Share of ``k`` retained values that similar enough sets have in common, but for a chance of one in a million."""
    p, chance, m = percent / 100, 0.0, 0
    while m < k and (chance := chance + math.comb(k, m) * p**m * (1 - p) ** (k - m)) <= 1e-6:
        m += 1
    return max(m, 1) / k


def listed(reps: DataFrame, share: float) -> DataFrame:
    """(v, place, id, n, weight): the lists under which a class stands.

    place: of the value in the class's order by rarity, from 1; weight: how much its values are shared.
    Two classes that hold ``share`` of each other's values in common meet in one list at least.
    """
    held = reps.select("id", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    shared = held.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    by_class = (held.join(shared, "v").groupBy("id", "n", "m")
                .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("weight")))
    # The values of its own come first in the order by rarity; they open no list but take their places.
    room = F.col("m") - F.ceil(F.col("m") * share - 1e-9).cast("int") + 1 - (F.col("m") - F.size("vs"))
    return (by_class.where(room > 0)
            .select("id", "n", "weight", (F.col("m") - F.size("vs") + 1).alias("start"), F.posexplode(F.slice("vs", F.lit(1), room)).alias("at", "x"))
            .select("x.v", (F.col("start") + F.col("at")).alias("place"), "id", "n", "weight"))


def _with_components(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Lists that hold several components, with the component of each member."""
    if comp is None:
        return lists.withColumn("comp", F.col("id"))
    rows = lists.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = rows.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("v")
    return stash(rows.join(several, "v"), "open")


def _hub_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a list with the list's hub: the most shared member, in later turns any other."""
    first = F.col("weight") if turn == 0 else F.xxhash64("id", F.lit(turn))
    order = F.struct(first, -F.col("id"), "id", "n", "comp")
    hubs = rows.groupBy("v").agg(F.max(order).alias("hub"))
    return (rows.join(hubs, "v").where("id <> hub.id and comp <> hub.comp")
            .where(_sizes_allow(F.col("n"), F.col("hub.n"), percent)).select("id", F.col("hub.id").alias("other")))


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Members of one list of full sets that are in different components and may still be similar enough.

    At the rarest value that two sets share, what they have in common can't be more than that value and
    all less rare ones of either set; pairs that can't reach the threshold go out in the join.
    """
    x, y = rows.alias("x"), rows.alias("y")
    most = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return (x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.comp") < F.col("y.comp"))
                   & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))))
            .select(F.col("x.id").alias("id"), F.col("y.id").alias("other")))


def class_components(docs: DataFrame, reps: DataFrame, known: DataFrame, id_col: str, text_col: str, k: int, percent: int,
                     shingle: int) -> DataFrame:
    """(id, comp) of the representatives that have a link; ``known``: pairs (a, b) that belong together anyway."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lists = stash(listed(reps, list_share(k, percent)), "lists")
    found, comp, tried = known, None, None
    for turn in range(HUB_ROUNDS + 1):
        rows = _with_components(lists, comp)
        if turn < HUB_ROUNDS:
            pairs = _hub_pairs(rows, turn, percent)
        else:
            # What is left: classes that share much with others and yet are in several components. Their full
            # sets have lists of their own, so short that all members may be compared, and nothing is left to chance.
            full = keyed(docs, id_col, text_col).join(rows.select(F.col("id").alias("k1")).distinct(), "k1", "left_semi")
            full = (full.select("k1", "k2", "text").mapInArrow(tidied(_sketches(2**31 - 1, shingle)), _SKETCH)
                    .select("id", "n", "sketch").distinct())
            pairs = _open_pairs(_with_components(stash(listed(full, percent / 100), "lists"), comp), percent)
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        # The estimate only picks what hubs are compared with; pairs that it leaves out are open to the last round.
        pairs = stash(likely(pairs, reps, k, percent) if turn < HUB_ROUNDS else pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        new = stash(confirmed(pairs, texts, percent, shingle), "links")
        found = found.union(new)
        if comp is None or not new.isEmpty():
            comp = components(found)
    return comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH, percent: int = PERCENT,
                    shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, k2 (hash of the text), n_shingles, component_id, kept. Runs jobs while the plan is built."""
    every = stash(sketches(docs, id_col, text_col, k, shingle), "sketches")
    real = every.where("n > 0 and id is not null")
    classes = real.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    member = stash(real.select("id", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("id", "rep").distinct(), "members")
    reps = (real.join(classes.withColumnRenamed("rep", "id"), ["id", "d1", "d2", "n"], "left_semi")
            .select("id", "n", "sketch").distinct())
    own = member.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    repeated = member.join(own.where("rep <> other").select("id", F.col("rep").alias("b")), "id").select(F.col("rep").alias("a"), "b")
    comp = class_components(docs, reps, repeated, id_col, text_col, k, percent, shingle)
    # A representative is the smallest id of its class, so the smallest one reached is the smallest of all.
    of = own.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("comp"))
    return (every.join(of, "id", "left")
            .select(F.col("id").alias("doc_id"), "k2", F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each group, all columns as they were: the one with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)

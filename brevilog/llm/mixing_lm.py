"""Language-model scoring by logistic context mixing.

A text is the byte string of its words (A-Z lower-cased) joined by one space, and an end byte. Every byte is
coded by a binary code tree, frequent bytes by few bits. For each bit several predictors look up a
context (the last two, three, four, six bytes; the word so far) and the place in the tree:

* How often each byte follows each context in the training texts grows with the texts and is never collected. Texts are dealt
  into blocks of up to ``BLOCK_BYTES``. A block gives each distinct pair of a context and a byte once, with how often its training
  texts have it, packed into one row for each bucket of contexts. A bucket adds up what all blocks gave, and answers each block
  with what follows its contexts anywhere. Texts are read a second time and meet these answers by block. Counts of a place in
  the tree are sums over the bytes below it, which stand side by side. Contexts of bytes are exact; words are told apart by 56 bits.
* The predictors' log-odds are mixed by weights. Which weights is decided by a gate: the depth in the
  code tree and whether a word begins. Weights start from a fit on all training texts, each part of a block without
  its own counts: places with the same contexts and byte count as one with a weight, pieces of them are fitted by Newton's method,
  and fits are put together by their curvatures, which Spark adds up. Weights are learned online within each text, after 64, 192,
  448, and then every ``STRIDE`` bits of a gate.
* The mixed log-odds are refined by an adaptive table over their size, learned online likewise.

Weights are fitted and learned by Mixing.java, block by block. ``path_odds``, ``bits_of``, ``mix_stream`` and ``fit`` are the same in
numpy, place by place, which tests hold it against. Blocks are moved to their answers in WAVES groups.

The score is the sum of log10 of the probabilities of all bits: the log10 probability of the text. Each text starts
afresh, so a score doesn't depend on other rows or partitions.

The base is a unigram model of tokens (words and one end): sum of log10((c + 1) / (N + V + 1)). Counts are exact: a block
of documents gives its distinct words packed by bucket, and which documents hold them; buckets add them up and answer each block,
where counts meet their documents.

Cases: a null or empty text is one end; a text of one very long word is scored whole; without training
rows the table is empty and every bit costs about one bit; rows equal in id and text score alike; a null id counts as
the text '' for the fold; other columns are not read; an empty table gives an empty result.
The input should come from a scan or a written table: it is read several times, and its parts must have the same rows in the
same order each time. A block that doesn't fit its answers raises IndexError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .bpe import pack, unpack
from .common import IS_WORD, LOWER, keyed, mix, pieces, ranges, rows_of, signed, split_words, stash, tidied, tidy, utf8, word_hashes
from .jvm import function

LENGTHS = (2, 3, 4, 6)   # contexts of so many bytes; besides them the word so far
ORDERS = len(LENGTHS) + 1
GATES = 6
FIT_STEPS = 4        # of Newton's method on a piece
PRIOR, PULL = 0.3, 5.0  # weight of an input that nothing is known of, and the curvature that it counts for
SPAN = 6
PAD, END = SPAN, 10
FIRST, STRIDE = 64, 256  # bits of a gate before its weights are first learned, and at most from one time to the next
FADE = 0.95         # of the weight of what a text taught, from one time to the next
COUNT_BYTES = 1 << 19
BLOCK_BYTES, BLOCKS = 8 << 20, 12  # of a block at most, and how many blocks there are at least, unless they get small
WAVES = 3            # groups of blocks that are moved one after the other
BUCKET_BYTES, MIN_BUCKETS = 1 << 23, 16  # bytes of text for one bucket of contexts
PART_BYTES, PARTS = 1 << 22, 8  # of training texts that go without their own counts: at most so many bytes, and at least so many parts of all texts
FIT_PLACES = 1 << 17  # that are fitted as a piece
HELD = 50.0         # weight of what was known before a text, in bits
BUCKETS = 17
BLOCK_TOKENS = 1_000_000


def held_out(ids: Column, parts: int = 7, which: int = 2) -> Column:
    return F.coalesce(F.crc32(ids.cast("string")), F.lit(0)) % parts == which


# --- code tree ---------------------------------------------------------------------

@dataclass(frozen=True)
class Code:
    """For each byte: number of bits, and from ``first`` on the nodes and bits of its path."""
    size: np.ndarray
    first: np.ndarray
    node: np.ndarray
    sign: np.ndarray    # of bits: -1 and 1
    rank: np.ndarray    # of each byte in the order of codes, and the byte of each rank
    byte: np.ndarray
    alike: np.ndarray   # bits that the codes of two ranks begin with alike


def code_tree(counts: np.ndarray) -> Code:
    """Huffman's code for bytes with these counts (each taken one higher)."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[256 + len(kids)] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], 255 + len(kids), 255 + len(kids)))
    paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
    for n in sorted(kids, reverse=True):
        for bit, kid in enumerate(kids[n]):
            paths[kid] = [*paths[n], (n - 256, bit)]
    size = np.array([len(paths[i]) for i in range(256)])
    flat = [x for i in range(256) for x in paths[i]]
    byte = np.array(sorted(range(256), key=lambda i: [bit for _, bit in paths[i]]))
    rank = np.empty(256, np.uint64)
    rank[byte] = np.arange(256)
    alike = np.full((256, 256), 0x7FFF, np.int16)
    for i in range(255):
        a, b = (paths[v] for v in byte[i : i + 2])
        next_to = next(d for d, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
        alike[: i + 1, i + 1 :] = np.minimum(alike[: i + 1, i + 1 :], next_to)
    return Code(size, np.cumsum(size) - size, np.array([n for n, _ in flat], np.uint32), np.array([b for _, b in flat], np.float32) * 2 - 1, rank, byte, alike)


# --- contexts ----------------------------------------------------------------------

def normal(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with PAD end bytes before and one after each; the places to predict, and the first one of each text."""
    data = LOWER[data]
    word = IS_WORD[data]
    # a separator is kept as a blank where the next byte starts a word that isn't its text's first
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    begin[offs[:-1][offs[:-1] < len(data)]] = False
    seen = np.append(0, np.cumsum(word, dtype=np.int32))
    gap = np.flatnonzero(begin)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(gap, offs)))
    gap = gap[seen[gap] > seen[offs[text]]] - 1
    data[gap] = 0x20
    word[gap] = True
    kept = np.append(0, np.cumsum(word, dtype=np.int32))[offs]
    n = np.diff(kept)
    out = np.full(int(kept[-1]) + len(n) * (PAD + 1), END, np.uint8)
    place = np.ones(len(out), bool)
    start = np.cumsum(n + PAD + 1) - (n + PAD + 1)
    for k in range(PAD):
        place[start + k] = False
    at = np.flatnonzero(place)
    place[start + PAD + n] = False
    out[place] = data[word]
    return out, at, np.append(0, np.cumsum(n + 1))


_ROLL = np.uint64(0xD1342543DE82EF95)
_powers: tuple[np.ndarray, np.ndarray] = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _rolls(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse, kept from one call to the next."""
    global _powers
    if len(_powers[0]) < n:
        up, down = (np.full(2 * n, v, np.uint64) for v in (_ROLL, pow(int(_ROLL), -1, 2**64)))
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def rolling_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] of any number of overlapping spans, from prefix sums: contexts of words so far.

    A polynomial modulo 2^64; spans that share a hash share a context, which is how hashed contexts are meant.
    """
    up, down = _rolls(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def six_bytes(code: Code, out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pairs: the six bytes before each place, the last one lowest, with the rank of the byte that follows in the lowest eight bits."""
    lanes = np.ndarray((len(out) + 1,), ">u8", np.concatenate([np.zeros(8, np.uint8), out]), strides=(1,))
    pairs = lanes[at].astype(np.uint64)
    pairs <<= np.uint64(16)
    pairs >>= np.uint64(8)
    pairs |= code.rank[out[at]]
    return pairs


def long_words(code: Code, out: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (which of them) with six bytes or more of a word before them; pairs of a hash of the word so far and the byte that follows."""
    edge = (out == 0x20) | (out == END)
    near = edge.copy()  # an edge among these six bytes
    for k in range(1, 6):
        near[k:] |= edge[:-k]
    which = np.flatnonzero(~near[at - 1])
    at = at[which]
    begin = np.maximum.accumulate(np.where(edge, np.arange(len(out), dtype=np.int32), 0))[at - 1] + 1
    pairs = rolling_hashes(out.astype(np.uint64) + np.uint64(1), begin, at)
    pairs &= ~np.uint64(255)
    pairs |= code.rank[out[at]]
    return which, pairs


def short_words(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of six bytes (which of them) that tell the word so far, and the same pairs as in ``long_words`` of these words."""
    letters = np.full(len(pairs), 6, np.int8)
    for k in reversed(range(6)):
        byte = (pairs >> np.uint64(8 * k + 8)).astype(np.uint8)
        letters[(byte == 0x20) | (byte == END)] = k
    places, found = [], []
    for n in range(6):
        at = np.flatnonzero(letters == n)
        mine, power, hashes = pairs[at], np.uint64(1), np.zeros(len(at), np.uint64)
        for k in reversed(range(n)):
            hashes += ((mine >> np.uint64(8 * k + 8) & np.uint64(255)) + np.uint64(1)) * power
            power = np.uint64(int(power) * int(_ROLL) & 2**64 - 1)
        places.append(at)
        found.append(mix(hashes + np.uint64(n)) & ~np.uint64(255) | mine & np.uint64(255))
    return np.concatenate(places), np.concatenate(found)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and the sum of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(_new_keys(keys))
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and how often they occur. Sorts the keys in place."""
    keys.sort()
    at = np.flatnonzero(_new_keys(keys))
    return keys[at], np.diff(np.append(at, len(keys)))


# --- packed numbers ----------------------------------------------------------------

def _press(values: np.ndarray) -> bytes:
    """64-bit numbers by place of their bytes, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _release(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def packed(parts: list[np.ndarray]) -> bytes:
    """Pairs of each order in rising order: where a context begins, differences of contexts, and ranks."""
    new = np.concatenate([_new_contexts(p) for p in parts])
    flat = np.concatenate(parts)
    ctx = flat[new] >> np.uint64(8)
    ctx[1:] -= ctx[:-1].copy()
    held = [_press(ctx), *(zstandard.ZstdCompressor(level=3).compress(v.tobytes()) for v in (np.packbits(new), flat.astype(np.uint8)))]
    return np.array([*(len(p) for p in parts), *(len(h) for h in held)], np.int64).tobytes() + b"".join(held)


def unpacked(held: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(held[: 8 * (ORDERS + 3)], np.int64)
    ends = 8 * (ORDERS + 3) + np.append(0, np.cumsum(sizes[ORDERS:]))
    ctx, new, rank = (held[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False))
    new, rank = (np.frombuffer(zstandard.ZstdDecompressor().decompress(v), np.uint8) for v in (new, rank))
    ctx = np.cumsum(_release(ctx), dtype=np.uint64) << np.uint64(8)
    pairs = ctx[np.cumsum(np.unpackbits(new, count=len(rank)), dtype=np.int64) - 1] | rank if len(rank) else ctx
    return np.split(pairs, np.cumsum(sizes[:ORDERS])[:-1])


def _pack_counts(parts: list[np.ndarray]) -> bytes:
    return _press(np.concatenate([p.astype(np.uint64) for p in parts]))


def _unpack_counts(held: bytes) -> np.ndarray:
    return _release(held).view(np.int64)


def _new_keys(keys: np.ndarray) -> np.ndarray:
    return np.append(True, keys[1:] != keys[:-1])[: len(keys)]


def _new_contexts(pairs: np.ndarray) -> np.ndarray:
    """Whether a pair is the first one of its context, for pairs of which those of a context stand side by side."""
    return _new_keys(pairs >> np.uint64(8))


def _bucket_of(pairs: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Contexts that begin alike go to one bucket, where they take fewer bytes; hashes of words are dealt out by their highest bits."""
    if order == ORDERS - 1:
        return (pairs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return mix(pairs >> np.uint64(24 if LENGTHS[order] > 3 else 16)) % np.uint64(buckets)


# --- counting ----------------------------------------------------------------------

_BYTES_ARROW = pa.schema([("byte", pa.int32()), ("n", pa.int64())])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte is to be predicted in training texts, and as number 256 the bytes of all texts."""
    seen = np.zeros(257, np.int64)
    for b in batches:
        learn = b.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        seen[256] += int(np.diff(utf8(b.column("text"))[1]).sum())
        for _, _, data, offs in pieces(b.filter(pa.array(learn)).column("text"), COUNT_BYTES):
            starts, _, first = split_words(data, offs)
            n = np.bincount(LOWER[data], minlength=256)
            n[~IS_WORD] = 0
            n[0x20] += len(starts) - np.count_nonzero(np.diff(first))
            n[END] += len(offs) - 1
            seen[:256] += n
    yield rows_of(_BYTES_ARROW, np.arange(257, dtype=np.int32), seen)


def byte_code(rows: DataFrame) -> tuple[Code, int]:
    """Code of the bytes of all training texts, and the bytes of all texts. Runs a job."""
    seen = np.zeros(257, np.int64)
    for byte, n in rows.select("learn", "text").mapInArrow(_bytes, "byte int, n long").groupBy("byte").agg(F.sum("n")).collect():
        seen[byte] = n
    return code_tree(seen[:256]), int(seen[256])


# A block's pairs that fall into a bucket, and how often its training texts have them; or (bucket -1) a block's texts.
_PARTS = "block long, bucket long, pairs binary, n binary"
_PARTS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("pairs", pa.binary()), ("n", pa.binary())])
_TEXTS_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("learn", pa.bool_()), ("text", pa.string())])


def _dealt(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows dealt into blocks of about ``most`` bytes, in slices of up to COUNT_BYTES; the same each time for the same rows."""
    number, size = TaskContext.get().partitionId() << 32, 0
    rows: list[pa.RecordBatch] = []
    for b in batches:
        b = pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in _TEXTS_ARROW], schema=_TEXTS_ARROW)
        for lo, hi, data, _ in pieces(b.column("text"), min(most, COUNT_BYTES)):
            rows.append(b.slice(lo, hi - lo))
            size += len(data)
            if size >= most:
                yield number, rows
                rows, number, size = [], number + 1, 0
    if rows:
        yield number, rows


def _texts(most: int):
    """The texts of each block as one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _dealt(batches, most):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _TEXTS_ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(rows).combine_chunks())
            yield rows_of(_PARTS_ARROW, [number], [-1], [sink.getvalue().to_pybytes()], [None])
    return run


def _block_pairs(code: Code, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of each order in a block, and how often they occur in its training texts. ``held``: texts, places, which of these learn.

    Six bytes tell all shorter contexts, so only their pairs and those of longer words are taken from the texts.
    """
    cuts = np.cumsum([0, *(len(learn) for _, _, learn in held)])
    keys, words = np.empty(int(cuts[-1]), np.uint64), ([], [])
    for lo, hi, (out, place, learn) in zip(cuts, cuts[1:], held, strict=False):
        at = np.flatnonzero(place)
        np.left_shift(six_bytes(code, out, at), np.uint64(1), out=keys[lo:hi])
        keys[lo:hi] |= learn
        which, pairs = long_words(code, out, at)
        for k in (0, 1):
            words[k].append(pairs[learn[which] == k])
    keys, times = tally(keys)
    times[(keys & np.uint64(1)) == 0] = 0
    keys >>= np.uint64(1)
    first = np.flatnonzero(_new_keys(keys))
    six = keys[first], np.add.reduceat(times, first) if len(first) else times
    del keys, times
    found = [six]
    for length in LENGTHS[-2::-1]:
        pairs, n = found[-1]
        found.append(summed(pairs & np.uint64((1 << 8 * length + 8) - 1), n))
    (rest, none), (known, n) = (tally(np.concatenate(w)) for w in words)
    which, short = short_words(six[0])
    return [*found[::-1], summed(np.concatenate([short, known, rest]), np.concatenate([six[1][which], n, np.zeros_like(none)]))]


def _asked(code: Code, buckets: int, most: int):
    """The pairs of each block, by bucket of their context."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _dealt(batches, most):
            held = []
            for part in rows:
                for lo, hi, data, offs in pieces(part.column("text"), COUNT_BYTES):
                    out, at, first = normal(data, offs)
                    learn = np.repeat(part.column("learn").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
                    place = np.zeros(len(out), bool)
                    place[at] = True
                    held.append((out, place, learn))
            orders = []
            for order, (pairs, n) in enumerate(_block_pairs(code, held)):
                bucket = _bucket_of(pairs, order, buckets).astype(kind)
                by = np.argsort(bucket, kind="stable")
                orders.append((pairs[by], n[by], np.searchsorted(bucket[by], np.arange(buckets + 1))))
            for k in range(buckets):
                mine = [slice(cuts[k], cuts[k + 1]) for _, _, cuts in orders]
                if any(m.stop > m.start for m in mine):
                    yield rows_of(_PARTS_ARROW, [number], [k], [packed([p[m] for (p, _, _), m in zip(orders, mine, strict=True)])],
                                  [_pack_counts([n[m] for (_, n, _), m in zip(orders, mine, strict=True)])])
    return run


def beside(code: Code, pairs: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's own pairs as they are; others of their contexts summed up by the node at which they leave the paths of own ones.

    Counts of all places on paths of own pairs stay the same, whatever pair stands for its node.
    """
    rank, new, at = (pairs & np.uint64(255)).astype(np.uint8), _new_contexts(pairs), np.arange(len(pairs))
    ctx = np.cumsum(new, dtype=np.int32)
    other = np.flatnonzero(~own)
    left = np.maximum.accumulate(np.where(own, at, 0))[other]
    right = np.minimum.accumulate(np.where(own, at, len(at) - 1)[::-1])[::-1][other]
    leaves = np.full(len(pairs), -1, np.int16)
    leaves[other] = np.maximum(*(np.where(own[x] & (ctx[x] == ctx[other]), code.alike[rank[x], rank[other]], -1) for x in (left, right)))
    head = own | new
    head[1:] |= own[:-1] | (code.alike[rank[:-1], rank[1:]] <= leaves[1:])
    first = np.flatnonzero(head)
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


def _meet(t: pa.Table, code: Code, totals: bool) -> pa.Table:
    """Pairs of all blocks in one bucket. For each block: what follows its contexts in all training texts, and how often.

    With ``totals`` instead all pairs of training texts, as one row.
    """
    bucket = t.column("bucket")[0].as_py()
    blocks = t.column("block").to_pylist()
    pairs = [unpacked(x.as_py()) for x in t.column("pairs")]
    n = [np.split(_unpack_counts(x.as_py()), np.cumsum([len(p) for p in mine])[:-1]) for x, mine in zip(t.column("n"), pairs, strict=True)]
    answers: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ([-1] if totals else blocks)]
    for order in range(ORDERS):
        all_pairs, _ = tally(np.concatenate([p[order] for p in pairs]))
        total = np.zeros(len(all_pairs), np.int64)
        places = [np.searchsorted(all_pairs, p[order]) for p in pairs]
        for at, mine in zip(places, n, strict=True):
            total[at] += mine[order]
        wanted = total > 0
        if totals:
            answers[0].append((all_pairs[wanted], total[wanted]))
            continue
        new = _new_contexts(all_pairs)
        first = np.append(np.flatnonzero(new), len(all_pairs))
        number = np.cumsum(new) - 1
        for k, at in enumerate(places):
            c = number[at]
            c = c[np.append(True, c[1:] != c[:-1])[: len(c)]]
            near, _ = ranges(first[c], first[c + 1] - 1)
            own = np.zeros(len(all_pairs), bool)
            own[at] = True
            near = near[wanted[near] | own[near]]
            answers[k].append(beside(code, all_pairs[near], total[near], own[near]))
        del all_pairs, total, places
    del pairs, n
    held = [(packed([p for p, _ in a]), _pack_counts([v for _, v in a])) for a in answers]
    del answers
    tidy()
    return pa.table([pa.array([-1] if totals else blocks, pa.int64()), pa.array([bucket] * len(held), pa.int64()),
                     *(pa.array(v, pa.binary()) for v in zip(*held, strict=True))], schema=_PARTS_ARROW)


def _block_bytes(size: int) -> int:
    return min(BLOCK_BYTES, max(size // BLOCKS, COUNT_BYTES))


def met(rows: DataFrame, code: Code, size: int, totals: bool = False) -> DataFrame:
    """What follows the contexts of each block in all training texts, in parts by bucket; with ``totals`` the counts of each bucket."""
    buckets = max(MIN_BUCKETS, size // BUCKET_BYTES)
    asked = rows.select("k1", "k2", "learn", "text").mapInArrow(tidied(_asked(code, buckets, _block_bytes(size))), _PARTS)
    return asked.groupBy("bucket").applyInArrow(lambda t: _meet(t, code, totals), _PARTS)


LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}
_COUNTS_ARROW = pa.schema([("ctx", pa.int64()), ("held", pa.list_(pa.int64()))])


def counts_of(rows: DataFrame, code: Code, size: int) -> DataFrame:
    """(ctx, held): every context of the training texts with the bytes that follow it, each as count * 256 + byte.

    The number of a context's order is in its highest byte.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pairs, n in zip(b.column("pairs").to_pylist(), b.column("n").to_pylist(), strict=True):
                counts, lo = _unpack_counts(n), 0
                for order, p in enumerate(unpacked(pairs)):
                    ctx = p >> np.uint64(8)
                    first = np.flatnonzero(_new_contexts(p))
                    held = counts[lo : lo + len(p)] * 256 + code.byte[(p & np.uint64(255)).astype(np.int64)]
                    lo += len(p)
                    lists = pa.ListArray.from_arrays(np.append(first, len(p)).astype(np.int32), pa.array(held, pa.int64()))
                    yield rows_of(_COUNTS_ARROW, signed(ctx[first] | np.uint64(order << 56)), lists)
    return met(rows, code, size, totals=True).select("pairs", "n").mapInArrow(tidied(run), "ctx long, held array<long>")


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query are removed when it ends (what later ones need has been written by then), and large rows
    reach Python a few at a time."""
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def with_learn(rows: DataFrame) -> DataFrame:
    return rows if "learn" in rows.columns else rows.withColumn("learn", F.lit(True))


def context_counts(docs: DataFrame) -> DataFrame:
    """(ctx, held) of all texts, as in ``counts_of``."""
    rows = docs.select("text").withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long"), "learn": F.lit(True)})
    code, size = byte_code(rows)
    return counts_of(rows, code, size)


# --- blocks ------------------------------------------------------------------------

_OPEN = "k1 long, k2 long, learn boolean, text string, pairs array<binary>, n array<binary>"
_OPEN_ARROW = pa.schema([*_TEXTS_ARROW, ("pairs", pa.list_(pa.binary())), ("n", pa.list_(pa.binary()))])


def blocks_of(rows: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """Blocks one after the other: a row with the texts, then what is known of their contexts. Runs a small job.

    Rows are read a second time, and must come in the same parts and order as before; otherwise a pair is not found, an error.
    """
    last, blocks = known.agg(F.coalesce(F.max("block"), F.lit(0)), F.countDistinct("block")).first()
    tasks = (last >> 32) + 1
    texts = rows.select("k1", "k2", "learn", "text").mapInArrow(tidied(_texts(_block_bytes(size))), _PARTS)
    place = F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF) * tasks
    parts = max(tasks, blocks)
    return texts.unionByName(known).repartitionById(parts, (place % parts).cast("int")).sortWithinPartitions("block", "bucket")


def waves_of(blocks: DataFrame, size: int) -> list[DataFrame]:
    """Blocks in groups that are moved one after the other, so that what is moved takes less disk. The input is read for each group."""
    n = WAVES if size > WAVES * BLOCK_BYTES else 1
    return [blocks.where((F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF)) % n == k) for k in range(n)]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[bytes], list[bytes]]]:
    """Of each block its texts, its known pairs and their counts."""
    texts, pairs, n = None, [], []
    for b in batches:
        for bucket, p, c in zip(*(b.column(name) for name in ("bucket", "pairs", "n")), strict=True):
            if bucket.as_py() >= 0:
                pairs.append(p.as_py())
                n.append(c.as_py())
                continue
            if texts is not None:
                yield texts, pairs, n
                pairs, n = [], []
            with pa.ipc.open_stream(p.as_buffer()) as held:
                texts = held.read_all()
    if texts is not None:
        yield texts, pairs, n


def training_texts(blocks: DataFrame) -> DataFrame:
    """Training texts, block by block; the first one of a block brings the block's known pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, pairs, n in _opened(batches):
            texts = texts.filter(texts.column("learn")).combine_chunks()
            for lo in range(0, texts.num_rows, 1000):
                part = texts.slice(lo, 1000)
                none = [None] * (part.num_rows - (not lo))
                yield rows_of(_OPEN_ARROW, *(part.column(f.name).combine_chunks() for f in _TEXTS_ARROW),
                              *(none if lo else [v, *none] for v in (pairs, n)))
    return blocks.mapInArrow(tidied(run), _OPEN)


# What Mixing.java takes: numbers of the model, normal texts, where each begins, first texts of parts, and known pairs with their counts.
_TAKEN_ARROW = pa.schema([("model", pa.binary()), ("data", pa.binary()), ("starts", pa.binary()), ("parts", pa.binary()), ("known", pa.binary())])
_TAKEN = ", ".join(f"{name} binary" for name in _TAKEN_ARROW.names)


def taken(code: Code, weights: np.ndarray | None, texts: pa.Array, pairs: list[bytes], counts: list[bytes], part_bytes: int | None = None) -> list[pa.Array]:
    """Columns of _TAKEN for a block. Without weights these are to be fitted, each part of ``part_bytes`` without its own counts."""
    outs, starts = [np.zeros(0, np.uint8)], [np.zeros(1, np.int32)]
    for _, _, data, offs in pieces(texts, COUNT_BYTES):
        out, _, first = normal(data, offs)
        outs.append(out)
        starts.append((first[1:] + np.arange(1, len(first)) * PAD + starts[-1][-1]).astype(np.int32))
    parts = [0, *(hi for _, hi, _, _ in pieces(texts, part_bytes))] if part_bytes else []
    model = np.concatenate([[weights is not None, FIT_PLACES, FIT_STEPS, PRIOR, PULL, FIRST, STRIDE, FADE, HELD], code.size, code.rank,
                            (np.zeros((GATES, ORDERS)) if weights is None else weights).ravel(), code.sign]).astype(np.float64)
    known = b"".join(x for p, c in zip(pairs, counts, strict=True) for x in (np.array([len(p), len(c)], np.int64).tobytes(), p, c))
    held = model, np.concatenate(outs), np.concatenate(starts), np.array(parts, np.int32), known
    return [pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, b.size], np.int32)), b]) for b in map(pa.py_buffer, held)]


def path_odds(code: Code, pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds on the paths of all pairs, one path after the other, and where each path begins. Unknown is 0.

    A place in the tree holds neighbours whose codes begin alike, so its count is a sum over neighbours.
    """
    rank = (pairs & np.uint64(255)).astype(np.int64)
    size = code.size[code.byte[rank]]
    begin = np.cumsum(size) - size
    odds = np.empty(int(size.sum()), np.float32)
    if len(odds) < 1 << 31:
        begin = begin.astype(np.int32)
    alike = np.full(len(pairs), -1, np.int16)
    alike[1:] = code.alike[rank[:-1], rank[1:]]
    alike[_new_contexts(pairs)] = -1
    n, at, first, left = n.astype(np.float32), begin, code.first.astype(np.int32)[code.byte[rank]], size.astype(np.int16)
    del rank, size
    depth, here = 0, _sums(n, alike < 0)
    while len(n):
        below = _sums(n, alike <= depth)
        odds[at] = np.log((below + np.float32(0.3)) / (here - below + np.float32(0.3))) * code.sign[first + depth]
        depth += 1
        more = left > depth
        n, at, first, left, alike, here = n[more], at[more] + 1, first[more], left[more], alike[more], below[more]
    return odds, begin


def _sums(n: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sum of the group that each number stands in; groups begin where ``new`` is true."""
    first = np.flatnonzero(new)
    return np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(n)))) if len(n) else n


# --- mixing ------------------------------------------------------------------------

def bits_of(code: Code, byte: np.ndarray, begins: np.ndarray, odds: list[tuple[np.ndarray, np.ndarray]]):
    """For each gate: the places that its bits are of (how many each), inputs (ORDERS x bits) and bits as -1 and 1. Inputs and bits
    have STRIDE columns more, which are 0."""
    size, first = code.size[byte], code.first[byte]
    for lo, hi in ((0, 1), (1, 3), (3, 256)):
        for here in (False, True):
            n = np.where(begins == here, np.clip(size - lo, 0, hi - lo), 0)
            at = np.flatnonzero(n)
            m = n[at]
            bits = int(m.sum())
            which = None if hi == lo + 1 else np.repeat(np.arange(len(at)), m)
            depth = lo if which is None else np.arange(lo, lo + bits) - (np.cumsum(m) - m).take(which)
            each = lambda begin: (begin.take(at) if which is None else begin.take(at).take(which)) + depth  # noqa: B023, E731
            x, sign = np.empty((ORDERS, bits + STRIDE), np.float32), np.zeros(bits + STRIDE, np.float32)
            x[:, bits:] = 0
            for k, (values, begin) in enumerate(odds):
                np.take(values, each(begin), out=x[k, :bits], mode="clip")
            np.take(code.sign, each(first), out=sign[:bits], mode="clip")
            yield n, x, sign


def mix_stream(x: np.ndarray, sign: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each text's bits of one gate; weights are learned on the way.

    Texts go side by side, a window of bits of each at a time. What stands behind the last bit of a text is left out by its mask.
    """
    texts = len(first) - 1
    n = np.diff(first)
    if x.shape[1] < first[-1] + STRIDE:
        x, sign = np.pad(x, ((0, 0), (0, STRIDE))), np.pad(sign, (0, STRIDE))
    weights = np.tile(start.astype(np.float32), (texts, 1))
    refine = np.zeros(texts * BUCKETS, np.float32)
    bends, downs = np.zeros_like(weights), np.zeros(texts * BUCKETS)
    total = np.zeros(texts)
    done, size = 0, FIRST
    live = np.flatnonzero(n > 0)
    while len(live):
        lo = first[live] + done
        xs, s = sliding_window_view(x, size, axis=1).transpose(1, 0, 2)[lo], sliding_window_view(sign, size)[lo]
        z = (weights[live, None] @ xs)[:, 0]
        cell = np.rint(np.clip(z, -(BUCKETS // 2), BUCKETS // 2)).astype(np.int64)
        cell += (live * BUCKETS + BUCKETS // 2)[:, None]
        z += refine[cell]
        z *= -s
        e = np.exp(np.clip(z, -30, 30, out=z), out=z)
        both = 1 + e
        lost = np.log(both)
        more = n[live] > done + size
        if not more.all():
            lost *= np.arange(size) < (n[live] - done)[:, None]
        total[live] -= lost.sum(1, dtype=np.float64)
        if more.any():  # the windows of those are full
            if not more.all():
                xs, s, e, both, cell = xs[more], s[more], e[more], both[more], cell[more]
            live = live[more]
            miss = np.divide(e, both, out=e)
            slope, curve = s * miss, np.divide(miss, both, out=both)
            steps = (xs @ slope[..., None])[..., 0]
            known = FADE * bends[live] + (np.multiply(xs, xs, out=xs) @ curve[..., None])[..., 0]
            bends[live] = known
            weights[live] += 0.5 * steps / (known + HELD)
            up = np.bincount(cell.ravel(), weights=slope.ravel(), minlength=len(refine))
            downs = FADE * downs + np.bincount(cell.ravel(), minlength=len(refine)) * 0.1
            refine += (0.5 * up / (downs + HELD)).astype(np.float32)
        else:
            live = live[more]
        done, size = done + size, min(size * 2, STRIDE)
    return total


def fit(x: np.ndarray, sign: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Curvature of the cost of one piece's bits at its best weights, and the curvature times these weights. ``n``: how often each bit counts."""
    weights, hess = np.full(ORDERS, PRIOR), np.zeros((ORDERS, ORDERS))
    for _ in range(FIT_STEPS):
        miss = 1 / (1 + np.exp(np.clip(sign * (weights.astype(np.float32) @ x), -30, 30)))
        times = miss if n is None else miss * n
        hess = ((x * (times * (1 - miss))) @ x.T).astype(np.float64)
        pull = (x @ (sign * times)).astype(np.float64) - PULL * (weights - PRIOR)
        weights = weights + np.clip(np.linalg.solve(hess + PULL * np.eye(ORDERS), pull), -0.5, 0.5)
    return hess, hess @ weights


def first_weights(texts: DataFrame, code: Code, part_bytes: int, waves: list[DataFrame] | None = None) -> np.ndarray:
    """Weights of each gate from all of the training texts. Each part of a block goes without its own counts. ``waves``: the same
    texts in groups, taken one after the other.

    Places with the same contexts and byte are one place that counts as often.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        known: list[list[bytes]] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(taken(code, None, pa.concat_arrays(held), *known, part_bytes), schema=_TAKEN_ARROW)
        for b in batches:
            new = np.flatnonzero(b.column("pairs").is_valid().to_numpy(zero_copy_only=False))
            for lo, hi in zip(np.append(0, new), np.append(new, b.num_rows), strict=True):
                if lo in new and lo < hi:  # a block begins
                    if held:
                        yield block()
                    held, known = [], [b.column(c)[int(lo)].as_py() for c in ("pairs", "n")]
                if lo < hi:
                    held.append(b.column("text").slice(lo, hi - lo))
        if held:
            yield block()
    fits = function(texts.sparkSession, "Mixing", ArrayType(DoubleType()))
    sums = np.zeros(GATES * (ORDERS + ORDERS * ORDERS))
    for wave in waves or [texts]:
        blocks = wave.select("text", "pairs", "n").mapInArrow(tidied(run), _TAKEN)
        for at, value in blocks.select(F.posexplode(fits(*_TAKEN_ARROW.names)).alias("at", "value")).groupBy("at").agg(F.sum("value")).collect():
            sums[at] += value
    sums = sums.reshape(GATES, -1)
    hess = sums[:, ORDERS:].reshape(GATES, ORDERS, ORDERS) + PULL * np.eye(ORDERS)
    return np.round(np.linalg.solve(hess, (sums[:, :ORDERS] + PULL * PRIOR)[..., None])[..., 0], 6)


@dataclass(frozen=True)
class Model:
    code: Code
    counts: DataFrame
    weights: np.ndarray
    blocks: DataFrame
    size: int           # bytes of all texts


def train(rows: DataFrame) -> Model:
    """Model of the keyed rows that ``learn`` (all, without such a column), and the blocks of all rows. Runs jobs."""
    rows = with_learn(rows)
    with lean(rows.sparkSession):
        code, size = byte_code(rows)
        blocks = blocks_of(rows, stash(met(rows, code, size), "contexts"), size)
        waves = [training_texts(wave) for wave in waves_of(blocks, size)]
        weights = first_weights(training_texts(blocks), code, min(PART_BYTES, size // PARTS + 1), waves)
    return Model(code, counts_of(rows, code, size), weights, blocks, size)


def score(model: Model) -> DataFrame:
    """(k1, k2, score) of all rows of the model's blocks: log10 of the probability of each text."""
    code, weights = model.code, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, pairs, n in _opened(batches):
            ids = [pa.array([texts.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("k1", "k2")]
            text = texts.column("text").combine_chunks()
            yield pa.RecordBatch.from_arrays([*ids, *taken(code, weights, text, pairs, n)],
                                             schema=pa.schema([("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), *_TAKEN_ARROW]))
    scores = function(model.blocks.sparkSession, "Mixing", ArrayType(DoubleType()))
    blocks = model.blocks.mapInArrow(tidied(run), "k1 array<long>, k2 array<long>, " + _TAKEN)
    rows = blocks.select(F.explode(F.arrays_zip("k1", "k2", scores(*_TAKEN_ARROW.names).alias("score"))).alias("row"))
    return rows.select("row.k1", "row.k2", (F.col("row.score") / float(np.log(10))).alias("score"))


# --- base --------------------------------------------------------------------------

# A block's distinct words that fall into a bucket with how often its training texts have them; or (bucket -1) a block's texts, and
# which of them have each word how often. Later: how often all training texts have each word of the block.
_WORDS = "block long, bucket long, words binary, n binary"
_WORDS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary()), ("n", pa.binary())])


def _words(buckets: int):
    """Words of each block, by bucket: hashes are dealt out by their highest bits."""
    edges = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            k1, k2 = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
            learn = np.concatenate([h[2] for h in held])
            n = np.concatenate([h[4] for h in held])
            words, text = np.concatenate([h[3] for h in held]), np.repeat(np.arange(len(n)), n)
            order = np.argsort(words)
            words = words[order]
            group = np.cumsum(np.append(False, words[1:] != words[:-1])).astype(np.uint64)
            tokens_of = (group << np.uint64(32)) | order.astype(np.uint64)
            tokens_of.sort()  # tokens of a word in the order of texts
            words, text = words[np.flatnonzero(np.append(True, group[1:] != group[:-1]))], text[(tokens_of & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            new = np.append(True, (group[1:] != group[:-1]) | (text[1:] != text[:-1]))
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(text)))
            text, group = text[at], group[at]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            gap = text.copy()
            gap[1:] -= text[:-1]
            gap[first] = text[first]
            places, _ = pack(np.stack([gap, count], 1).ravel())
            head = np.concatenate([[len(n)], k1.fill_null(0).to_numpy(), k1.is_valid().to_numpy(zero_copy_only=False), k2.to_numpy(), n]).astype(np.int64)
            sizes = np.diff(np.append(first, len(text))).astype(np.int64)
            yield rows_of(_WORDS_ARROW, [number], [-1], [head.tobytes()], [np.append(len(sizes), sizes).tobytes() + places.tobytes()])
            learned = np.add.reduceat(count * learn[text], first).astype(np.int64)
            cuts = np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])
            some = np.flatnonzero(np.diff(cuts))
            yield rows_of(_WORDS_ARROW, np.full(len(some), number), some, *([v[cuts[k] : cuts[k + 1]].tobytes() for k in some] for v in (words, learned)))
        for b in batches:
            learn = b.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offs in pieces(b.column("text")):
                data = LOWER[data]
                starts, ends, first = split_words(data, offs)
                n = np.diff(first) + 1
                tokens_here = np.full(int(n.sum()), np.uint64(2**64 - 1), np.uint64)  # ends
                last = np.zeros(len(tokens_here), bool)
                last[np.cumsum(n) - 1] = True
                tokens_here[~last] = word_hashes(data, starts, ends)
                held.append((b.column("k1").slice(lo, hi - lo), b.column("k2").slice(lo, hi - lo), learn[lo:hi], tokens_here, n))
                tokens += len(tokens_here)
                if tokens >= BLOCK_TOKENS:
                    yield from flush()
                    held, tokens, number = [], 0, number + 1
        if held:
            yield from flush()
    return run


def _meet_words(t: pa.Table) -> pa.Table:
    """Words of all blocks in one bucket: for each block how often all training texts have its words, and (block -1) tokens and words
    of training texts."""
    words, n = ([np.frombuffer(x.as_py(), kind) for x in t.column(c)] for c, kind in (("words", np.uint64), ("n", np.int64)))
    every, _ = tally(np.concatenate(words))
    total = np.zeros(len(every), np.int64)
    places = [np.searchsorted(every, w) for w in words]
    for at, mine in zip(places, n, strict=True):
        total[at] += mine
    counts = [np.array([total.sum(), np.count_nonzero(total)], np.int64), *(total[at] for at in places)]
    blocks = [-1, *t.column("block").to_pylist()]
    return pa.table([pa.array(blocks, pa.int64()), pa.array([t.column("bucket")[0].as_py()] * len(blocks), pa.int64()),
                     pa.nulls(len(blocks), pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())], schema=_WORDS_ARROW)


_BASE = "k1 long, k2 long, n_tokens long, n_known long, logs double"
_BASE_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64())])


def _base(t: pa.Table) -> pa.Table:
    """Texts of one block: tokens, known tokens and the sum of log10(c + 1)."""
    t = t.sort_by("bucket")  # texts first, then words in the order of their hashes
    head = np.frombuffer(t.column("words")[0].as_py(), np.int64)
    k1, known, k2, n = head[1:].reshape(4, -1)
    held = t.column("n")[0].as_py()
    kinds = int(np.frombuffer(held[:8], np.int64)[0])
    sizes = np.frombuffer(held[8 : 8 * (kinds + 1)], np.int64)
    pairs = unpack(np.frombuffer(held[8 * (kinds + 1) :], np.uint8)).reshape(-1, 2)
    c = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("n")[1:]])
    first = np.cumsum(sizes) - sizes
    sums = np.cumsum(pairs[:, 0])
    text = sums - np.repeat(sums[first] - pairs[first, 0], sizes)
    logs = np.bincount(text, weights=pairs[:, 1] * np.repeat(np.log10(c + 1.0), sizes), minlength=len(n))
    seen = np.bincount(text, weights=pairs[:, 1] * np.repeat(c > 0, sizes), minlength=len(n))
    return pa.table([pa.array(k1, mask=known == 0), pa.array(k2), pa.array(n), pa.array(seen.astype(np.int64)), pa.array(logs)], schema=_BASE_ARROW)


def base_scores(rows: DataFrame, size: int) -> DataFrame:
    """(k1, k2, n_tokens, n_known, train_tokens, base_score) of keyed rows with a column ``learn``, of about so many bytes."""
    words = stash(rows.select("k1", "k2", "text", "learn").mapInArrow(tidied(_words(max(MIN_BUCKETS, size // BUCKET_BYTES))), _WORDS), "words")
    known = stash(words.where("bucket >= 0").groupBy("bucket").applyInArrow(_meet_words, _WORDS), "known")
    total = kinds = 0
    for (held,) in known.where("block < 0").select("n").collect():
        tokens, distinct = np.frombuffer(held, np.int64)
        total, kinds = total + int(tokens), kinds + int(distinct)
    unit = float(np.log10(total + kinds + 1))
    return words.where("bucket < 0").unionByName(known.where("block >= 0")).groupBy("block").applyInArrow(_base, _BASE).select(
        "k1", "k2", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(unit)).alias("base_score"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, which: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from rows that are not held out.

    Runs jobs while the plan is built.
    """
    rows = keyed(docs, id_col, text_col).withColumn("learn", ~held_out(F.col("k1"), parts, which))
    model = train(rows)
    with lean(docs.sparkSession):
        waves = [stash(score(replace(model, blocks=wave)), "scores") for wave in waves_of(model.blocks, model.size)]
        scored = reduce(DataFrame.unionByName, waves).dropDuplicates(["k1", "k2"])
    base = base_scores(rows, model.size)
    return (base.join(scored, base["k1"].eqNullSafe(scored["k1"]) & (base["k2"] == scored["k2"]))
            .select(base["k1"].alias("doc_id"), held_out(base["k1"], parts, which).alias("held_out"),
                    "n_tokens", "n_known", "train_tokens", "base_score", "score"))

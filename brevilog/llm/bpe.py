"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

1. Documents are cut into pre-tokens by the rules of the vocabulary's pattern. A block of documents (about
   ``BLOCK_TOKENS`` pre-tokens, whole documents) gives each distinct word in it once, with how often it occurs, so that a
   word is shuffled once for each block and not once for each place. Words are packed into rows by bucket of their hash.
2. Rows are dealt out by bucket. Each distinct word is encoded once, in the task that gets it (again only where a task
   has met more than ``KNOWN_WORDS`` others). A frequent word has one entry for each block, as any other word, so no bucket is hot.
3. Positions don't travel with words: a second pass over the documents gives, for each block, its words in order, each by its
   place among the block's words by frequency. Ids join them by block and are put in place. Blocks
   that don't fit each other raise ValueError.

Decoding joins the token-byte table, which has one row for each id of the vocabulary (50,256 here) and is
broadcast. Its size is that of the vocabulary file, whatever the corpus holds; ``MAX_VOCABULARY`` is checked.

Cases: a null or empty text has no tokens; ids of rows that are repeated, or null, are kept as they are, since
rows are told apart by their place in a block; text that isn't valid UTF-8 can't occur in a string column; long words
are merged with a heap, so that a text without white space stays near linear; an unknown id raises ValueError in
decode, null ids decode to an empty text; other columns are not read; an empty table gives an empty result.
The input should come from a scan or a written table: it is read twice, and its parts must have the same rows in the same
order each time, also after an executor was lost.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, mix, pieces, ranges, rows_of, strings, tidied, word_hashes

BLOCK_TOKENS = 1_000_000
MIN_BUCKETS = 256
KNOWN_WORDS = 200_000
MAX_VOCABULARY = 2_000_000

# --- vocabulary --------------------------------------------------------------------


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens are too many to broadcast")
    return ranks


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the pair of lowest rank, the first of equals, until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 48:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get, none = ranks.get, 1 << 60
    pairs = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (r := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[i], ends[j]))
    for i in range(n):
        offer(i)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        j = after[i]
        if ends[i] != mid or j < 0 or ends[j] != end:
            continue  # one of the two has been joined since
        ends[i], after[i], ends[j] = end, after[j], -1
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i >= 0:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


# --- pre-tokens --------------------------------------------------------------------

_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    global _classes
    if _classes is None:
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for i in range(0x110000):
            k = unicodedata.category(chr(i))[0]
            if k == "L":
                kinds[i] = _LETTER
            elif k == "N":
                kinds[i] = _NUMBER
        # Code points with the property White_Space.
        kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _classes = kinds
    return _classes


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of all texts, which cover every byte, and the index of the first one of each text.

    A pre-token is a run of letters, of numbers or of other characters, with one blank before it if there is one;
    the endings 's 't 're 've 'm 'll 'd; or a run of white space, which leaves its last character to what follows.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    head = np.flatnonzero((data & 0xC0) != 0x80)  # bytes where a character starts
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    n = len(points)
    first_char = np.searchsorted(head, offs)
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[first_char] = True
    edge[n] = True
    run = edge[:-1].copy()  # a run of one class starts here
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == _SPACE
    last = np.ones(n, bool)  # last character of its run
    last[:-1] = run[1:]
    # The last character of white space goes its own way if text follows; a blank takes what follows with it.
    leaves = space & last & ~edge[1:]
    start |= leaves
    joins = np.flatnonzero(leaves & (points == 0x20)) + 1
    start[joins] = False
    # endings: an apostrophe alone between a token's end and a letter
    quote = np.flatnonzero((points == 0x27) & run & last & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    if len(quote):
        padded = np.append(points, [0, 0])
        edges = np.append(edge, [True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        pair = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e"))
                | (one == ord("l")) & (two == ord("l"))) & ~edges[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        start[quote[single] + 1] = False
        start[quote[pair] + 1] = False
        for at, size in ((quote[single], 2), (quote[pair], 3)):
            after = at + size
            after = after[after < n]
            start[after] = True
    chars = np.flatnonzero(start)
    return head[chars], np.searchsorted(chars, first_char)


# --- numbers -----------------------------------------------------------------------

def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^28 in one to four bytes each, seven bits a byte; and the bytes that each takes."""
    sizes = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = sizes > k
        out[(ends - sizes)[has] + k] = (numbers[has] >> (7 * k) & 127) | ((sizes[has] > k + 1) << 7)
    return out, sizes


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    sizes = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        has = sizes > k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


# --- encoding ----------------------------------------------------------------------

# One row holds the words of a block that fall into one bucket: sizes has the bytes and the number of places of each word.
_WORDS = "block long, bucket int, sizes binary, words binary"
_WORDS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary())])
# The documents of a block (id, whether it has one, number of words) and its words in order.
_ORDER = "block long, docs binary, words binary"
_ORDER_ARROW = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("words", pa.binary())])


def press(raw) -> bytes:
    """Compressed better than by shuffles themselves."""
    return zstandard.ZstdCompressor(level=7).compress(bytes(raw))


def release(held: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(held)


def by_frequency(n: np.ndarray) -> np.ndarray:
    """Words from the most frequent one on; of equals, the first."""
    return np.argsort(-n, kind="stable")


class _Block:
    """Distinct words of some documents, by bucket and hash, and where they stand."""

    def __init__(self, number: int, buckets: int) -> None:
        self.number, self.buckets, self.tokens, self.texts = number, buckets, 0, []
        self.sizes: list[np.ndarray] = []
        self.bytes: list[np.ndarray] = []

    def add(self, ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> None:
        starts, first = pretokens(data, offs)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        self.sizes.append(ends - starts)
        self.bytes.append(data)
        self.tokens += len(starts)
        self.texts.append((ids, np.diff(first)))

    def sort(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places by hash, first of each group in that order, size and bucket of groups, and groups by bucket.

        Both passes come here, and both take the first hash that tells all words of the block apart.
        """
        sizes, data = np.concatenate(self.sizes), np.concatenate(self.bytes)
        ends = np.cumsum(sizes)
        for which in range(len(ODD)):
            hashes = word_hashes(data, ends - sizes, ends, which)
            order = np.argsort(hashes, kind="stable").astype(np.int32)
            new = np.ones(len(order), bool)
            new[1:] = hashes[order[1:]] != hashes[order[:-1]]
            group = np.flatnonzero(new)
            if self.told_apart(sizes, data, order, group):
                break
        else:
            raise ValueError("two words with one hash, in each of the hashes")
        bucket = (mix(hashes[order[group]]) % np.uint64(self.buckets)).astype(np.int32)
        return order, group, np.diff(np.append(group, len(order))), bucket, np.argsort(bucket, kind="stable")

    @staticmethod
    def told_apart(sizes: np.ndarray, data: np.ndarray, order: np.ndarray, group: np.ndarray) -> bool:
        """Whether every word has the bytes of the first of its group."""
        where = np.empty(len(order), np.int32)
        where[order] = np.repeat(order[group], np.diff(np.append(group, len(order))))
        if not np.array_equal(sizes, sizes[where]):
            return False
        begin = np.cumsum(sizes) - sizes
        for lo in range(0, len(order), 1 << 17):
            part = slice(lo, lo + (1 << 17))
            shift = np.repeat(begin[where[part]] - begin[part], sizes[part])
            here = np.arange(begin[lo], begin[lo] + len(shift))
            if not np.array_equal(data[here], data[here + shift]):
                return False
        return True

    def order(self) -> pa.RecordBatch:
        ids = pa.concat_arrays([i for i, _ in self.texts])
        counts = np.concatenate([c for _, c in self.texts]).astype(np.int64)
        known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        docs = press(np.stack([ids.fill_null(0).to_numpy(), known, counts]).tobytes())
        order, group, n, _, by = self.sort()
        rank = np.empty(len(group), np.int32)
        rank[by[by_frequency(n[by])]] = np.arange(len(group))
        words = np.empty(len(order), np.int32)
        words[order] = np.repeat(rank, n)
        return rows_of(_ORDER_ARROW, [self.number], pa.array([docs], pa.binary()), pa.array([press(pack(words)[0])], pa.binary()))

    def words(self) -> pa.RecordBatch:
        sizes, data = np.concatenate(self.sizes), np.concatenate(self.bytes)
        begin = np.cumsum(sizes) - sizes
        order, group, n, bucket, by = self.sort()
        one = order[group]  # first place of each word
        one = one[by]
        spot, _ = ranges(begin[one], begin[one] + sizes[one] - 1)
        packed, packed_sizes = pack(np.stack([sizes[one], n[by]], 1).ravel())
        used, cut = np.unique(bucket[by], return_index=True)
        cut = np.append(cut, len(by))

        def column(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
            ends = np.append(0, ends)[cut]
            return pa.array([press(raw[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return rows_of(_WORDS_ARROW, np.full(len(used), self.number), used, column(packed, np.cumsum(packed_sizes)[1::2]),
                       column(data[spot], np.cumsum(sizes[one])))


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[_Block]:
    number = TaskContext.get().partitionId() << 32
    block = _Block(number, buckets)
    for b in batches:
        ids = b.column("id")
        for lo, hi, data, offs in pieces(b.column("text"), 1 << 20):
            block.add(ids.slice(lo, hi - lo), data, offs)
            if block.tokens >= BLOCK_TOKENS:
                yield block
                number += 1
                block = _Block(number, buckets)
    if block.texts:
        yield block


def _words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (block.words() for block in _blocks(batches, buckets) if block.tokens)
    return run


def _order(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (block.order() for block in _blocks(batches, buckets))
    return run


# sizes has the number of places and of ids of each word.
_PARTS = "block long, bucket int, sizes binary, ids binary"
_PARTS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])


def _encode_words(table):
    """Words of a bucket to their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = table.value, {}
        for b in batches:
            made_sizes, made_ids = [], []
            for i in range(b.num_rows):
                size, n = unpack(np.frombuffer(release(b.column("sizes")[i].as_py()), np.uint8)).reshape(-1, 2).T
                words, ids, made, lo = release(b.column("words")[i].as_py()), [], [], 0
                for hi in np.cumsum(size).tolist():
                    word = words[lo:hi]
                    lo = hi
                    if (x := known.get(word)) is None:
                        x = merge_word(word, ranks)
                        if len(known) < KNOWN_WORDS:  # the other blocks' rows of a bucket come through the same task
                            known[word] = x
                    ids += x
                    made.append(len(x))
                made_sizes.append(press(pack(np.stack([n, np.array(made, np.int64)], 1).ravel())[0]))
                made_ids.append(press(np.array(ids, np.int32).tobytes()))
            yield rows_of(_PARTS_ARROW, b.column("block"), b.column("bucket"), pa.array(made_sizes, pa.binary()), pa.array(made_ids, pa.binary()))
    return run


_TOKENS = "doc_id long, ids array<int>"
_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _put_together(order: pa.Table, parts: pa.Table) -> pa.Table:
    """Documents of one block with their ids."""
    if order.num_rows != 1:
        raise ValueError("the parts of the input changed between its two passes")
    doc, known, counts = np.frombuffer(release(order.column("docs")[0].as_py()), np.int64).reshape(3, -1)
    words = unpack(np.frombuffer(release(order.column("words")[0].as_py()), np.uint8))
    parts = parts.sort_by("bucket")
    sizes = np.concatenate([np.zeros((0, 2), np.int64), *(unpack(np.frombuffer(release(x.as_py()), np.uint8)).reshape(-1, 2) for x in parts.column("sizes"))])
    ids = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(release(x.as_py()), np.int32) for x in parts.column("ids"))])
    turn = by_frequency(sizes[:, 0])
    if len(words) != counts.sum() or not np.array_equal(np.bincount(words, minlength=len(turn)), sizes[turn, 0]):
        raise ValueError("the parts of the input changed between its two passes")
    length = sizes[:, 1]
    begin = (np.cumsum(length) - length)[turn]
    size = length[turn][words]
    out = ids[np.arange(int(size.sum()), dtype=np.int32) + np.repeat((begin[words] - (np.cumsum(size) - size)).astype(np.int32), size)]
    offs = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
    if offs[-1] > 2**31 - 1:
        raise ValueError("more than 2^31 tokens in one block")
    return pa.table([pa.array(doc, mask=known == 0), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(out))],
                    schema=_TOKENS_ARROW)


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document."""
    table = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = max(MIN_BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = rows.mapInArrow(tidied(_words(buckets)), _WORDS).repartition("bucket").mapInArrow(tidied(_encode_words(table)), _PARTS)
    order = rows.mapInArrow(tidied(_order(buckets)), _ORDER)
    # Each side has a shuffle of its own, so the number of a part is that of the scan in both.
    return order.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(_put_together, _TOKENS)


_DECODED = "doc_id long, ids array<int>, bytes binary"
_DECODED_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("bytes", pa.binary())])


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and start and size for each id (size -1: no such id)."""
    start, size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64), np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
    at = 0
    for word, i in ranks.items():
        start[i], size[i] = at, len(word)
        at += len(word)
    return np.frombuffer(b"".join(ranks), np.uint8), start, size


def _decode(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, start, size = table.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = part.column("ids")
                if ids.null_count:
                    ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
                offs = ids.offsets.to_numpy()
                flat = ids.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
                if len(flat) and (flat.min() < 0 or flat.max() >= len(size) or (size[flat] < 0).any()):
                    raise ValueError("an id that the vocabulary doesn't have")
                n = size[flat]
                sums = np.append(0, np.cumsum(n))
                out = data[np.arange(int(sums[-1])) + np.repeat(start[flat] - sums[:-1], n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), strings(out, sums[offs - offs[0]], pa.binary())],
                                                 schema=_DECODED_ARROW)
    return run


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``tokens`` (doc_id, ids) with the bytes that the ids stand for."""
    table = tokens.sparkSession.sparkContext.broadcast(token_bytes(ranks))
    return tokens.select("doc_id", "ids").mapInArrow(_decode(table), _DECODED)


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGESTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, made, kept = [], [], []
            for ids, text in zip(b.column("ids"), b.column("bytes"), strict=True):
                raw = np.zeros(0, "<u4") if ids.values is None else ids.values.to_numpy(zero_copy_only=False).astype("<u4")
                n.append(len(raw))
                made.append(hashlib.sha256(raw.tobytes()).hexdigest())
                kept.append(hashlib.sha256(text.as_buffer() if text.is_valid else b"").hexdigest())
            done = rows_of(_DIGESTS_ARROW, b.column("doc_id"), n, made, kept)
            yield done.append_column("ids", b.column("ids")) if keep_ids else done
    return run


def digests(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, perhaps ids): ids as little-endian unsigned 32-bit integers."""
    return decoded.select("doc_id", "ids", "bytes").mapInArrow(_digest(keep_ids), _DIGESTS + (", ids array<int>" if keep_ids else ""))


def decoded_digests(tokens: DataFrame, ranks: dict[bytes, int], keep_ids: bool = False) -> DataFrame:
    """``digests(decode(tokens))`` in one step, so that decoded texts stay in the task that makes them."""
    decoded, digest = _decode(tokens.sparkSession.sparkContext.broadcast(token_bytes(ranks))), _digest(keep_ids)
    return tokens.select("doc_id", "ids").mapInArrow(tidied(lambda batches: digest(decoded(batches))), _DIGESTS + (", ids array<int>" if keep_ids else ""))

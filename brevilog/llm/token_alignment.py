"""Alignment of the tokens of two tokenizers over the bytes of a text, by pointer jumping, and links counted over a corpus.

1. Texts are cut before a blank that follows other than white space. Both tokenizers surely end a token there (checked for the
   pieces' vocabulary; the byte-level pattern has no match over such a place), so tokens and groups of a text are those of
   its segments. Each distinct segment of a block of documents is encoded and aligned once.
2. Every token points to its farthest-right overlapping token of the other tokenizer (of two that end together, the second
   tokenizer's is the farther). Successors are doubled, ``succ = succ[succ]`` for all tokens at once, until nothing changes: then
   each token points to the terminal token of its component, which is the label of its group.
3. A block of documents (about ``BLOCK_BYTES`` of text, whole documents) gives its distinct id pairs with the number of
   documents that link them, and for each document its pairs by number. Blocks are written to the shared folder.
4. Pairs of all blocks are summed by Spark (one row for each block and pair, so no pair is hot), the highest count of each first
   id is a window over its pairs (at most as many as the second vocabulary has ids), and counts are joined back to the blocks.
   Each block then looks its documents' pairs up.

A group links every token of one side with every one of the other: occurrences are multiplied by distinct ids, not listed.

Cases: a text that is null or empty, or that a tokenizer doesn't give back byte by byte, has no tokens: zeros and an empty digest;
repeated rows and ids are documents of their own; ties for the highest count are all highest; a very long text is one
block, its arrays grow with it; a text without blanks is one segment; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import pack, press, release, unpack
from .common import ranges, rows_of, stash, tidied, tidy, utf8

BLOCK_BYTES = 8 << 20
# Segments that are encoded at once.
BATCH = 20_000
MAX_FILE_BYTES = 64 << 20
_CUT, _SPACE_BEFORE = re.compile(r"(?<=\S) "), re.compile(r"\s ")

# --- tokenizers --------------------------------------------------------------------


def byte_of_letter() -> dict[str, int]:
    """The byte behind each letter of byte-level vocabularies: printable ones stand for themselves, others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_of_letter()
        own = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = own[i] if i in own else bytes(letters[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        # A piece with a blank after something else could lie over a cut.
        self.cuts = not any(re.search("[^▁]▁", x) for x in names)

        self.tables = [(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])[:-1], np.array([len(x) for x in t], np.int64))
                       for t in (self.a_bytes, self.b_bytes)]
        # Ids in decimal with what parts them from the next one: inside a side, at its end.
        self.written = [np.array([f"{i}{mark}" for i in range(len(t))], object) for t, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks]

    def segments(self, text: str) -> list[str]:
        """Parts of a text, each without the blank before it; none is empty."""
        if not self.cuts:
            return [text]
        parts = text.split(" ") if not _SPACE_BEFORE.search(text) and text[0] != " " else _CUT.split(text)
        if not parts[-1] and len(parts) > 1:
            parts[-2:] = [parts[-2] + " "]
        return parts

    def encode(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tokens of all segments and their number in each, for both tokenizers."""
        out = [([], []), ([], [])]
        for lo in range(0, len(segments), BATCH):
            part = segments[lo : lo + BATCH]
            first = [x.ids for x in self.a.encode_batch_fast([" " + s for s in part], add_special_tokens=False)]
            for (ids, n), lists in zip(out, (first, self.b.encode(part, num_threads=1)), strict=True):
                n.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(n[-1].sum())))
        none = np.zeros(0, np.int64)
        return [(np.concatenate([none, *ids]), np.concatenate([none, *n])) for ids, n in out]

    def spells(self, side: int, ids: np.ndarray, n: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether the tokens of each segment have the bytes of that segment."""
        table, start, size = self.tables[side]
        total = np.diff(np.append(0, np.cumsum(size[ids]))[np.append(0, np.cumsum(n))])
        fits = total == np.diff(offs)
        ids = ids[np.repeat(fits, n)]
        spelled, _ = ranges(start[ids], start[ids] + size[ids] - 1)
        at, segment = ranges(offs[:-1][fits], offs[1:][fits] - 1)
        wrong = segment[table[spelled] != data[at]]
        fits[np.flatnonzero(fits)[wrong]] = False
        return fits


_pairs: dict[int, Pair] = {}


def _loaded(held) -> Pair:
    """The tokenizers of a broadcast, loaded once in a Python worker."""
    if held.value["key"] not in _pairs:
        _pairs.clear()
        _pairs[held.value["key"]] = Pair(held.value["a"], held.value["b"])
    return _pairs[held.value["key"]]


# --- alignment ---------------------------------------------------------------------

def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Terminal token of the component of each token (those of a, then those of b); both sides cover the same bytes."""
    na, nb = len(ends_a), len(ends_b)
    to_b = np.searchsorted(ends_b, ends_a)  # the token of b over the last byte
    to_a = np.searchsorted(ends_a, ends_b)
    own = ends_a[to_a] == ends_b if na else np.ones(nb, bool)
    succ = np.concatenate([na + to_b, np.where(own, na + np.arange(nb), to_a)])
    while not np.array_equal(jump := succ[succ], succ):
        succ = jump
    return succ


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group number of each token of both sides, in the order of the bytes, and the number of groups."""
    last, which = np.unique(terminals(ends_a, ends_b), return_inverse=True)
    return which[: len(ends_a)], which[len(ends_a) :], len(last)


def _by_group(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of each distinct id of a group, by group."""
    key, n = np.unique(group.astype(np.int64) << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


class Aligned:
    """Segments with their tokens, groups and linked id pairs; the pairs of segment s are those from first[s] to first[s + 1]."""

    def __init__(self, pair: Pair, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        self.n_a, self.n_b, segments = n_a, n_b, len(n_a)
        group_a, group_b, n = groups(np.cumsum(pair.tables[0][2][a]), np.cumsum(pair.tables[1][2][b]))
        segment = np.zeros(n, np.int64)
        segment[group_a] = np.repeat(np.arange(segments), n_a)
        self.n_groups = np.bincount(segment, minlength=segments)
        links = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n)
        self.n_links = np.diff(np.append(0, np.cumsum(links))[np.append(0, np.cumsum(self.n_groups))])
        # distinct ids of each group, every one of a with every one of b
        ga, ia, ka = _by_group(group_a, a)
        gb, ib, kb = _by_group(group_b, b)
        lo, hi = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right") - 1
        right, left = ranges(lo, hi)
        self.pair_a, self.pair_b, self.times = ia[left], ib[right], ka[left] * kb[right]
        self.first = np.searchsorted(segment[ga[left]], np.arange(segments + 1))
        # groups of each segment as `a1,a2|b1;a3|b2,b3`
        last = [np.append(g[1:] != g[:-1], np.ones(min(1, len(g)), bool)) for g in (group_a, group_b)]
        words = np.concatenate([np.where(last[0], pair.written[1][a], pair.written[0][a]), np.where(last[1], pair.written[3][b], pair.written[2][b])])
        of = np.concatenate([group_a * 2, group_b * 2 + 1])
        words = words[np.argsort(of, kind="stable")].tolist()
        cut = np.append(0, np.cumsum(n_a + n_b)).tolist()
        self.text = ["".join(words[x:y])[:-1] for x, y in zip(cut[:-1], cut[1:], strict=True)]


# --- blocks ------------------------------------------------------------------------

_BLOCK = ("block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
          "links binary, a array<int>, b array<int>, n array<int>")
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")],
                          ("sha", pa.list_(pa.string())), ("links", pa.binary()), *[(c, pa.list_(pa.int32())) for c in ("a", "b", "n")]])


def _of_segments(ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens of some segments, one after the other."""
    ends = np.cumsum(n)
    return ids[ranges((ends - n)[at], ends[at] - 1)[0]]


def _block(number: int, ids: list[int | None], texts: list[str], pair: Pair) -> pa.RecordBatch:
    place: dict[str, int] = defaultdict()
    place.default_factory = place.__len__
    parts = [np.fromiter(map(place.__getitem__, pair.segments(text)), np.int64) if text else np.zeros(0, np.int64) for text in texts]
    segments = list(place)
    (a, n_a), (b, n_b) = pair.encode(segments)
    data, offs = utf8(pa.array([" " + s for s in segments], pa.large_string()))
    fine = pair.spells(0, a, n_a, data, offs) & pair.spells(1, b, n_b, data, offs)
    # Only tokens that spell their segment can be aligned; a text with another one is compared as a whole.
    more = []
    for d in [d for d, at in enumerate(parts) if not fine[at].all()]:
        whole = _of_segments(a, n_a, parts[d]), _of_segments(b, n_b, parts[d])
        data, offs = utf8(pa.array([" " + texts[d]], pa.large_string()))
        same = all(pair.spells(k, x, np.array([len(x)]), data, offs)[0] for k, x in enumerate(whole))
        parts[d] = np.array([-1 - len(more)] if same else [], np.int64)
        more += [whole] * same
    to = np.cumsum(fine) - 1
    kept_a, kept_b = (np.concatenate([ids[np.repeat(fine, n)], *[w[k] for w in more]]) for k, (ids, n) in enumerate(((a, n_a), (b, n_b))))
    made = Aligned(pair, kept_a, np.append(n_a[fine], [len(w[0]) for w in more]).astype(np.int64),
                   kept_b, np.append(n_b[fine], [len(w[1]) for w in more]).astype(np.int64))
    if more or not fine.all():
        parts = [np.where(at < 0, fine.sum() - 1 - at, to[at]) for at in parts]
    size = np.array([len(at) for at in parts], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *parts])
    doc = np.repeat(np.arange(len(parts)), size)

    def summed(values):
        return np.diff(np.append(0, np.cumsum(values[flat]))[np.append(0, np.cumsum(size))])
    sha = [hashlib.sha256(";".join([made.text[s] for s in at.tolist()]).encode()).hexdigest() if len(at) else "" for at in parts]
    # pairs of the block by number, then of each document with how often they are linked
    width = len(pair.b_bytes)
    pairs, number_of = np.unique(made.pair_a * width + made.pair_b, return_inverse=True)
    key, n = np.unique(doc * max(1, len(made.n_a)) + flat, return_counts=True)
    doc, segment = np.divmod(key, max(1, len(made.n_a)))
    at, which = ranges(made.first[segment], made.first[segment + 1] - 1)
    key = doc[which] * max(1, len(pairs)) + number_of[at]
    order = np.argsort(key, kind="stable")
    key, times = key[order], (n[which] * made.times[at])[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    doc, linked = np.divmod(key[new], max(1, len(pairs)))
    times = np.add.reduceat(times, new) if len(new) else times
    held = np.bincount(linked, minlength=len(pairs))
    links = press(np.concatenate([np.bincount(doc, minlength=len(parts)), linked, times]).astype(np.int64).tobytes()) if len(parts) else b""
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    return rows_of(_BLOCK_ARROW, [number], one(ids, pa.int64()), *[one(summed(v), pa.int64()) for v in (made.n_a, made.n_b, made.n_groups, made.n_links)],
                   one(sha, pa.string()), pa.array([links], pa.binary()), *[one(x, pa.int32()) for x in (pairs // width, pairs % width, held)])


def _blocks(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _loaded(held), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                texts.append(text.as_py())
                size += text.as_buffer().size if text.is_valid else 0
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_BYTES // 64:
                    yield _block(number, ids, texts, pair)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _block(number, ids, texts, pair)
    return run


_DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _valued(block: pa.Table, values: pa.Table) -> pa.Table:
    """Documents of one block, their links valued by the corpus."""
    if block.num_rows != 1:
        raise ValueError("a block was written twice")
    row = {c: block.column(c)[0].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "sha")}
    values = values.sort_by("at")
    count, best = (values.column(c).to_numpy().astype(np.int64) for c in ("count", "best"))
    links = np.frombuffer(release(block.column("links")[0].as_py()), np.int64)
    size, rest = links[: len(row["ids"])], links[len(row["ids"]) :]
    linked, times = rest[: len(rest) // 2], rest[len(rest) // 2 :]
    ends = np.append(0, np.cumsum(size))
    summed = lambda x: np.diff(np.append(0, np.cumsum(x[linked] * times))[ends])
    tidy()
    return pa.table([row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], pa.array(summed(best)), pa.array(summed(count)), row["sha"]], _COLUMNS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best) of all id pairs: in how many documents they are linked, and whether that is the highest of a."""
    pairs = blocks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    counts = pairs.agg(F.sum("p.n").alias("count"))
    return counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("int"))


def aligned_blocks(docs: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with their alignment, written to the shared folder."""
    with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
        files = {"a": a.read(), "b": b.read()}
    if len(files["a"]) + len(files["b"]) > MAX_FILE_BYTES:
        raise ValueError("the vocabularies are too large to broadcast")
    files["key"] = hash((files["a"], files["b"]))
    held = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stash(rows.mapInArrow(tidied(_blocks(held)), _BLOCK), "aligned")


def align(docs: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens of both, groups, links, links that are the best of their first id, sum of counts, digest of groups."""
    blocks = aligned_blocks(docs, byte_level_path, pieces_path, id_col, text_col)
    counts = stash(pair_counts(blocks), "pairs")
    pairs = blocks.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("of", "at", "p.a", "p.b")
    values = pairs.join(counts, ["a", "b"]).select("of", "at", "count", "best")
    return blocks.drop("a", "b", "n").groupBy("block").cogroup(values.groupBy("of")).applyInArrow(_valued, _DONE)


def links(blocks: DataFrame) -> DataFrame:
    """The alignment itself: every id pair with its count and whether it is the best of its first id, best ones first."""
    return pair_counts(blocks).orderBy("a", F.desc("count"), "b")

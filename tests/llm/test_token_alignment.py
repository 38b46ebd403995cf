"""Token alignment against a plain Python version over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from brevilog.llm import token_alignment as T

DOCS = "doc_id long, text string, a int, block int"
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        return T.Pair(a.read(), b.read())


def _whole(pair, text):
    """Groups [(ids of a, ids of b)] of one text, or none."""
    if not text:
        return []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    spelled = b"".join(pair.a_bytes[i] for i in a), b"".join(pair.b_bytes[i] for i in b)
    if spelled != ((" " + text).encode(),) * 2:
        return []
    out, i, j = [], 0, 0
    while i < len(a):
        left, right = [a[i]], [b[j]]
        x, y, i, j = len(pair.a_bytes[a[i]]), len(pair.b_bytes[b[j]]), i + 1, j + 1
        while x != y:
            if x < y:
                x, left, i = x + len(pair.a_bytes[a[i]]), left + [a[i]], i + 1
            else:
                y, right, j = y + len(pair.b_bytes[b[j]]), right + [b[j]], j + 1
        out.append((left, right))
    return out


def _plain(pair, docs):
    held = [(i, _whole(pair, text)) for i, text, *_ in docs]
    linked = [Counter((x, y) for left, right in found for x in left for y in right) for _, found in held]
    count = Counter(p for c in linked for p in c)
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (i, found), c in zip(held, linked, strict=True):
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in found)
        out.append((i, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return sorted(out, key=repr)


def _texts():
    rng = random.Random(4)
    words = ["the", "Übung", "naïve", "don't", "  ", "\n", "\t", "12345", "日本語テキスト", "😀👍🏽", "🇩🇪", "é", "á", "<|endoftext|>", "<s>", "</s>", "<0x41>",
             " ", "　x", "\x1c", "\x85", "...", "—", "Ᲊ", "ﬁ", "Ⅷ", "<unk>", "aaaaaaaa", "…​", "\x00", "مرحبا", "नमस्ते", "_x_", "http://a.b/c?d=1"]
    texts = ["", " ", "  ", "a", " a", "a ", "a  ", "a \n", "\n", "x" * 5000, "ab " * 3000, "▁", "a ▁ b", "hello ▁", None, "�", "\x1c a \x1d b"]
    texts += [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([32, 32, 97, 98, 10, 160, 0x2003, 0x4E2D, 0x301, 39, 115])) for _ in range(60)) for _ in range(100)]
    return texts


def test_documents_as_in_plain_python(spark, pair, monkeypatch):
    docs = [(i, t, 1, 2) for i, t in enumerate(_texts())]
    docs += [(None, "no id at all", 1, 2), (3, "the same id", 1, 2), *[(9, "a row that repeats", 1, 2)] * 30]
    got = T.align(spark.createDataFrame(docs, DOCS).repartition(5), *PATHS).collect()
    assert sorted(map(tuple, got), key=repr) == _plain(pair, docs)
    assert any(r["n_links"] > r["n_a"] for r in got) and any(r["n_a"] == 0 and r["doc_id"] not in (0, 14) for r in got)


def test_blocks_of_any_size(pair, monkeypatch):
    monkeypatch.setattr(T, "BATCH", 7)
    texts = [t for t in _texts() if t]
    for lo in range(0, len(texts), 50):
        block = T._block(lo, list(range(50)), texts[lo : lo + 50], pair)
        found = [_whole(pair, t) for t in texts[lo : lo + 50]]
        assert block.column("n_a")[0].as_py() == [sum(len(x) for x, _ in f) for f in found]
        assert block.column("n_links")[0].as_py() == [sum(len(x) * len(y) for x, y in f) for f in found]


def test_text_whose_segments_make_up_for_each_other(pair, monkeypatch):
    """Tokens that spell the text, but not segment by segment, are aligned over the whole text."""
    text = "one two three"
    real = pair.encode

    def shifted(segments):
        (a, n_a), (b, n_b) = real(segments)
        n_a = n_a + np.array([1, -1, 0]) if segments == ["one", "two", "three"] else n_a
        return [(a, n_a), (b, n_b)]
    want = T._block(0, [1, 2], [text, "four"], pair)
    monkeypatch.setattr(pair, "encode", lambda segments: shifted(segments[:3]) if len(segments) == 3 else real(segments))
    block = T._block(0, [1], [text], pair)
    for c in ("n_a", "n_b", "n_groups", "n_links", "sha"):
        assert block.column(c)[0].as_py()[0] == want.column(c)[0].as_py()[0]


def test_segments_are_cut_where_tokens_end(pair):
    assert pair.cuts
    for text in _texts():
        if text:
            parts = pair.segments(text)
            assert " ".join(parts) == text and all(parts)
            (a, _), (b, _) = pair.encode(parts)
            assert a.tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids
            assert b.tolist() == pair.b.encode(text)


def test_pointers_end_at_common_ends():
    rng = np.random.default_rng(3)
    for n in (1, 2, 10, 1000):
        for p in (0.02, 0.3, 0.9):
            a, b = (np.append(np.flatnonzero(rng.random(n - 1) < p) + 1, n) for _ in range(2))
            ga, gb, count = T.groups(a, b)
            common = np.intersect1d(a, b)
            assert count == len(common)
            assert np.array_equal(ga, np.searchsorted(common, a)) and np.array_equal(gb, np.searchsorted(common, b))


def test_long_chain_converges():
    """One group of 200,001 tokens: a doubling needs 18 steps where following pointers needs 200,000."""
    a, b = np.append(np.arange(1, 200_000, 2), 200_000), np.arange(2, 200_001, 2)
    a = a[a != 200_000]
    a = np.append(a, 200_000)
    ga, gb, n = T.groups(a, b)
    assert n == 1 and not ga.any() and not gb.any()


def test_large_group_is_not_listed(pair):
    """One group of 3,001 and 3,000 tokens of which few differ: nine million links, two pairs."""
    one, two, other = (next(i for i, x in enumerate(t) if len(x) == n) for t, n in ((pair.a_bytes, 1), (pair.a_bytes, 2), (pair.b_bytes, 2)))
    made = T.Aligned(pair, np.array([one] + [two] * 2999 + [one]), np.array([3001]), np.array([other] * 3000), np.array([3000]))
    assert made.n_groups.tolist() == [1] and made.n_links.tolist() == [3001 * 3000]
    assert sorted(zip(made.pair_a.tolist(), made.pair_b.tolist(), made.times.tolist(), strict=True)) == sorted([(one, other, 6000), (two, other, 2999 * 3000)])


def test_empty_table(spark):
    assert T.align(spark.createDataFrame([], DOCS), *PATHS).collect() == []


def test_pair_table(spark, pair):
    docs = [(i, t, 1, 2) for i, t in enumerate(["the cat", "the dog", "the the", "caté"])]
    rows = T.links(T.aligned_blocks(spark.createDataFrame(docs, DOCS), *PATHS)).collect()
    count = Counter(p for d in docs for p in {(x, y) for left, right in _whole(pair, d[1]) for x in left for y in right})
    assert {(r["a"], r["b"]): r["count"] for r in rows} == dict(count)
    for r in rows:
        assert r["best"] == (r["count"] == max(n for (x, _), n in count.items() if x == r["a"]))

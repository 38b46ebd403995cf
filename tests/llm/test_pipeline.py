"""The whole pipeline against a plain Python version, stage by stage, on a small folder of tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from brevilog.llm import bpe, quality_rules
from .test_text_operators import plain_signals, words_of

pipeline = pytest.importorskip("corpus_pipeline")


def make_tables(spark, folder):
    r = random.Random(12)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, base, items = say(45), say(150), [say(30) for _ in range(4)]
    docs = [(0, None), (1, ""), (2, "too short to keep")]
    for i in range(3, 120):
        words, kind = say(r.randint(60, 160)), i % 9
        if kind == 1:
            words[30:30] = passage
        if kind == 2:
            words = list(base)
            words[r.randrange(150)] = f"edit{i}"
        if kind == 3:
            words = [w + r.choice(["###", "$$$", "&&&"]) for w in words]
        if kind == 4:
            words = [w for w in say(12) for _ in range(8)]
        if kind == 5 and i % 2:
            words[20:20] = items[i % 4]
        docs.append((i, " ".join(words)))
    docs += [docs[12], (500, docs[13][1])]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def votes_of(s):
    words, chars, symbols, dups, repeats, lines, upper, distinct, marked, letters = s
    vote = lambda bad, good: None if not words else 0 if bad else 1 if good else None
    return (vote(20 * symbols > chars, 200 * symbols <= chars), vote(5 * marked > words, 50 * marked <= words),
            vote(10 * letters < 9 * chars, 100 * letters >= 95 * chars), vote(10 * dups > 3 * lines, 20 * dups <= lines),
            vote(5 * repeats > words, 50 * repeats <= words), vote(2 * chars < 5 * words or chars > 12 * words, 3 * words <= chars <= 10 * words),
            vote(4 * upper > chars, 10 * upper <= chars),
            vote(40 <= words < 1000 and 10 * distinct < 4 * words, words >= 40 and 10 * distinct >= 6 * words))


NAMES = ["symbols", "marked", "letters", "lines", "repeats", "word_length", "capitals", "variety"]


def good(docs):
    seen = [plain_signals(t) for _, t in docs]
    count = collections.Counter(votes_of(s) for s in seen)
    model = quality_rules.estimate(sorted(count.items(), key=repr), NAMES)
    kept = []
    for row, s in zip(docs, seen, strict=True):
        odds = math.log(model.prior / (1 - model.prior))
        odds += sum(model.weight(n)[v] for n, v in zip(NAMES, votes_of(s), strict=True) if v is not None)
        if odds >= 0 and s[0] >= 20 and 100 * s[4] <= 30 * s[0]:
            kept.append(row)
    return kept


def grams(t):
    w = words_of(t, lower=True)
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def one_of_each(docs):
    sets, up = [grams(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(docs[i])
    return [min(g) for g in groups.values()]


def cut(docs):
    seen = collections.Counter()
    for _, t in docs:
        w = words_of(t)
        seen.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    out = []
    for i, t in docs:
        w = words_of(t)
        gone = {q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        out.append((i, " ".join(x for q, x in enumerate(w) if q not in gone) if gone else t))
    return out


def test_run_as_in_plain_python(spark, tmp_path):
    docs, items = make_tables(spark, tmp_path)
    kept = good(docs)
    assert 0 < len(kept) < len(docs) - 10
    single = one_of_each(kept)
    assert len(single) < len(kept)
    shorter = cut(single)
    assert shorter != single
    clean = [(i, t) for i, t in shorter if not any(100 * len(grams(" ".join(x)) & grams(t)) >= 80 * len(grams(" ".join(x))) for x in items)]
    assert len(clean) < len(shorter)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in clean:
        ids = encoding.encode_ordinary(t)
        want.append((i, ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.ids, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_stages():
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "bpe"]

"""Operators on documents against plain Python, on small tables with nulls, ties, empty and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from brevilog.llm import bpe, decontaminate, minhash_dedup, mixing_lm, pairwise_quality, quality_rules, substring_dedup

SCHEMA = "doc_id long, text string, lang string, k1 string, parts int, signals string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_rows(seed=3, n=90):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(60)]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, base = say(50), say(120)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "a b c d"), (6, "x " * 80), (7, "w" * 5000)]
    for i in range(8, n):
        kind = i % 6
        words = say(r.randint(1, 140))
        if kind == 1:
            words[len(words) // 2 : len(words) // 2] = passage
        if kind == 2:
            words = list(base)
            words[r.randrange(120)] = f"Edit{i}"
        if kind == 3:
            words = list(base)
        rows.append((i, r.choice([" ", "\n", "  "]).join(words)))
    rows += [rows[20], rows[20], (None, rows[30][1]), (None, None)]
    return [(i, t, "en", "k", 1, "s") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def test_substring_dedup(docs, rows, empty):
    seen = collections.Counter()
    for _, t, *_ in rows:
        w = words_of(t)
        seen.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words_of(t)
        gone = {q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        want[(i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs).collect())
    assert got == want
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = {(i, t) for i, _, n, t in want if n}
    assert {(r.doc_id, r.text) for r in out.collect()} >= kept
    assert substring_dedup.dedup(empty).count() == 0


def brute_components(rows):
    sets = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = words_of(t, lower=True)
        s = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        if i is not None:
            sets[i].append(s)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def test_near_duplicates(docs, rows, empty):
    want = brute_components(rows)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = minhash_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, c in want.items() if i == c} | {None}
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_many_near_copies_cost_few_pairs(spark):
    """Copies of one text with edits of their own, some too far apart to be linked: same components as by brute force."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for p in r.sample(range(150), r.choice([0, 1, 2, 3, 4, 6])):
            words[p] = f"e{i}x{p}"
        rows.append((i, " ".join(words), "en", "k", 1, "s"))
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows)


def test_estimates_decide_nothing(docs, rows, monkeypatch):
    """A pair whose sketches look unlike is still decided on full sets."""
    monkeypatch.setattr(minhash_dedup, "estimate", lambda a, b, k: F.lit(0.0))
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(docs).collect() if x.doc_id is not None}
    assert got == brute_components(rows)


def test_pipeline_drops_copies_from_80_percent(spark):
    import corpus_pipeline
    base = [f"w{i}" for i in range(204)]  # 200 shingles; each edit far from others changes five
    far = lambda n: [f"e{i}" if i % 20 == 10 and i // 20 < n else w for i, w in enumerate(base)]
    texts = [base, far(4), far(5)]  # similarity to the first: 180/220 = 0.818, 175/225 = 0.778
    docs = spark.createDataFrame([(0, " ".join(texts[0])), (1, " ".join(texts[1]))], "doc_id long, text string")
    other = spark.createDataFrame([(0, " ".join(texts[0])), (2, " ".join(texts[2]))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [0]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, other, "").collect()) == [0, 2]
    assert minhash_dedup.list_share(32, 85) == 0.5 and minhash_dedup.list_share(32, 80) == 13 / 32


def test_decontamination(spark, docs, rows, empty):
    words = words_of(rows[14][1])
    items = [(0, " ".join(words_of(rows[16][1])[:60])), (1, " ".join(words[5:40]) + " and more that no text has at all"), (2, None), (3, ""), (4, "one"),
             (None, "nothing like it stands anywhere here"), (5, rows[21][1]), (5, rows[21][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.k1, r.i1) for r in decontaminate.contained(docs, table).collect()}

    def grams(t):
        w = words_of(t, lower=True)
        return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = {(i, j) for i, t, *_ in rows for j, x in items if (s := grams(x)) and 100 * len(s & grams(t)) >= 80 * len(s)}
    assert got == want and want
    left = decontaminate.drop_contaminated(docs, table)
    bad = {i for i, _ in want}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - bad
    assert decontaminate.contained(empty, table).count() == 0
    assert decontaminate.contained(docs, table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe(spark, docs, rows, empty, ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    odd = [("".join(r.choices(list("ab's't re ll \n\t 12²é中!? \x1c😀"), k=r.randint(0, 60)))) for _ in range(300)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*odd, "it's we'll <|endoftext|>", "ab" * 3000])],
                                                                     "doc_id long, text string"))
    want = collections.Counter((x.doc_id, tuple(encoding.encode_ordinary(x.text or "")), (x.text or "").encode()) for x in more.collect())
    done = bpe.decode(bpe.encode(more, ranks), ranks)
    assert collections.Counter((x.doc_id, tuple(x.ids), bytes(x.bytes)) for x in done.collect()) == want
    one = bpe.digests(done).where("doc_id = 1301").first() or bpe.digests(done).where("doc_id = 8").first()
    ids = next(k for k in want if k[0] == one.doc_id)
    assert one.n_tokens == len(ids[1]) and one.ids_sha256 == hashlib.sha256(np.array(ids[1], "<u4").tobytes()).hexdigest()
    once = bpe.decoded_digests(bpe.encode(more, ranks), ranks)
    assert collections.Counter(once.collect()) == collections.Counter(bpe.digests(done).collect())
    assert bpe.decode(bpe.encode(empty, ranks), ranks).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), ranks).collect()


def test_quality_rules(docs, rows, empty):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        s = x.signals
        assert x.base_failed == (s.n_words < 20 or 100 * s.n_repeat_words > 30 * s.n_words)
        assert not (x.base_failed and x.kept)
    left = quality_rules.filter_documents(docs)
    assert left.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(repr(x.doc_id) for x in got if x.kept)
    assert quality_rules.judge(empty).count() == 0


def plain_signals(text):
    """The signals by their definitions."""
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = collections.Counter(tuple(words[p : p + 8]) for p in range(len(words) - 7))
    again = {q for p in range(len(words) - 7) if runs[tuple(words[p : p + 8])] > 1 for q in range(p, p + 8)}
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(lines),
            len(re.findall("[A-Z]", text or "")), len(set(words)), sum(1 for w in words if re.search("[#*$%&|<>]", w)),
            sum(1 for c in text or "" if re.match("[A-Za-z]", c) or ord(c) > 127)]


def test_signals():
    import pyarrow as pa
    from brevilog.llm.common import pieces
    r = random.Random(9)
    texts = ["a\n\na\n \nb\n", "x " * 30, "é\ná é\né", "A*b |c| #", "", "\n", " \t"]
    texts += ["".join(r.choice(["a", "b", "é", " ", " ", "\n", "#", "B", "中", "\x0b"]) for _ in range(r.randint(0, 200))) for _ in range(400)]
    texts += [" ".join(r.choice("ab") for _ in range(40)) + "\n" + " ".join(r.choice("ab") for _ in range(40)) for _ in range(50)]
    for limit in (1 << 20, 300):
        for lo, hi, data, offs in pieces(pa.array(texts), limit):
            got = np.stack(quality_rules.signal_columns(data, offs), 1).tolist()
            assert got == [plain_signals(t) for t in texts[lo:hi]]


def made_votes(n, prior, rates, seed=1, silent=0.2):
    """Votes of n texts of which a share is good; a rule is silent at times; rates: votes of bad on bad, on good texts."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < prior
    votes = np.stack([np.where(rng.random(n) < np.where(good, g, b), 0, 1) for b, g in rates], 1)
    votes = np.where(rng.random(votes.shape) < silent, -1, votes)
    count = collections.Counter(tuple(None if v < 0 else int(v) for v in row) for row in votes.tolist())
    return good, votes, sorted(count.items(), key=repr)


@pytest.mark.parametrize("prior", [0.3, 0.7, 0.9])
def test_share_and_accuracies_are_found(prior):
    rates = [(0.8, 0.05), (0.6, 0.1), (0.9, 0.2), (0.4, 0.02), (0.7, 0.3)]
    _, _, patterns = made_votes(200_000, prior, rates)
    model = quality_rules.estimate(patterns, list("abcde"))
    assert abs(model.prior - prior) < 0.02
    for name, (b, g) in zip("abcde", rates, strict=True):
        assert abs(model.bad_rate[name][0] - b) < 0.04 and abs(model.bad_rate[name][1] - g) < 0.04


def test_votes_of_bad_can_be_outweighed(spark):
    """Texts that two weak rules call bad and four strong ones good are kept; a text that one strong rule calls bad may be too."""
    rates = [(0.9, 0.02)] * 4 + [(0.5, 0.3)] * 2
    _, _, patterns = made_votes(100_000, 0.8, rates)
    names = [f"r{i}" for i in range(6)]
    model = quality_rules.estimate(patterns, names)

    def odds(votes):
        frame = spark.createDataFrame([votes], ", ".join(f"{n} int" for n in names))
        return frame.select(model.log_odds({n: F.col(n) for n in names}).alias("x")).first().x
    assert odds((1, 1, 1, 1, 0, 0)) > 0 and odds((0, 1, 1, 1, 1, 1)) > 0
    assert odds((0, 0, 1, 1, 0, 0)) < 0 and odds((0, 0, 0, 1, 1, 1)) < 0
    assert odds((None,) * 6) == pytest.approx(math.log(model.prior / (1 - model.prior)))


def test_rule_that_is_no_better_than_chance_counts_for_nothing():
    _, _, patterns = made_votes(100_000, 0.8, [(0.9, 0.05), (0.8, 0.05), (0.7, 0.1), (0.1, 0.5)])
    model = quality_rules.estimate(patterns, list("abcd"))
    assert model.bad_rate["d"][0] == model.bad_rate["d"][1] and model.weight("d") == (0.0, 0.0)
    assert quality_rules.estimate([], ["a"]).prior == quality_rules.PRIORS[0]


def test_posterior_as_by_hand(docs):
    """The verdict of each document from its signals, by the fitted model in plain Python."""
    seen = quality_rules.signals(docs.select("doc_id", "text"), name="s_")
    model = quality_rules.fit(seen, "s_")
    votes = quality_rules.rules(F.col("s_"))
    rows = seen.select(quality_rules.posterior(model, F.col("s_")).alias("p"), *[v.alias(n) for n, v in votes.items()]).collect()
    for r in rows:
        good, bad = model.prior, 1 - model.prior
        for n in votes:
            on_bad, on_good = model.bad_rate[n]
            if r[n] is not None:
                good, bad = good * (on_good if r[n] == 0 else 1 - on_good), bad * (on_bad if r[n] == 0 else 1 - on_bad)
        assert r.p == pytest.approx(good / (good + bad), rel=1e-6, abs=1e-12)


def test_pairwise_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 6 in (2, 3)), 0) for i in range(8, 90)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = pairwise_quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    right = [x.predicted == int(x.doc_id % 6 in (2, 3)) for x in got if x.doc_id is not None and x.doc_id >= 8]
    assert sum(right) > 0.8 * len(right)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    none = pairwise_quality.classify(docs, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    assert pairwise_quality.classify(empty, labels).count() == 0


def test_mixing_lm(docs, rows, empty):
    got = mixing_lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    count = collections.Counter()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    for i, t, *_ in rows:
        if not held(i):
            count.update([*words_of(t, lower=True), None])
    total, kinds = sum(count.values()), len(count)
    by_id = collections.defaultdict(list)
    for x in got:
        by_id[x.doc_id].append(x)
    for i, t, *_ in rows:
        w = [*words_of(t, lower=True), None]
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w)
        assert any(abs(x.base_score - base) < 1e-6 * abs(base) and x.n_tokens == len(w) and x.n_known == sum(count[k] > 0 for k in w)
                   and x.train_tokens == total and x.held_out == held(i) and x.score < 0 for x in by_id[i])
    # the probabilities of all continuations of one bit add up to one: a text and its complement
    assert mixing_lm.score_documents(empty).count() == 0


def test_bit_probabilities_are_proper():
    """Whatever was learned before, the two values of a bit have probabilities that add up to one."""
    r = np.random.default_rng(1)
    x, sign = r.normal(size=(3, 400)).astype(np.float32), np.where(r.random(400) < 0.7, 1, -1).astype(np.float32)
    start = np.full(3, 0.3)
    last = np.array([0, 400])
    before = mixing_lm.mix_stream(x[:, :399], sign[:399], np.array([0, 399]), start)[0]
    flip = sign.copy()
    flip[-1] *= -1
    a, b = (mixing_lm.mix_stream(x, s, last, start)[0] - before for s in (sign, flip))
    assert abs(math.exp(a) + math.exp(b) - 1) < 1e-4
    tree = mixing_lm.code_tree(np.array([5, 900, 3] + [0] * 253))
    assert abs(sum(2.0 ** -tree.size) - 1) < 1e-12 and tree.size[1] == tree.size.min()


def test_every_context_is_counted_by_itself(docs, rows):
    """The table of contexts grows with the texts, and no two contexts share their counts."""
    from brevilog.llm.common import keyed
    want = collections.Counter()
    for _, t, *_ in rows:
        text = " ".join(words_of(t, lower=True)).encode() + b"\n"
        for at, byte in enumerate(text):
            before = b"\n" * 6 + text[:at]
            want.update((order, before[-k:], byte) for order, k in enumerate((2, 3, 4, 6)))
    got = mixing_lm.context_counts(keyed(docs, "doc_id", "text")).collect()
    found = {(x.ctx >> 56, x.ctx.to_bytes(8, "big")[8 - (2, 3, 4, 6)[x.ctx >> 56] :], v & 255): v >> 8 for x in got for v in x.held if x.ctx >> 56 < 4}
    assert found == want
    assert len(got) > len({k[:2] for k in want})


def test_all_training_rows_are_counted(docs):
    from brevilog.llm.common import keyed
    rows = keyed(docs, "doc_id", "text")
    model = mixing_lm.train(rows)
    key = lambda x: (x.ctx, tuple(sorted(x.held)))
    assert sorted(map(key, model.counts.collect())) == sorted(map(key, mixing_lm.context_counts(rows).collect()))


def test_first_weights_learn_from_all_training_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of many, each with a number such as {i * 7919 % 1000}") for i in range(1200)], "doc_id long, text string")
    seen, real = [], mixing_lm.first_weights

    def spy(texts, *rest):
        seen.extend(x.k1 for x in texts.collect())
        return real(texts, *rest)
    monkeypatch.setattr(mixing_lm, "first_weights", spy)
    assert mixing_lm.score_documents(docs).count() == 1200
    assert sorted(seen) == [i for i in range(1200) if zlib.crc32(str(i).encode()) % 7 != 2]


def test_fits_of_pieces_make_the_fit_of_the_whole():
    r = np.random.default_rng(2)
    x = r.normal(size=(mixing_lm.ORDERS, 40_000)).astype(np.float32)
    true = np.linspace(-0.1, 0.7, mixing_lm.ORDERS)
    sign = np.where(r.random(x.shape[1]) < 1 / (1 + np.exp(-true @ x)), 1, -1).astype(np.float32)
    parts = [mixing_lm.fit(x[:, k::4], sign[k::4]) for k in range(4)]
    got = np.linalg.solve(sum(h for h, _ in parts), sum(b for _, b in parts))
    hess, best = mixing_lm.fit(x, sign)
    assert np.abs(got - np.linalg.solve(hess, best)).max() < 0.005 and np.abs(got - true).max() < 0.05
    none = mixing_lm.fit(x[:, :0], sign[:0])
    assert not none[0].any() and not none[1].any()


def test_the_end_of_a_long_text_teaches_too():
    sign = np.ones(120_000, np.float32)
    sign[70_000:] = -1
    x, last = np.ones((3, len(sign)), np.float32), lambda n: np.array([0, n])
    cost = mixing_lm.mix_stream(x[:, :70_000], sign[:70_000], last(70_000), np.full(3, 0.3))[0] - mixing_lm.mix_stream(x, sign, last(len(sign)), np.full(3, 0.3))[0]
    assert cost < 0.5 * 50_000 * math.log(2)


def test_contexts_travel_packed(spark, docs, rows):
    """A block asks for its contexts by one row for each bucket, not for each context, and settings are put back."""
    from brevilog.llm.common import keyed
    before = {key: spark.conf.get(key, None) for key in mixing_lm.LEAN}
    model = mixing_lm.train(keyed(docs, "doc_id", "text"))
    held = model.blocks.select("block", "bucket").collect()
    assert len(held) == len(set(held)) <= len({x.block for x in held}) * (mixing_lm.MIN_BUCKETS + 1)
    assert len(held) * 10 < model.counts.count()
    assert sorted(x.k1 for x in mixing_lm.score(model).collect() if x.k1 is not None) == sorted(i for i, *_ in rows if i is not None)
    assert {key: spark.conf.get(key, None) for key in mixing_lm.LEAN} == before


def test_packed_pairs_come_back():
    r = np.random.default_rng(5)
    for size in (0, 1, 9, 4000):
        parts = [np.sort(np.unique(r.integers(0, 2**high, size, dtype=np.uint64))) for high in (12, 24, 40, 56, 63)]
        got = mixing_lm.unpacked(mixing_lm.packed(parts))
        assert all(np.array_equal(a, b) for a, b in zip(got, parts, strict=True))
        n = [r.integers(0, 2**40, len(p)) for p in parts]
        assert np.array_equal(mixing_lm._unpack_counts(mixing_lm._pack_counts(n)), np.concatenate(n))


def test_odds_of_paths_are_sums_over_neighbours():
    """Log-odds from runs of neighbours are those of counts below each node of the tree."""
    r = np.random.default_rng(6)
    code = mixing_lm.code_tree((1000 / (1 + np.arange(256)) ** 2).astype(np.int64))
    pairs = np.unique(r.integers(0, 30, 600, dtype=np.uint64) << np.uint64(8) | code.rank[np.minimum(r.geometric(0.1, 600), 255)])
    n = r.integers(0, 50, len(pairs))
    odds, begin = mixing_lm.path_odds(code, pairs, n)
    byte, ctx = code.byte[(pairs & np.uint64(255)).astype(int)], pairs >> np.uint64(8)
    path = lambda b: [(int(code.node[code.first[b] + d]), int(code.sign[code.first[b] + d])) for d in range(code.size[b])]
    count = collections.Counter()
    for b, c, k in zip(byte, ctx, n, strict=True):
        for step in path(b):
            count[(c, *step)] += k
    for b, c, lo in zip(byte, ctx, begin, strict=True):
        want = [math.log((count[(c, node, 1)] + 0.3) / (count[(c, node, -1)] + 0.3)) for node, _ in path(b)]
        assert np.allclose(odds[lo : lo + len(want)], want, atol=1e-4)
    own = r.random(len(pairs)) < 0.3
    own |= np.isin(ctx, np.setdiff1d(ctx, ctx[own]))  # a block asks for contexts that it has
    fewer, sums = mixing_lm.beside(code, pairs, n, own)
    assert own.sum() <= len(fewer) < len(pairs) and sums.sum() == n.sum()
    less, at = mixing_lm.path_odds(code, fewer, sums)
    place = dict(zip(fewer.tolist(), at.tolist(), strict=True))
    for pair, b, lo in zip(pairs[own].tolist(), byte[own], begin[own], strict=True):
        assert np.allclose(less[place[pair] : place[pair] + code.size[b]], odds[lo : lo + code.size[b]], atol=1e-5)


def test_words_of_the_base_travel_packed(spark, docs, rows, monkeypatch):
    """A block has one row for each bucket of words, not for each word."""
    written, real = {}, mixing_lm.stash

    def spy(df, name):
        written[name] = real(df, name)
        return written[name]
    monkeypatch.setattr(mixing_lm, "stash", spy)
    mixing_lm.score_documents(docs).count()
    words = written["words"].select("block", "bucket").collect()
    assert len(words) == len(set(words)) <= len({x.block for x in words}) * (mixing_lm.MIN_BUCKETS + 1)
    assert len(words) < len({w for _, t, *_ in rows for w in words_of(t, lower=True)})


def test_blocks_are_moved_in_groups(spark, monkeypatch):
    """All blocks are in one group each, and scores don't depend on groups."""
    docs = spark.createDataFrame([(i, f"text {i} of many " * 40) for i in range(60)], "doc_id long, text string").repartition(8)
    path = mixing_lm.stash(docs, "docs")
    whole = {x.doc_id: x.score for x in mixing_lm.score_documents(path).collect()}
    monkeypatch.setattr(mixing_lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(mixing_lm, "first_weights", lambda *_: np.full((mixing_lm.GATES, mixing_lm.ORDERS), 0.3))
    groups = {x.doc_id: x.score for x in mixing_lm.score_documents(path).collect()}
    monkeypatch.setattr(mixing_lm, "WAVES", 1)
    one = {x.doc_id: x.score for x in mixing_lm.score_documents(path).collect()}
    assert whole.keys() == groups.keys() == one.keys()
    assert all(abs(groups[k] - one[k]) < 1e-6 * abs(one[k]) for k in one)


def test_the_jvm_scores_and_fits_as_numpy_does(spark):
    """Mixing.java against path_odds, bits_of, mix_stream and fit, place by place."""
    from brevilog.llm.jvm import function
    from pyspark.sql.types import ArrayType, DoubleType
    r = np.random.default_rng(8)
    vocabulary = ["a", "of", "the", "number", "international", "internationally", "context", "\u00e9t\u00e9", "x" * 300]
    texts = pa.array([" ".join(r.choice(vocabulary, n)) for n in (0, 1, 7, 900, 30, 3000)])
    data, offs = mixing_lm.utf8(texts)
    out, at, first = mixing_lm.normal(data, offs)
    code = mixing_lm.code_tree(np.bincount(out[at], minlength=256))
    place = np.zeros(len(out), bool)
    place[at] = True
    pairs, n = zip(*mixing_lm._block_pairs(code, [(out, place, np.ones(len(at), bool))]), strict=True)
    counts = [v + r.integers(0, 9, len(v)) for v in n]
    weights = r.normal(0.2, 0.1, (mixing_lm.GATES, mixing_lm.ORDERS))
    held = [mixing_lm.packed(list(pairs))], [mixing_lm._pack_counts(counts)]

    def jvm(weights, part_bytes=None):
        row = pa.RecordBatch.from_arrays(mixing_lm.taken(code, weights, texts, *held, part_bytes), schema=mixing_lm._TAKEN_ARROW).to_pylist()
        block = spark.createDataFrame([tuple(map(bytearray, row[0].values()))], mixing_lm._TAKEN)
        return np.array(block.select(function(spark, "Mixing", ArrayType(DoubleType()))(*mixing_lm._TAKEN_ARROW.names)).first()[0])

    # where each place is among the pairs of an order: by the bytes before it
    word = [bytes(out[:p]).replace(b"\n", b" ").rpartition(b" ")[2] for p in at]
    hashed = dict(zip(word, (mixing_lm.rolling_hashes(np.frombuffer(w, np.uint8).astype(np.uint64) + np.uint64(1), np.zeros(1, int), np.full(1, len(w))) for w in word), strict=True))
    keys = [np.array([int.from_bytes(bytes(out[p - k : p]), "big") << 8 | int(code.rank[out[p]]) for p in at], np.uint64) for k in mixing_lm.LENGTHS]
    keys.append(np.array([int(hashed[w][0]) >> 8 << 8 | int(code.rank[out[p]]) for w, p in zip(word, at, strict=True)], np.uint64))
    rows = [np.searchsorted(p, k) for p, k in zip(pairs, keys, strict=True)]
    assert all((p[i] == k).all() for p, i, k in zip(pairs, rows, keys, strict=True))

    def gates(counts):
        odds = [(values, begin[i]) for (values, begin), i in zip((mixing_lm.path_odds(code, *x) for x in zip(pairs, counts, strict=True)), rows, strict=True)]
        return mixing_lm.bits_of(code, out[at], np.isin(out[at - 1], (0x20, 10)), odds)
    want = sum(mixing_lm.mix_stream(x, sign, np.append(0, np.cumsum(m))[first], weights[g]) for g, (m, x, sign) in enumerate(gates(counts)))
    assert np.allclose(jvm(weights), want, rtol=1e-4, atol=1e-4)
    got = jvm(None, len(data) + 1).reshape(mixing_lm.GATES, -1)
    rest = [c - v for c, v in zip(counts, n, strict=True)]
    for g, (_, x, sign) in enumerate(gates(rest)):
        hess, best = mixing_lm.fit(x[:, : -mixing_lm.STRIDE], sign[: -mixing_lm.STRIDE])
        size = np.abs(hess).max() + 1e-9
        assert np.allclose(got[g, 5:].reshape(5, 5) / size, hess / size, atol=2e-3) and np.allclose(got[g, :5] / size, best / size, atol=2e-3)
    with pytest.raises(Exception, match="doesn't fit"):
        held = [mixing_lm.packed([p[:0] for p in pairs])], [mixing_lm._pack_counts([v[:0] for v in n])]
        jvm(weights)


# --- texts that collide in linear hashes ---------------------------------------------

def two_letters(n, flip=False):
    """The Thue-Morse string of a and b and its mirror image have equal polynomial hashes modulo 2^64, whatever the base."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


@pytest.mark.parametrize("n", [256, 1024, 2048, 8192])
def test_regular_words_differ(n):
    import pyarrow as pa
    from brevilog.llm import common
    words = [two_letters(n), two_letters(n, True)]
    for which in range(8):
        (_, _, data, offs), = common.pieces(pa.array(words))
        h = common.byte_hashes(data, offs[:-1], offs[1:], which)
        assert h[0] != h[1]
        seq = [np.array([{"a": 7, "b": 9}[c] for c in w], np.uint64) for w in words]
        flat, at = np.concatenate(seq), np.array([0, n])
        one, two = common.span_hashes(flat, at, at + n, which)
        assert one != two
        assert common.gram_hashes(seq[0], n, which)[0] != common.gram_hashes(seq[1], n, which)[0]


def test_hashes_depend_on_content_only():
    import pyarrow as pa
    from brevilog.llm import common
    r = random.Random(2)
    texts = ["".join(r.choices("abé ", k=r.randint(0, 40))) for _ in range(500)]
    (_, _, data, offs), = common.pieces(pa.array(texts))
    h = common.byte_hashes(data, offs[:-1], offs[1:], 2)
    assert len(set(zip(texts, h.tolist(), strict=True))) == len(set(texts)) == len(set(h.tolist()))
    values = np.random.default_rng(1).integers(0, 3, 4000).astype(np.uint64)
    for k in (1, 2, 5, 8, 35):
        grams = common.gram_hashes(values, k, 1).tolist()
        assert len({(tuple(values[i : i + k].tolist()), g) for i, g in enumerate(grams)}) == len(set(grams)) == len({tuple(values[i : i + k].tolist()) for i in range(len(grams))})
    starts = np.sort(np.random.default_rng(2).integers(0, 3900, 300))
    ends = starts + np.random.default_rng(3).integers(0, 90, 300)
    spans = common.span_hashes(values, starts, ends, 1).tolist()
    assert len({(tuple(values[a:b].tolist()), g) for a, b, g in zip(starts, ends, spans, strict=True)}) == len(set(spans))
    assert common.span_hashes(values[7:], starts[starts >= 7] - 7, ends[starts >= 7] - 7, 1).tolist() == [g for a, g in zip(starts, spans, strict=True) if a >= 7]


@pytest.mark.parametrize("n", [256, 4096])
def test_operators_tell_regular_texts_apart(spark, ranks, n):
    one, other = two_letters(n), two_letters(n, True)
    tail = " ".join(f"t{i}" for i in range(40))
    head = " ".join(f"h{i}" for i in range(40))
    spread = lambda w: " ".join(w)
    texts = [f"{tail[:60]} {one} {head[:60]}", f"{tail[:60]} {other} {head[:60]}", spread(one), spread(other), f"{one}\n{other}\n{one}"]
    rows = [(i, t, "en", "k", 1, "s") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    test_substring_dedup(frame, rows, frame.limit(0))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame).collect()}
    assert got == brute_components(rows)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.ids for r in bpe.encode(frame, ranks).collect()} == {i: encoding.encode_ordinary(t) for i, t, *_ in rows}
    assert decontaminate.contained(frame.where("doc_id = 2"), spark.createDataFrame([(0, other)], "item_id long, text string")).count() == 0
    for r in quality_rules.signals(frame.select("doc_id", "text")).collect():
        assert list(r.signals) == plain_signals(r.text)


def test_words_with_one_hash_take_another(spark, ranks, monkeypatch):
    """Two words that the first two hashes don't tell apart are encoded by the third."""
    real = bpe.word_hashes
    monkeypatch.setattr(bpe, "word_hashes", lambda d, s, e, which=0: np.zeros(len(s), np.uint64) if which < 2 else real(d, s, e, which))
    block = bpe._Block(0, 8)
    import pyarrow as pa
    from brevilog.llm import common
    for lo, hi, data, offs in common.pieces(pa.array(["a b c a", "b d"])):
        block.add(pa.array([1, 2], pa.int64()), data, offs)
    _, group, n, _, _ = block.sort()
    assert len(group) == 6 and n.sum() == 6


# --- greedy factors ------------------------------------------------------------------

def test_factors_are_copies(spark):
    """Each factor is a copy of its source, as long as it says; factors of one copied stretch are joined."""
    r = random.Random(11)
    say = lambda k: [f"v{r.randrange(10**6)}" for _ in range(k)]
    shared = say(400)
    texts = [say(30) + shared + say(50), say(80) + shared[:300] + say(20) + shared[250:], say(300)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = substring_dedup.keyed(docs, "doc_id", "text")
    every = substring_dedup.blocks(rows)
    first = every.groupBy("anchor", "block").agg(F.min(F.struct("k1", "k2", "lo")).alias("f"), F.max(F.struct("k1", "k2", "lo")).alias("l"), F.count("*").alias("n")).where("n > 1")
    me = F.struct("k1", "k2", "lo")
    src = F.when(F.col("f") == me, F.col("l")).otherwise(F.col("f"))
    again = every.join(first, ["anchor", "block"]).select("k1", "k2", "lo", "hi", src["k1"].alias("src"), src["k2"].alias("src2"), src["lo"].alias("src_lo"))
    found = substring_dedup.parse(again).collect()
    for f in found:
        assert texts[f.k1][f.lo : f.lo + f.n_words] == texts[f.src][f.src_lo : f.src_lo + f.n_words] and f.n_words >= 35
    assert max(f.n_words for f in found if f.k1 == 1) > 200  # many blocks, one factor
    assert sum(1 for f in found if f.k1 == 1) < again.where("k1 = 1").count() / 3

"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from brevilog.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<float>, label int, a int, score int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (16, 16, 16), (17, 33, 65), (64, 64, 64), (40, 64, 129), (100, 3, 90)])
@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_strassen_is_exact(shape, leaf):
    m, k, n = shape
    rng = np.random.default_rng(m * k + n)
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    assert np.array_equal(H.strassen(a, b, leaf), a @ b)


def test_strassen_wraps_back():
    """Intermediate sums beyond 64 bits don't matter if the result fits."""
    a = np.full((4, 4), 2**62, np.int64)
    b = np.zeros((4, 4), np.int64)
    b[0], b[1] = 1, -1
    assert not H.strassen(a, b, 1).any()


def test_heaps_merge():
    rng = np.random.default_rng(5)
    entries = [(int(h), int(s), int(i)) for i, (h, s) in enumerate(rng.integers(0, 9, (400, 2)))]
    heaps = H.Heaps(9, 4)
    for lo in range(0, 400, 37):
        heaps.take(*(np.array(x) for x in zip(*entries[lo : lo + 37], strict=True)))
    expected = [e for h in range(9) for e in sorted((x for x in entries if x[0] == h), key=lambda x: (-x[1], x[2]))[:4]]
    assert list(zip(heaps.heap.tolist(), heaps.score.tolist(), heaps.id.tolist(), strict=True)) == expected


def _brute(rows, is_anchor):
    held = []
    for i, v, label, *_ in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in {(i, k, tuple(v)) for i, k, v in held if is_anchor(i)}:
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), j, k) for j, k, w in held if j != i), key=lambda x: x[:2])
        for place, (p, j, _) in enumerate([x for x in scored if x[2] == label][:5], 1):
            fits = [(n, m) for n, m, k in scored if k != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, rank, m, -p, -n, place) for rank, (n, m) in enumerate(fits, 1)]
    return sorted(out)


def _mined(spark, rows, is_anchor):
    held = H.quantized(spark.createDataFrame(rows, ROWS).repartition(3))
    return sorted(map(tuple, H.mine(held, held.where(is_anchor)).collect()))


def _vectors(rng, n, width):
    return [(i, [float(x) for x in rng.normal(0.1, 0.3, width)], int(rng.integers(0, 3)), 0, 0) for i in range(n)]


def test_as_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(H, "CANDIDATE_BLOCK", 20)
    rng = np.random.default_rng(1)
    rows = _vectors(rng, 150, 9)
    # ties: equal vectors under many ids; repeated rows; a repeated anchor; lengths that differ
    rows += [(200 + k, rows[0][1], k % 3, 0, 0) for k in range(40)] + [rows[3]] * 12 + [rows[10]] * 3
    rows += [(300, rows[1][1][:4], 1, 0, 0), (301, [], 1, 0, 0), (310, [-x for x in rows[2][1]], 2, 0, 0)]
    # rows that take no part
    rows += [(None, rows[0][1], 1, 0, 0), (320, None, 1, 0, 0), (330, rows[0][1], None, 0, 0), (340, [1.0, None], 1, 0, 0),
             (350, [float("nan")] * 9, 1, 0, 0), (360, [float("inf")] * 9, 1, 0, 0)]
    got = _mined(spark, rows, "id % 10 = 0")
    assert got == _brute(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_tiles_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE_ANCHORS", 3)
    monkeypatch.setattr(H, "TILE_CANDIDATES", 11)
    rows = _vectors(np.random.default_rng(2), 90, 64)
    assert _mined(spark, rows, "id % 5 = 0") == _brute(rows, lambda i: i % 5 == 0)


def test_nothing_to_do(spark):
    assert _mined(spark, [], "true") == []
    assert _mined(spark, [(1, [1.0], 1, 0, 0)], "true") == []
    assert _mined(spark, [(1, [1.0], 1, 0, 0), (2, [1.0], 1, 0, 0)], "true") == []  # no other label
    assert _mined(spark, [(1, [1.0], 1, 0, 0), (2, [1.0], 2, 0, 0)], "id > 5") == []


def test_scores_that_do_not_fit_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        _mined(spark, [(1, [1e12], 1, 0, 0), (2, [1e12], 1, 0, 0)], "true")

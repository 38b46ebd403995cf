"""Sharding: the permutation, global numbers, hot rows and odd inputs."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from brevilog.llm import sharding

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_positions_are_a_permutation_that_can_be_undone(spark, n):
    rows = spark.range(n).withColumn("p", sharding.position_of(F.col("id"), n, 7))
    rows = rows.withColumn("back", sharding.row_at(F.col("p"), n, 7)).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["id"] == r["back"] for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 99, 100, 101, 10**6, 10**12 + 1])
def test_sides_are_tight(n):
    a, b = sharding.sides(n)
    assert n <= a * b < n + b and abs(a - b) <= 1


def test_long_walks_end(spark, monkeypatch):
    """With the identity as permutation every number beyond n but one would walk for ever; here each walk is as long as can be."""
    once = lambda x: F.when(x == 4, F.lit(9)).when(x == 19, F.lit(4)).when(x >= 9, x + 1).otherwise(x)
    got = spark.range(9).select(sharding._walked(once, F.col("id"), 9, 11).alias("p")).collect()
    monkeypatch.setattr(sharding, "SHORT_WALK", 2)
    again = spark.range(9).select(sharding._walked(once, F.col("id"), 9, 11).alias("p")).collect()
    assert [r["p"] for r in got] == [r["p"] for r in again] == list(range(9))


def _plain(docs: list[tuple], shards: int, seed: int) -> list[tuple]:
    import hashlib

    rows = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs),
                  key=lambda r: (r[0] is not None, r))
    n = len(rows)
    a, b = sharding.sides(n)

    def once(x):
        left, right = divmod(x, b)
        for turn in range(sharding.ROUNDS):
            half, m = (left, b) if turn % 2 else (right, a)
            d = int(hashlib.md5(f"{half}:{turn}:{seed}".encode()).hexdigest()[:15], 16) % m
            left, right = (left, (right + d) % b) if turn % 2 else ((left + d) % a, right)
        return left * b + right
    out = []
    for x, row in enumerate(rows):
        x = once(x)
        while x >= n:
            x = once(x)
        out.append((*row, x % shards, x // shards))
    return out


def test_documents_as_in_plain_python(spark):
    docs = [(i, f"text {i} é" * (i % 7)) for i in range(200)] + [(None, None), (5, None), (5, ""), (7, "x" * 3_000_000)]
    docs += [(3, "same")] * 150  # a hot row
    frame = spark.createDataFrame(docs, DOCS).repartition(7)
    got = sharding.shard_documents(frame, 8).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got), key=key) == sorted(_plain(docs, 8, sharding.SEED), key=key)
    slots = sorted((r["shard"], r["slot"]) for r in got)
    sizes = [sum(s == k for s, _ in slots) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert slots == [(s, k) for s in range(8) for k in range(sizes[s])]


def test_same_shuffle_however_the_rows_are_dealt(spark):
    docs = spark.createDataFrame([(i, str(i * i)) for i in range(300)], DOCS)
    one, other = (sorted(map(tuple, sharding.shard_documents(d.repartition(k)).collect())) for d, k in ((docs, 1), (docs, 9)))
    assert one == other


def test_slots_lead_back_to_rows(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(101)], DOCS)
    placed = sharding.shuffled(docs, ["doc_id"], 4)
    back = placed.where(sharding.row_of_slot(F.col("shard"), F.col("slot"), 101, 4) == F.col("row_no"))
    assert back.count() == 101


def test_other_columns_stay_and_clashes_are_named(spark, tmp_path):
    docs = spark.createDataFrame([(i, str(i), "a", i, i) for i in range(40)], DOCS + ", _file string, _tie int, _spread int")
    placed = sharding.shuffled(docs, ["doc_id"], 3)
    assert placed.columns == [*docs.columns, *sharding.NEW]
    sharding.write_shards(placed, f"{tmp_path}/shards")
    held = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(r["doc_id"] for r in held.collect()) == list(range(40))
    with pytest.raises(ValueError, match="slot"):
        sharding.shuffled(docs.withColumn("Slot", F.lit(1)), ["doc_id"], 3)


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_no_python_and_one_shuffle_of_rows(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    plan = sharding.shard_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "SinglePartition" in plan and plan.count("BroadcastHashJoin") >= 1

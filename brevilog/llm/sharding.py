"""Sharding by a reproducible shuffle: a Feistel permutation with cycle walking over global row numbers.

1. Rows get global numbers 0..n-1 in the order of the given columns, then of a hash of the whole row. One range shuffle
   sorts them (sampled bounds, so partitions are even), and the written files then hold the numbers: a row's place in its
   file plus the sizes of the files before it. There is no global window over rows and no second shuffle.
2. A number x is taken apart into (x div b, x mod b), where a * b >= n and both are near the square root of n. Six
   half-rounds add a keyed digest of one half to the other, modulo a or b; each can be undone, so the whole permutes
   0..a*b-1. Fewer than b of these numbers are n or more: a row whose number lands there is permuted again until it falls
   below n (cycle walking), which permutes 0..n-1.
3. shard = position mod shards, slot = position div shards: sizes of shards are at most one apart and slots have no gaps.
   Shard and slot of a row number can be computed without data, and so can the row number of a shard and slot.

Only DataFrame functions. The driver gets the number of rows. One small row for each written file is summed and broadcast;
there are at most ``MAX_FILES`` of them.

Cases: null ids sort first; rows with the same id are told apart by the whole row; rows equal in all columns are dealt out
by an extra key, so that a hot row is spread over tasks, and they are interchangeable in the result; null and empty texts
and very long ones are rows as any others (the query takes size and checksum before the shuffle, so texts stay where they
are); an empty table gives an empty result; a column named as one of the result's raises ValueError, other columns are kept.
Map columns can't be hashed and raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

ROUNDS = 6
SEED = 20240229
# Steps of a walk that are laid out for a row that needs any; the longest possible walk only for those that need more.
SHORT_WALK = 16
MAX_FILES = 100_000
NEW = ("row_no", "position", "shard", "slot")


def sides(n: int) -> tuple[int, int]:
    """a and b near the square root of n, with n <= a * b < n + b."""
    b = 1
    while b * b < n:
        b *= 2
    lo = b // 2
    while lo + 1 < b:
        mid = (lo + b) // 2
        lo, b = (lo, mid) if mid * mid >= n else (mid, b)
    return max(1, -(-n // b)), b


def _digest(half: Column, turn: int, seed: int, below: int) -> Column:
    """A keyed number below ``below``: the first 60 bits of an MD5 digest."""
    digest = F.md5(F.concat(half.cast("string"), F.lit(f":{turn}:{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(below)


def _permuted(x: Column, a: int, b: int, seed: int) -> Column:
    left, right = F.call_function("div", x, F.lit(b)), x % F.lit(b)
    for turn in range(ROUNDS):
        if turn % 2:
            right = (right + _digest(left, turn, seed, b)) % F.lit(b)
        else:
            left = (left + _digest(right, turn, seed, a)) % F.lit(a)
    return left * F.lit(b) + right


def _restored(x: Column, a: int, b: int, seed: int) -> Column:
    left, right = F.call_function("div", x, F.lit(b)), x % F.lit(b)
    for turn in reversed(range(ROUNDS)):
        if turn % 2:
            right = (right - _digest(left, turn, seed, b) + F.lit(b)) % F.lit(b)
        else:
            left = (left - _digest(right, turn, seed, a) + F.lit(a)) % F.lit(a)
    return left * F.lit(b) + right


def _walked(once, x: Column, n: int, excess: int) -> Column:
    """``once`` until the number is below n; no walk is longer than the ``excess`` numbers that are not."""
    def walk(steps: int):
        return lambda at: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), at, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    first = once(x)
    if not excess:
        return first
    short = walk(min(SHORT_WALK, excess))(first)
    walked = short if excess <= SHORT_WALK else F.when(short < n, short).otherwise(walk(excess)(short))
    return F.when(first < n, first).otherwise(walked)


def position_of(row_no: Column, n: int, seed: int = SEED) -> Column:
    """Place of a row number in the shuffle of n rows."""
    a, b = sides(n)
    return _walked(lambda x: _permuted(x, a, b, seed), row_no.cast("long"), n, a * b - n)


def row_at(position: Column, n: int, seed: int = SEED) -> Column:
    """Row number at a place of the shuffle: undoes ``position_of``."""
    a, b = sides(n)
    return _walked(lambda x: _restored(x, a, b, seed), position.cast("long"), n, a * b - n)


def row_of_slot(shard: Column, slot: Column, n: int, shards: int, seed: int = SEED) -> Column:
    """Row number in a slot of a shard."""
    return row_at(slot * F.lit(shards) + shard, n, seed)


def numbered(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """``rows`` with ``row_no``: 0..n-1 in the order of ``order_by`` (nulls first), then of a hash of the whole row."""
    spark = rows.sparkSession
    files = min(MAX_FILES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = {"k": "_tie", "s": "_spread", "f": "_file"}
    while {c.lower() for c in rows.columns} & set(names.values()):
        names = {k: "_" + v for k, v in names.items()}
    tie, spread, file = names["k"], names["s"], names["f"]
    order = [F.col(f"`{c}`").asc_nulls_first() for c in order_by] + [F.col(tie), F.col(spread)]
    keyed = rows.withColumns({tie: F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), spread: F.monotonically_increasing_id()})
    held = stash(keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop(tie, spread), "numbered")
    meta = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(meta, pattern, 1).cast("long")  # of the task, then of the file of the task
    placed = held.select("*", meta.alias(file), F.col("_metadata.row_index").alias("row_no"))
    sizes = held.groupBy(meta.alias(file), number(r"part-(\d+)").alias("task"), number(r"-c(\d+)").alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(file).alias("of"), F.coalesce(before, F.lit(0)).alias("before"))
    return (placed.join(F.broadcast(offsets), F.col(f"`{file}`") == F.col("of"))
            .withColumn("row_no", F.col("row_no") + F.col("before")).drop(file, "of", "before"))


def shuffled(rows: DataFrame, order_by: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` with ``row_no``, ``position``, ``shard`` and ``slot`` of a shuffle that depends on the rows and the seed only."""
    if clash := {c.lower() for c in rows.columns} & {*NEW, "of", "before"}:
        raise ValueError(f"columns of the result are taken: {sorted(clash)}")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    done = numbered(rows, order_by)
    n = done.count()
    placed = done.withColumn("position", position_of(F.col("row_no"), n, seed) if n else F.lit(0).cast("long"))
    return placed.withColumns({"shard": (F.col("position") % F.lit(shards)).cast("int"),
                               "slot": F.call_function("div", F.col("position"), F.lit(shards))})


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; size is that of its text in UTF-8 and one more."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled(rows, ["doc_id", "size", "text_crc32"], shards, seed).drop("row_no", "position")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write the result of ``shuffled`` as a Parquet folder for each shard, files and rows by slot."""
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))

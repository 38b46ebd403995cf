"""Numbers of rows within keys when nothing bounds the rows of a key or of a place in the order."""

from pyspark.sql import functions as F

from brevilog.operators import compact as K
from brevilog.operators.blocks import number_by_range, number_by_size
from brevilog.plans import views as V


def test_one_place_holds_most_rows(spark):
    rows = spark.range(6000).select((F.col("id") % 3 == 0).cast("int").alias("k"),
                                    F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 11).alias("at"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = number_by_range(rows, ["k"], [F.col("at")], "no")
        # the hot place is spread over tasks, and no task holds most of it
        sizes = [r["count"] for r in got.where("k = 0 and at = 7").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)
        found = got.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.id for r in found) == list(range(6000))
    for k in (0, 1):
        mine = sorted((r.no, r["at"]) for r in found if r.k == k)
        assert [no for no, _ in mine] == list(range(1, len(mine) + 1))
        assert [at for _, at in mine] == sorted(at for _, at in mine)
    assert number_by_range(rows.limit(0), ["k"], [F.col("at")], "no").count() == 0


def test_lines_that_share_one_number(spark):
    """All lines of a run have the same number: none is lost, and they come out in the order of their text."""
    lines = spark.range(500).select(F.lit(1).alias("run_id"), F.lit(1).cast("bigint").alias("line_no"),
                                    F.format_string("some words of a line %04d", F.col("id")).alias("line"))
    done = K.compact_lines(lines, force="passthrough")
    got = [r.line for r in K.number_lines(done).orderBy("out_no").collect()]
    assert got == [f"some words of a line {i:04d}" for i in range(500)]


def test_only_large_keys_are_cut_into_pieces(spark):
    """The same numbers whether no, some or all keys are large; a null key keeps its rows."""
    key = F.when(F.col("id") < 900, 0).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 7 + 1)
    rows = spark.range(1000).select(key.alias("k"), (F.col("id") * 37 % 101).alias("at"), "id").withColumn("piece", F.floor(F.col("at") / 10))
    want: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r["at"], r.id)):
        want.setdefault(r.k, []).append(r.id)
    for most in (10_000, 100):
        got = number_by_size(rows, ["k"], ["piece"], [F.col("piece"), F.col("at"), F.col("id")], "no", most=most).collect()
        assert {(r.k, r.no): r.id for r in got} == {(k, i): x for k, ids in want.items() for i, x in enumerate(ids, 1)}
    assert number_by_size(rows.limit(0), ["k"], ["piece"], [F.col("at")], "no").count() == 0


def test_numbered_lines_are_made_once(spark):
    """What reads a view again neither joins nor sorts its rows again."""
    for view in (V.lines_log, V.lines_diff, V.lines_table, V.lines_tree):
        plan = view(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan

"""State of a stream as tables in folders, of which a batch writes no more than it touches.

Runs are dealt into buckets by a hash. Each bucket keeps its state in one of ``SLOTS`` folders in turn, and a small table
for each batch says which. A batch reads the buckets of the runs that it brings and writes them to their next
folder, so a batch that is run again reads the same and writes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 3
_VERSIONS = "batch bigint, bucket int, version bigint"


class BucketedState:
    def __init__(self, path: str, tables: dict[str, str], buckets: int = 64):
        """``tables``: name -> schema, each with a ``run_id``."""
        self.path, self.tables, self.buckets = path, tables, buckets

    def step(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        """An intermediate table of a batch, written and read again: later steps start from it, with short plans."""
        path = f"{self.path}/steps/{name}/slot={batch_id % SLOTS}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def bucket(self, run_id: Column) -> Column:
        return F.pmod(F.xxhash64(run_id), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the runs of a batch, at most ``buckets`` numbers."""
        return sorted(r[0] for r in batch.select(self.bucket(F.col("run_id"))).distinct().collect())

    def versions(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Version of each bucket after the last batch (before the given one)."""
        if before == 0:
            return {}
        rows = []
        for slot in range(SLOTS):
            try:
                rows += spark.read.schema(_VERSIONS).parquet(f"{self.path}/versions/slot={slot}").collect()
            except Exception as error:  # this slot has not been written yet
                if getattr(error, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                    raise
        past = [r for r in rows if before is None or r.batch < before]
        last = max((r.batch for r in past), default=None)
        return {r.bucket: r.version for r in past if r.batch == last and r.bucket is not None}

    def read(self, spark: SparkSession, table: str, versions: dict[int, int], touched: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/bucket={b}/slot={v % SLOTS}" for b, v in versions.items() if touched is None or b in touched]
        if not paths:
            # Known to be empty while a plan is made, so that joins with it are left out.
            row = F.from_json(F.lit(None).cast("string"), self.tables[table])
            return spark.range(1).limit(0).select(row.alias("r")).select("r.*")
        return spark.read.schema(self.tables[table]).parquet(*paths).filter("run_id IS NOT NULL")

    def write(self, batch_id: int, versions: dict[int, int], touched: list[int], tables: dict[str, DataFrame]) -> None:
        """Next version of the touched buckets: all of ``tables`` in them."""
        if not touched:
            return
        spark = next(iter(tables.values())).sparkSession
        after = {b: versions.get(b, 0) + 1 for b in touched}
        slot_of = F.element_at(F.create_map(*[F.lit(x) for b, v in after.items() for x in (b, int(v % SLOTS))]), F.col("bucket"))
        for name, rows in tables.items():
            # A row without a run in each bucket, so that an empty state also replaces what its folder held.
            marks = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in touched])).alias("bucket"))
            rows = rows.withColumn("bucket", self.bucket(F.col("run_id"))).unionByName(marks, allowMissingColumns=True)
            # Few tasks write to one bucket, as many as its size asks for: otherwise each task has a file in every bucket.
            (rows.hint("rebalance", "bucket").withColumn("slot", slot_of).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "slot").parquet(f"{self.path}/{name}"))
        versions = {**versions, **after}
        rows = [F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.lit(b).cast("int").alias("bucket"), F.lit(v).cast("bigint").alias("version"))
                for b, v in versions.items()]
        spark.range(1).select(F.inline(F.array(*rows))).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/versions/slot={batch_id % SLOTS}")

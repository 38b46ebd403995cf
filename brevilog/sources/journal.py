"""The journal of runs: Parquet, partitioned by UTC day and, within a day, by a hash of the run id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import argv_from_json
from ..schema import RUNS
from ..session import stash

DAY, PART = "day", "part"
# Folders of a day. An append of few runs reads the ids of few of them.
PARTS = 16
STORED = T.StructType([*RUNS.fields, T.StructField(DAY, T.DateType()), T.StructField(PART, T.IntegerType())])


def utc_instant(text: Column) -> Column:
    """RFC 3339 text as zone-less UTC, whatever the session time zone."""
    local = F.to_timestamp(text).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def from_text_rows(rows: DataFrame) -> DataFrame:
    """Journal rows from their text form: JSON argv, RFC 3339 instants, 0/1 flags."""
    at_least_0 = lambda c: F.greatest(F.col(c), F.lit(0).cast("bigint"))
    typed = rows.withColumns({
        "argv": argv_from_json(F.col("argv")),
        "started_at": utc_instant(F.col("started_at")),
        "finished_at": utc_instant(F.col("finished_at")),
        "is_tty": F.coalesce(F.col("is_tty"), F.lit(0)) != 0,
        **{c: at_least_0(c) for c in ("wall_ms", "raw_bytes", "tokens_in", "tokens_out")},
    })
    return typed if "archetype" in rows.columns else typed.withColumn(
        "archetype", F.lit(None).cast("string"))


def part_of(id_: Column) -> Column:
    """Folder of a run id."""
    return F.pmod(F.xxhash64(id_), F.lit(PARTS)).cast("int")


def append_runs(runs: DataFrame, path: str) -> None:
    """Append rows as they are; days and parts become folders, so date ranges and ids prune."""
    rows = runs.select(*RUNS.fieldNames()).withColumns({DAY: F.col("started_at").cast("date"), PART: part_of(F.col("id"))})
    rows.write.mode("append").partitionBy(DAY, PART).parquet(path)


def new_runs(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch whose id the journal does not hold, one per id."""
    return batch.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(STORED).parquet(path)
        return True
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def ids_like(spark: SparkSession, batch: DataFrame, path: str) -> DataFrame:
    """Ids of a stored journal, of all days, from the folders that ids of the batch would be in."""
    parts = [r[0] for r in batch.select(part_of(F.col("id"))).distinct().collect()]  # PARTS numbers at most
    return read_journal(spark, path).filter(F.col(PART).isin(parts)).select("id")


def append_new_runs(batch: DataFrame, path: str) -> None:
    """Insert or ignore, by id alone. A batch that is written again adds nothing. What the batch is made from is read once."""
    spark, batch = batch.sparkSession, stash(batch.dropDuplicates(["id"]), "new-runs")
    if not _is_there(spark, path):  # first write
        append_runs(batch, path)
        return
    append_runs(new_runs(batch, ids_like(spark, batch, path)), path)


def read_journal(spark: SparkSession, *paths: str) -> DataFrame:
    """One or more journals as one table, with the ``root`` each row came from."""
    tables = [spark.read.schema(STORED).parquet(path).withColumn("root", F.lit(path)) for path in paths]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def time_range(journal: DataFrame, since: str, until: str) -> DataFrame:
    """Runs started in ``[since, until)``; the day predicate prunes folders."""
    at, day = F.col("started_at"), F.col(DAY)
    first, last = F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")
    return journal.filter(
        (at >= first) & (at < last) & (day >= first.cast("date")) & (day <= last.cast("date")))

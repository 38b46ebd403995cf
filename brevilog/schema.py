"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

LINES = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("line_no", T.LongType(), False),
    T.StructField("line", T.StringType(), False),
])

CHUNKS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("chunk_no", T.LongType(), False),
    T.StructField("data", T.BinaryType(), False),
])

# started_at / finished_at hold UTC wall-clock time without a zone, so results do
# not move with the session time zone.
RUNS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("argv", T.ArrayType(T.StringType()), False),
    T.StructField("cwd", T.StringType(), False),
    T.StructField("started_at", T.TimestampNTZType(), False),
    T.StructField("finished_at", T.TimestampNTZType(), False),
    T.StructField("wall_ms", T.LongType(), False),
    T.StructField("exit_code", T.IntegerType(), False),
    T.StructField("raw_bytes", T.LongType(), False),
    T.StructField("tokens_in", T.LongType(), False),
    T.StructField("tokens_out", T.LongType(), False),
    T.StructField("savings_pct", T.DoubleType(), False),
    T.StructField("log_path", T.StringType(), False),
    T.StructField("intent", T.StringType(), True),
    T.StructField("is_tty", T.BooleanType(), False),
    T.StructField("archetype", T.StringType(), True),
])

# The same journal as text rows: JSON argv, RFC 3339 instants, 0/1 flags.
RUNS_TEXT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("argv", T.StringType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("finished_at", T.StringType()),
    T.StructField("wall_ms", T.LongType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("raw_bytes", T.LongType()),
    T.StructField("tokens_in", T.LongType()),
    T.StructField("tokens_out", T.LongType()),
    T.StructField("savings_pct", T.DoubleType()),
    T.StructField("log_path", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("is_tty", T.IntegerType()),
])

PRICES = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("price_in", T.DoubleType(), False),
    T.StructField("price_out", T.DoubleType(), False),
])

# Price per thousand tokens by model, and the fallback pair.
PRICE_ROWS = [
    ("claude-sonnet-4", 3.0, 15.0),
    ("claude-opus-4", 15.0, 75.0),
    ("gpt-4o", 2.5, 10.0),
    ("gpt-4.1", 2.0, 8.0),
    ("gpt-4.1-mini", 0.4, 1.6),
    ("gpt-4.1-nano", 0.1, 0.4),
]
CUSTOM_PRICE = (3.0, 15.0)

"""Token accounting: byte heuristic and savings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def tokens_from_bytes(n_bytes: Column) -> Column:
    """Approximate tokens: a quarter of the bytes, rounded up."""
    return F.floor((n_bytes + 3) / 4).cast("bigint")


def approx_tokens(text: Column) -> Column:
    return tokens_from_bytes(F.octet_length(text).cast("bigint"))


def tokens_saved(tokens_in: Column, tokens_out: Column) -> Column:
    return F.greatest(tokens_in - tokens_out, F.lit(0).cast("bigint"))


def savings_pct(tokens_in: Column, tokens_out: Column) -> Column:
    """Share of tokens saved in percent; 0 for an empty input, never negative."""
    return F.when(tokens_in == 0, F.lit(0.0)).otherwise(
        tokens_saved(tokens_in, tokens_out).cast("double") / tokens_in.cast("double") * 100.0
    )

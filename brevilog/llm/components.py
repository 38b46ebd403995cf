"""Connected components of a graph of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id that can be reached, for each id in edges (a, b).

    Every step takes the smallest label among the neighbours and then follows labels one jump
    (the label of the label), so the number of steps grows with the logarithm of the longest path.
    Each step is written to the shared folder. Edges with a null end are left out. Hot ids are
    pre-aggregated by partial minima; joins may be split where skewed.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = stash(both.select("a", "b").union(both.select("b", "a")).distinct(), "edges")
    now = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = (both.join(now, both["b"] == now["id"]).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near")))
        step = now.join(near, "id").select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        up = now.select(F.col("id").alias("next"), F.col("comp").alias("jump"))
        new = stash(step.join(up, "next", "left").select("id", F.least("next", F.coalesce("jump", "next")).alias("comp"), "was"),
                    "labels")
        now = new.select("id", "comp")
        if new.where("comp <> was").isEmpty():
            return now

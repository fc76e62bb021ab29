"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import drop_kept, join_hot, keep


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame, **size) -> DataFrame:
    both = _both_ways(e)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_hot(both.where("v > u"), low, "u", "n", **size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame, **size) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_hot(down, low, "u", "n", **size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, small_total: int = 100_000) -> DataFrame:
    """Edges (u, v) of comparable ids -> (id, root), root the smallest id of the component.

    Only ids with an edge have a row. Each round is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    now = keep(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark, total = None, now.count()
    while True:
        size = {"total": 2 * total, "small_total": small_total}
        large = _large_star(now, **size)
        large = large if size["total"] <= small_total else keep(large, "large")
        nxt = keep(_small_star(large, **size), "edges")
        drop_kept(now, large)
        now = nxt
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, total = seen, seen[0]
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())

"""Connected components by alternating large and small stars, without any driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnwork.storage import dropped, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of each node (larger ones, or smaller ones and itself) to the smallest."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that has an edge and isn't its component's smallest, with the smallest."""
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        then = stored(_stars(_stars(now, large=True), large=False), "edges")
        dropped(now)
        now, last = then, seen
        seen = mark(now)
        if seen == last or not seen[0]:
            return now

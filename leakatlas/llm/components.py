"""Connected components by alternating large and small stars, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakatlas.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node of ``edges`` (u, v) that is not the smallest of its component.

    Each round writes its edges to the shared folder; only their number and a
    checksum come to the driver.
    """

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = checksum(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        following = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = stored(following, "edges")
        before, state = state, checksum(now)
        if state == before:
            break
    return now.select("u", F.col("v").alias("root"))

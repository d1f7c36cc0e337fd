"""Order-dependent helpers that stay distributed when one group is very large."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Spark filters `row_number() <= n` before the shuffle up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1_000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key; each map task sends at most one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt_col: str, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of every key under a total order.

    Small ``n`` is cut before the shuffle by Spark itself. Larger ``n`` is cut
    in two steps: first within ``salts`` slices of each key, then over what is
    left, so the task of a hot key sorts at most ``salts * n`` rows. The
    explicit exchange matters: rows that already lie together by key would
    otherwise satisfy the first window, and no slice would move.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if n > MAP_SIDE_LIMIT:
        salt = F.pmod(F.xxhash64(salt_col), F.lit(salts))
        ws = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .repartition(*keys, "_salt")
            .withColumn("_rn", F.row_number().over(ws))
            .filter(F.col("_rn") <= n)
            .drop("_salt", "_rn")
        )
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, str], block: int = 4_096
) -> DataFrame:
    """Inclusive running sums along an integer column.

    Blocks of ``block`` consecutive order values are summed first; only those
    block sums are ordered as one group, the rows themselves within their
    block.
    """
    df = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = df.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_{k}") for k, v in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in totals],
    )
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, [*keys, "_block"])
    return joined.withColumns(
        {k: F.col(f"_{k}") + F.sum(v).over(within) for k, v in totals.items()}
    ).drop("_block", *[f"_{k}" for k in totals])

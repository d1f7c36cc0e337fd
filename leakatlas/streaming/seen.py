"""Keys that a stream has seen, by event day, for as long as they matter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DAY = "_day"


@dataclass(frozen=True)
class SeenKeys:
    """The keys of a stream below ``folder``, one folder a batch, partitioned by event day.

    Most batches add their own keys only. Every ``every``-th batch writes all
    keys that still matter instead, so a batch reads the last such folder and
    fewer than ``every`` others, however many there were before, and of these
    only the days from ``limit`` on. Each batch overwrites its own folder and
    reads earlier ones only, so it may be repeated after a failure. Keys
    without a time matter for ever. ``schema`` holds the keys and ``ts_col``.
    """

    folder: str
    schema: T.StructType
    ts_col: str
    every: int = 16

    @property
    def keys(self) -> list[str]:
        return [c for c in self.schema.names if c != self.ts_col]

    def read(self, spark: SparkSession, number: int, limit: Column) -> DataFrame:
        """The keys with event times from ``limit`` on that the batches before ``number`` have seen."""
        if number == 0:
            return spark.createDataFrame([], self.schema)
        first = (number - 1) // self.every * self.every
        paths = [f"{self.folder}/batch={b}" for b in range(first, number)]
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField(DAY, T.DateType())])
        rows = spark.read.schema(schema).option("basePath", self.folder).parquet(*paths)
        # A day more, as sessions may divide days by other time zones.
        in_days = F.col(DAY).isNull() | limit.isNull() | (F.col(DAY) >= F.date_sub(F.to_date(limit), 1))
        return rows.filter(in_days).filter(F.coalesce(F.col(self.ts_col) >= limit, F.lit(True))).select(*self.schema.names)

    def write(self, number: int, fresh: DataFrame, limit: Column) -> None:
        """Add the keys of a batch; ``fresh`` holds none that :meth:`read` gives."""
        rows = fresh.select(*self.schema.names)
        if number % self.every == 0:
            rows = rows.unionByName(self.read(fresh.sparkSession, number, limit))
        rows = rows.withColumn(DAY, F.to_date(self.ts_col)).hint("rebalance", DAY)
        rows.write.mode("overwrite").partitionBy(DAY).parquet(f"{self.folder}/batch={number}")

    def unseen(self, rows: DataFrame, number: int, limit: Column, within: str | None = None) -> DataFrame:
        """``rows`` whose keys no earlier batch has seen; nulls count as equal.

        With ``within``, keys seen longer ago than that, by the time of the row, do not count.
        """
        if number == 0:
            return rows
        seen = self.read(rows.sparkSession, number, limit)
        same = alike(rows, seen, self.keys)
        if within is not None:
            recent = seen[self.ts_col] >= rows[self.ts_col] - F.expr(f"INTERVAL {within}")
            same = same & F.coalesce(recent, F.lit(True))
        return rows.join(seen, same, "left_anti")


def alike(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition

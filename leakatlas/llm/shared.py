"""Folders that all executors share, intermediate tables, bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES from here on, unless the session has a bound of its own.

    Spark counts rows only by default: 10,000 texts are a batch, held by the JVM outside its heap and by the worker.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session in which that setting is absent (as in tests) gets a
    temporary folder; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="run-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, its lineage cut."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: Column, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` rows of ``df`` at most, chosen by a hash of ``key``; all rows if there are fewer.

    The bound holds in expectation (the hash is uniform); every run picks the
    same rows.
    """
    total = df.count()
    if total <= bound:
        return df
    cut = int((1 << 30) * bound / total)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < cut)


def broadcast_if_small(df: DataFrame, name: str, max_rows: int = 50_000) -> DataFrame:
    """A lookup table of narrow rows, stored and counted: broadcast up to ``max_rows``, else joined by shuffle."""
    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() <= max_rows else kept

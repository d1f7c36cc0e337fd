"""Sharding by extendible hashing, with DataFrame functions only.

A bucket is a prefix of the 64-bit hash of a row's key. Only buckets over the
byte limit are split on another bit, until each fits or holds a single unit.
The directory (prefix, depth, bytes) is a small table: one pass sums bytes by
the first bits, the splits happen on these sums, and only rows of buckets that
are still too large at that depth are looked at again, with all their bits.

Units are rows; equal (key, size) rows are counted first, so a key that repeats
millions of times is a few rows until the end, and its copies, numbered by
chunks of at most a sixteenth of the limit, hash apart. A row over the limit
makes a shard of its own, marked ``oversized``. A null key is a key, a null
text has no bytes. An empty table gives no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakatlas.llm.shared import stored

BITS = 63
MOST_COPIES = 4096
CELLS_PER_SHARD = 32


def _prefix(column: str, depth: Column | int) -> Column:
    return F.expr(f"shiftright({column}, {BITS} - {depth})") if isinstance(depth, (int, str)) else F.call_function("shiftright", F.col(column), (F.lit(BITS) - depth).cast("int"))


def _buckets(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Splits of all rows (h, bytes, units): each h with the least depth from ``low`` to ``high`` at which its bucket fits, or null."""
    deep = rows.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", _prefix("h", F.col("depth")))
    fits = (
        deep.groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("bucket_bytes"), F.sum("units").alias("bucket_units"))
        .filter((F.col("bucket_bytes") <= limit) | (F.col("bucket_units") == 1))
    )
    least = deep.join(fits, ["depth", "prefix"]).groupBy("h").agg(F.min(F.struct("depth", "prefix", "bucket_bytes", "bucket_units")).alias("b"))
    return least.select("h", "b.*")


def _in_chunk(limit: int) -> Column:
    """How many copies of a row of ``n_bytes`` make one unit."""
    return F.least(F.lit(MOST_COPIES), F.greatest(F.lit(1), F.floor(F.lit(limit / 16) / F.greatest("n_bytes", F.lit(1))))).cast("long")


def placements(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """The units of ``df`` and their shards: k, n_bytes, chunk, rows, shard, depth, shard_bytes, oversized."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    sized = df.select(F.col(key).alias("k"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("n_bytes")).groupBy("k", "n_bytes").agg(F.count("*").alias("copies"))
    units = (
        sized.withColumn("in_chunk", _in_chunk(limit))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.col("in_chunk")))))
        .withColumn("rows", F.least("in_chunk", F.col("copies") - F.col("chunk") * F.col("in_chunk")))
        .withColumn("bytes", F.col("rows") * F.col("n_bytes"))
        .withColumn("h", F.expr("shiftrightunsigned(xxhash64(k, n_bytes, chunk), 1)"))
        .select("k", "n_bytes", "chunk", "rows", "bytes", "h")
    )
    units = stored(units, "shard-units")
    total = units.agg(F.sum("bytes")).first()[0] or 0
    first = min(BITS, max(1, math.ceil(math.log2(max(2.0, CELLS_PER_SHARD * total / limit)))))

    cells = units.groupBy(F.expr(f"shiftright(h, {BITS - first})").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("units"))
    cells = stored(cells.withColumn("h", F.expr(f"shiftleft(cell, {BITS - first})")).select("h", "bytes", "units"), "shard-cells")
    coarse = _buckets(cells, 0, first, limit)
    directory = stored(
        cells.select("h").join(coarse, "h", "left").select(F.expr(f"shiftright(h, {BITS - first})").alias("cell"), "depth", "prefix", "bucket_bytes"),
        "shard-directory",
    )
    found = units.withColumn("cell", F.expr(f"shiftright(h, {BITS - first})")).join(directory, "cell")
    placed = found.filter("depth is not null")
    # Cells still over the limit: their rows alone are split further. At the last bit, equal hashes stay together.
    open_units = found.filter("depth is null").select("k", "n_bytes", "chunk", "rows", "bytes", "h")
    if first < BITS and not directory.filter("depth is null").isEmpty():
        by_hash = open_units.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("units"))
        fine = _buckets(by_hash, first + 1, BITS, limit)
        deeper = open_units.join(fine, "h", "left").select(
            "k", "n_bytes", "chunk", "rows", F.coalesce("depth", F.lit(BITS)).alias("depth"), F.coalesce("prefix", "h").alias("prefix"), F.coalesce("bucket_bytes", "bytes").alias("bucket_bytes")
        )
        placed = placed.select("k", "n_bytes", "chunk", "rows", "depth", "prefix", "bucket_bytes").unionByName(deeper)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0")))
    return placed.select("k", "n_bytes", "chunk", "rows", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("bucket_bytes").alias("shard_bytes"), (F.col("bucket_bytes") > limit).alias("oversized"))


def shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, shard, depth, shard_bytes, oversized.

    ``shard`` is the hash prefix as a string of bits ("" if one shard holds all).
    """
    placed = placements(df, key, size, limit)
    each = placed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(F.col("k").alias(key), "n_bytes", "shard", "depth", "shard_bytes", "oversized")


def write_shards(df: DataFrame, key: str, size: Column, limit: int, path: str, salts: int = 64) -> None:
    """Write ``df``'s rows as Parquet, partitioned by their ``shard``.

    The copies of a (key, size) are numbered within random slices, whose
    offsets are added, so that a hot key is spread over many tasks.
    """
    rows = stored(
        df.withColumn("__k", F.col(key)).withColumn("n_bytes", F.coalesce(size.cast("long"), F.lit(0).cast("long"))).withColumn("__salt", F.floor(F.rand(7) * salts).cast("int")), "shard-rows"
    ).withColumnRenamed("n_bytes", "__n")
    slices = rows.groupBy("__k", "__n", "__salt").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__k", "__n").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = slices.select(F.col("__k").alias("__ok"), F.col("__n").alias("__on"), F.col("__salt").alias("__os"), before.alias("__before"))
    number = F.row_number().over(Window.partitionBy("__k", "__n", "__salt").orderBy(F.lit(1)))
    numbered = rows.withColumn("__i", number).join(offsets, F.col("__k").eqNullSafe(F.col("__ok")) & (F.col("__n") == F.col("__on")) & (F.col("__salt") == F.col("__os")))
    numbered = numbered.withColumn("n_bytes", F.col("__n")).withColumn("__chunk", F.floor((F.col("__before") + F.col("__i") - 1) / _in_chunk(limit))).drop("n_bytes")
    placed = placements(df, key, size, limit).select(F.col("k").alias("__pk"), F.col("n_bytes").alias("__pn"), F.col("chunk").alias("__pc"), "shard")
    joined = numbered.join(placed, F.col("__k").eqNullSafe(F.col("__pk")) & (F.col("__n") == F.col("__pn")) & (F.col("__chunk") == F.col("__pc")))
    joined.select(*df.columns, "shard").repartition("shard").write.partitionBy("shard").parquet(path)

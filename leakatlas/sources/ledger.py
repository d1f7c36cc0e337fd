"""What earlier runs have scanned: a ledger of (repository, content, rules), kept over runs.

A ledger is a folder. Each run first writes its keys as a part of their own,
divided by hash prefix, and then the next version: one small file that names
the parts which make up the ledger. The newest version counts. A run that
dies before its version is written leaves a part that no version names, so the
old state stays valid; running it again writes another part. Versions are
single files put in place by one rename, and a version that exists is never
overwritten: of two runs that finish at once one fails and can record again.

Keys are compared after a Bloom filter. Files the filter has not seen are new
and are joined with nothing; of the others only the keys are checked against
the ledger. Texts are never shuffled.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..rules import Rule, rules_version

KEYS = ("repo_url", "sha")
VERSION = "version long, run_id string, parts array<string>, rows long"
ENTRY = "repo_url string, sha string, rules string, run_id string, prefix int"
SLICES = 4096  # of the Bloom filter, told apart by the hash
BLOOM_BYTES = 256 << 20  # a larger filter is not broadcast, nor built
FEW_KEYS = 200_000  # keys of two strings each that may be broadcast


class Ledger:
    """The ledger below ``folder``.

    ``false_positives`` is the share of new files that the filter holds back for a
    look; ``prefixes`` is the number of files of a part, by hash prefix.
    """

    def __init__(self, spark: SparkSession, folder: str, false_positives: float = 0.01, prefixes: int = 8):
        if not 0 < false_positives < 1:
            raise ValueError("false_positives must lie between 0 and 1")
        self.spark, self.folder, self.false_positives, self.prefixes = spark, folder, false_positives, prefixes

    # --- versions ---

    def versions(self) -> DataFrame:
        """All versions: number, run that made it, parts, rows."""
        try:
            lines = self.spark.read.text(f"{self.folder}/versions/*/*.txt")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], VERSION)
        return lines.select(F.from_json("value", VERSION).alias("v")).select("v.*")

    def current(self) -> tuple[int, list[str]]:
        """Number and parts of the newest version; 0 and none of a new ledger."""
        newest = self.versions().orderBy(F.col("version").desc()).first()
        return (newest.version, list(newest.parts)) if newest else (0, [])

    def _publish(self, version: int, run_id: str, parts: Sequence[str], rows: int) -> None:
        line = json.dumps({"version": version, "run_id": run_id, "parts": list(parts), "rows": rows})
        one = self.spark.createDataFrame([(line,)], "value string").coalesce(1)
        one.write.mode("errorifexists").text(f"{self.folder}/versions/{version:012d}")

    # --- parts ---

    def seen(self, parts: Sequence[str] | None = None) -> DataFrame:
        """The entries of the current version: repo_url, sha, rules, run_id, prefix."""
        parts = self.current()[1] if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("basePath", f"{self.folder}/parts").parquet(*[f"{self.folder}/parts/{p}" for p in parts]).select(*[f.split()[0] for f in ENTRY.split(", ")])

    def _write_part(self, entries: DataFrame) -> str:
        part = f"part={uuid.uuid4().hex}"
        prefix = F.pmod(F.xxhash64(*KEYS), F.lit(self.prefixes)).cast("int")
        entries.withColumn("prefix", prefix).repartition(self.prefixes, "prefix").write.partitionBy("prefix").parquet(f"{self.folder}/parts/{part}")
        return part

    def record(self, files: DataFrame, run_id: str, rules: Sequence[Rule] | None = None) -> int:
        """Note that ``files`` have been scanned with ``rules``; returns the new version. Files without a key are not noted."""
        version, parts = self.current()
        name = rules_version(rules)
        held = self.seen(parts).filter(F.col("rules") == name).select(*KEYS)
        keys = files.select(*KEYS).dropna().distinct()
        new = keys.join(held, list(KEYS), "left_anti")
        part = self._write_part(new.select(*KEYS, F.lit(name).alias("rules"), F.lit(run_id).alias("run_id")))
        rows = self.seen([*parts, part]).count()
        self._publish(version + 1, run_id, [*parts, part], rows)
        return version + 1

    def compact(self, run_id: str = "compaction") -> int:
        """Write the current entries as one part, each key once with the run that saw it first by name."""
        version, parts = self.current()
        once = self.seen(parts).groupBy(*KEYS, "rules").agg(F.min("run_id").alias("run_id"))
        part = self._write_part(once)
        self._publish(version + 1, run_id, [part], self.seen([part]).count())
        return version + 1

    # --- what is new ---

    def unseen(self, files: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
        """``files`` whose content was not yet scanned in their repository with these rules. Files without a key are new."""
        held = self.seen().filter(F.col("rules") == rules_version(rules)).select(*KEYS)
        total = held.count()
        if not total:
            return files
        bloom = self._bloom(held, total)
        if bloom is None:
            return files.join(held, list(KEYS), "left_anti")
        flagged = self._maybe(files, bloom)
        # Of the new files about a false_positives-th are flagged: their keys are few.
        keys = self._maybe(files.select(*KEYS).dropna().distinct(), bloom).filter("_maybe").select(*KEYS)
        spared = keys.join(held, list(KEYS), "left_anti").withColumn("_new", F.lit(True)).persist()
        few = F.broadcast(spared) if spared.count() <= FEW_KEYS else spared
        return flagged.join(few, list(KEYS), "left").filter(~F.col("_maybe") | F.col("_new")).select(*files.columns)

    def _bits(self, rows: int) -> tuple[int, int]:
        """Bits of a slice and hashes of a key, for the share of false positives at this number of rows."""
        per_slice = max(1.0, 1.1 * rows / SLICES + 4 * math.sqrt(rows / SLICES))  # some slices hold more than others
        bits = math.ceil(-per_slice * math.log(self.false_positives) / math.log(2) ** 2 / 64) * 64
        return bits, max(1, round(bits / per_slice * math.log(2)))

    def _places(self, bits: int, hashes: int) -> list[Column]:
        """The places of a key in its slice."""
        return [F.pmod(F.xxhash64(F.lit(i + 1), *KEYS), F.lit(bits)).cast("int") for i in range(hashes)]

    def _bloom(self, held: DataFrame, total: int) -> tuple[DataFrame, int, int] | None:
        """(slice, words), bits and hashes: a Bloom filter in SLICES rows, built by OR over partial words; None beyond BLOOM_BYTES."""
        bits, hashes = self._bits(total)
        if SLICES * bits // 8 > BLOOM_BYTES:
            return None
        place = F.explode(F.array(*self._places(bits, hashes)))
        words = (
            held.select(_slice().alias("slice"), place.alias("p"))
            .groupBy("slice", F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63))).alias("bits"))
            .groupBy("slice")
            .agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
        )
        filled = F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
        return words.select(F.col("slice").alias("_slice"), filled.alias("words")).persist(), bits, hashes

    def _maybe(self, files: DataFrame, bloom: tuple[DataFrame, int, int]) -> DataFrame:
        """``files`` plus ``_maybe``: false where the filter has surely not seen the key."""
        slices, bits, hashes = bloom
        held = [
            F.call_function("shiftright", F.get("words", F.shiftright(p, 6)), p.bitwiseAND(63)).bitwiseAND(1) == 1
            for p in self._places(bits, hashes)
        ]
        every = held[0]
        for h in held[1:]:
            every = every & h
        known = F.col("words").isNotNull() & F.col("repo_url").isNotNull() & F.col("sha").isNotNull() & every
        joined = files.withColumn("_slice", _slice()).join(F.broadcast(slices), "_slice", "left")
        return joined.select(*files.columns, F.coalesce(known, F.lit(False)).alias("_maybe"))


def _slice() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(SLICES)).cast("int")

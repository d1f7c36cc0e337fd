"""Each text scanned once, however many files hold it, without moving texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import Rule
from .scan import DEFAULT_KEYS, scan_secrets

FEW_TEXTS = 200_000  # repeated texts that are told to every task: a hash and the keys of one file each


def repeated_texts(files: DataFrame, sha: Column, key_cols: Sequence[str], max_texts: int = FEW_TEXTS) -> DataFrame:
    """``_sha, _holder``: texts that more than one file holds, each with the least keys of these files.

    Of more than ``max_texts`` those with the most files. Counts are partial on
    the map side, so a text that a third of all files hold costs a row a task.
    """
    counted = files.select(sha.alias("_sha"), F.struct(*key_cols).alias("_key")).filter("_sha IS NOT NULL")
    texts = counted.groupBy("_sha").agg(F.count("*").alias("_n"), F.min("_key").alias("_holder")).filter("_n > 1")
    return texts.orderBy(F.col("_n").desc(), "_sha").limit(max_texts).select("_sha", "_holder")


def scan_secrets_distinct(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    *,
    sha_col: str | None = None,
    key_cols: Sequence[str] = DEFAULT_KEYS,
    text_col: str = "text",
    max_texts: int = FEW_TEXTS,
    **options,
) -> DataFrame:
    """The findings of :func:`scan_secrets`, every repeated text scanned for one file only.

    ``sha_col`` names a hash of the text; without it SHA-256 is computed. One
    file of each repeated text is its holder; the other files skip the scan and
    take over the holder's findings by hash. Exchanges carry keys, hashes and
    findings only. Texts beyond ``max_texts`` are scanned wherever they are,
    with equal findings; so are files without a hash. Repeated rows give
    repeated findings, as in the plain scan.
    """
    sha = F.col(sha_col) if sha_col else F.sha2(F.col(text_col).cast("string"), 256)
    texts = F.broadcast(repeated_texts(files, sha, key_cols, max_texts))
    keyed = files.select(*key_cols, F.col(text_col).alias("_text"), sha.alias("_own")).join(texts, F.col("_own") == F.col("_sha"), "left")
    is_holder = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_holder.{k}")) for k in key_cols))
    scanned = keyed.filter(F.col("_sha").isNull() | is_holder)
    found = scan_secrets(scanned, rules, key_cols=[*key_cols, "_sha"], text_col="_text", **options)
    own = [c for c in found.columns if c not in (*key_cols, "_sha")]
    shared = found.filter("_sha IS NOT NULL").dropDuplicates(["_sha", "hit_no"]).select("_sha", *own)
    members = files.select(*key_cols, sha.alias("_own")).filter("_own IS NOT NULL")
    taken = members.join(shared, F.col("_own") == F.col("_sha")).select(*key_cols, *own)
    return found.filter("_sha IS NULL").select(*key_cols, *own).unionByName(taken)

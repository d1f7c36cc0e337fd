"""From raw documents to token ids, in five stages.

Each stage reads what the one before it has written to the shared folder, so a
lost executor costs tasks, not stages. Rows keep the columns of ``documents``
until the last stage, which returns token ids in place of texts. Each stage
bounds the bytes of the Arrow batches that its tasks hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leakatlas.llm import bpe, decontaminate, minmax_dedup, quality, suffix_dedup
from leakatlas.llm.registry import query, table
from leakatlas.llm.shared import bounded_batches, broadcast_if_small, stored

DROPPED_BROADCAST_ROWS = 200_000
PASSAGE_BYTES = 200  # 51 words of the shortest kind, prose of two-letter words with their blanks, fill about 150 to 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs keep."""
    bounded_batches(spark)
    counts = stored(quality.with_counts(docs.select("doc_id", "lang", "text"), keep_text=False), "stage-counts")
    cutoffs = quality.risk_cutoffs(counts, table(spark, sf_dir, "labels"))
    judged = quality.judge(quality.with_counts(docs), cutoffs)
    return judged.filter("kept").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate component.

    Rows alike in id and text are one document; rows with equal ids and other
    texts stay or go together.
    """
    bounded_batches(spark)
    found = stored(minmax_dedup.near_duplicates(docs), "stage-components")
    rows = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    dropped = broadcast_if_small(rows.filter("not kept").select("doc_id"), "stage-copies", DROPPED_BROADCAST_ROWS)
    left = docs.join(dropped, "doc_id", "left_anti")
    repeated = stored(rows.filter("kept and n > 1").select(F.col("doc_id").alias("__id")), "stage-repeated")
    if repeated.isEmpty():
        return left
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, same, "left_anti").unionByName(once)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` plus a name for each id and text."""
    parts = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string")
    return docs.withColumn("__name", F.concat_ws(":", *parts))


def _leaked(spark: SparkSession, named: DataFrame, sf_dir: str) -> DataFrame:
    """The names of documents with a passage of the benchmark."""
    found = decontaminate.matches(named.select("__name", "text"), table(spark, sf_dir, "benchmark"), key="__name")
    return broadcast_if_small(found.select("__name").distinct(), "stage-leaks", DROPPED_BROADCAST_ROWS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of PASSAGE_BYTES and more that occur elsewhere.

    Repeats are judged over all documents and cut from all. The next stage drops
    documents with a passage of the benchmark whole, but cannot see one that was
    cut: a document that held such passages and has none left is dropped here.
    """
    bounded_batches(spark)
    named = _named(docs)
    cut = suffix_dedup.cut_repeats(named, length=PASSAGE_BYTES)
    leaked = _leaked(spark, named, sf_dir)
    suspects = stored(cut.filter("n_removed > 0").join(leaked, "__name", "left_semi").select("__name", "text"), "stage-suspects")
    hidden = suspects.join(_leaked(spark, suspects, sf_dir), "__name", "left_anti").select("__name").distinct()
    cut = cut.join(broadcast_if_small(hidden, "stage-hidden", DROPPED_BROADCAST_ROWS), "__name", "left_anti")
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bounded_batches(spark)
    named = _named(docs)
    return named.join(_leaked(spark, named, sf_dir), "__name", "left_anti").select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of the decoded text."""
    bounded_batches(spark)
    encoded = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    return encoded.drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Quality rules with risk-controlled thresholds.

Each text gets counts over its whole length. A base rule rejects by fixed
limits. Beyond it, a text is rejected if a signal exceeds the cutoff of its
stratum (say, its language). A cutoff of a fixed grid is valid if, on the
labelled holdout, the exact binomial test refutes "more than ``risk`` of the
good texts are rejected" at level ``error`` over the number of all tests
(Bonferroni over strata, signals and cutoffs); the risk of a stratum is shared
between its signals. The lowest valid cutoff counts. A stratum with too few
labels has no valid cutoff and rejects nothing beyond the base rule.

Null texts have no words. A null stratum is a stratum of its own. Repeated
labels of a document count once, as good if any says so; labels that are null
or without a document are left out. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from leakatlas.llm.shared import broadcast_if_small, stored
from leakatlas.llm.text import FIELD, Fingerprints, byte_values, chunks, mix, per_text, spaces, utf8, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
GRID = {
    "symbols_per_word": (0.1, 0.2, 0.35, 0.5, 0.75, 1.0),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "repeat_word_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
}
RISK = 0.03
ERROR = 0.05


def count_texts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of every text of a flat chunk."""
    n = len(at) - 1
    start, end, doc = words(data, at)
    finger = Fingerprints(data, byte_values(3, fold_case=False))

    def summed(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    solid = ~spaces(data)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True

    # Lines: cut at line feeds and between texts; those without a word don't count.
    feeds = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([at[:-1], feeds + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    next_feed = np.concatenate([feeds, [len(data)]])[np.searchsorted(feeds, line_start, "left")]
    line_end = np.minimum(next_feed, at[line_doc + 1])
    held = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    with_word = held[line_end] > held[line_start]
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    with np.errstate(over="ignore"):
        salt = mix(np.arange(n, dtype=FIELD) + FIELD(1))
        _, first = np.unique(mix(finger.span(line_start, line_end) + salt[line_doc]), return_index=True)
        n_lines = per_text(line_doc, n)
        dup_lines = n_lines - per_text(line_doc[first], n)

        repeats = np.zeros(n, np.int64)
        if len(start) > 2:
            h = finger.span(start, end)
            whole = doc[:-2] == doc[2:]
            three = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])[whole]
            _, which, times = np.unique(mix(three + salt[doc[:-2][whole]]), return_inverse=True, return_counts=True)
            again = np.flatnonzero(whole)[times[which] >= 2]
            covered = np.zeros(len(start), bool)
            for step in range(3):
                covered[again + step] = True
            repeats = per_text(doc[covered], n)
    chars = summed(solid & ((data & 0xC0) != 0x80))
    return [per_text(doc, n), chars, summed(is_symbol[data]), dup_lines, repeats, n_lines]


def with_counts(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` plus the COUNTS as long columns (columns of these names are replaced)."""
    kept = [c for c in df.columns if c not in COUNTS and (keep_text or c != text)]
    # A kept string is counted where it lies; only other texts need a column beside the kept ones.
    own = text not in kept or df.schema[text].dataType != StringType()
    read = "__text" if own else f"k{kept.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, read):
                made = [pa.array(c, pa.int64()) for c in count_texts(*utf8(batch.column(read)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(kept))), *made], names=[*(f"k{i}" for i in range(len(kept))), *COUNTS])

    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(f"`{text}`").cast("string").alias("__text")] * own)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), *(f"{c} long" for c in COUNTS)])
    return source.mapInArrow(run, schema).toDF(*kept, *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def signal(name: str) -> Column:
    part, whole = {
        "symbols_per_word": ("n_symbols", "n_words"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_word_share": ("n_repeat_words", "n_words"),
    }[name]
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial distribution, by exact summing in logarithms."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def risk_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", good: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The cutoff of each (stratum, signal) with a valid one: stratum, signal, cutoff, n_good, n_rejected."""
    truth = labels.filter(F.col(key).isNotNull() & F.col(good).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(good).alias("__good"))
    pairs = [(s, c) for s in GRID for c in GRID[s]]
    tallies = (
        counts.filter(~base_failed())
        .select(F.col(key).alias("__key"), F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"), *[signal(s).alias(s) for s in GRID])
        .join(truth.filter("__good = 1"), "__key")
        .groupBy("stratum")
        .agg(F.count("*").alias("n_good"), *[F.sum((F.col(s) > c).cast("long")).alias(f"c{i}") for i, (s, c) in enumerate(pairs)])
        .select("stratum", "n_good", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(float(c)).alias("cutoff"), F.col(f"c{i}").alias("n_rejected")) for i, (s, c) in enumerate(pairs)])).alias("t"))
        .select("stratum", "n_good", "t.*")
    )
    level, share = error, risk / len(GRID)

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["p_value"] = [binomial_tail(int(k), int(n), share) if k < share * n else 1.0 for k, n in zip(f.n_rejected, f.n_good, strict=True)]
            yield f

    tested = stored(tallies.mapInPandas(test, "stratum string, n_good long, signal string, cutoff double, n_rejected long, p_value double"), "quality-tests")
    tests = max(1, tested.count())
    return (
        tested.filter(F.col("p_value") <= level / tests)
        .groupBy("stratum", "signal")
        .agg(F.min(F.struct("cutoff", "n_good", "n_rejected")).alias("t"))
        .select("stratum", "signal", "t.*")
    )


def judge(counts: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``counts`` plus base_failed, rejected_by (signals beyond their cutoff) and kept."""
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"__{s}") for s in GRID]).withColumnRenamed("stratum", "__stratum")
    beyond = F.array_compact(F.array(*[F.when(signal(s) > F.col(f"__{s}"), F.lit(s)) for s in GRID]))
    return (
        counts.withColumn("__of", F.coalesce(F.col(stratum).cast("string"), F.lit("\0")))
        .join(broadcast_if_small(wide, "quality-cutoffs"), F.col("__of") == F.col("__stratum"), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", beyond)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("__of", "__stratum", *[f"__{s}" for s in GRID])
    )

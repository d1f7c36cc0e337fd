"""Distinct counts that merge over days and runs without the rows: sketches as columns.

A run reduces its findings to one row per group with a sketch of the
repositories and one of the values. Such rows are small (about
``2 ** lg`` bytes of HLL registers, ``8 * 2 ** lg`` bytes of theta hashes at
most), can be kept for ever, and rows of any days, types and runs merge to
what one pass over all their findings would have given. Sums are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LG = 12
REPOS, VALUES = "repos_sketch", "values_sketch"


def error_bound(lg: int = LG, deviations: float = 4) -> float:
    """The relative error that a count stays within, but for about 1 in 16,000 groups at 4 deviations.

    HLL deviates by 1.04 / sqrt(2 ** lg), theta by 1 / sqrt(2 ** lg); the larger one is taken.
    """
    return deviations * 1.04 / 2 ** (lg / 2)


def usage_sketches(findings: DataFrame, by: Sequence[str] = ("secret_type",), lg: int = LG) -> DataFrame:
    """Per group: findings, an HLL sketch of repositories and a theta sketch of values.

    Sketches are partial on the map side, so a type with most of the findings costs one row a task.
    """
    return findings.groupBy(*by).agg(
        F.count("*").alias("n_findings"),
        F.hll_sketch_agg("repo_url", lg).alias(REPOS),
        F.theta_sketch_agg("value_sha256", lg).alias(VALUES),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("secret_type",), lg: int = LG) -> DataFrame:
    """Rows of several runs, days or types as one per ``by``; an empty ``by`` gives one row."""
    return sketches.groupBy(*by).agg(
        F.sum("n_findings").alias("n_findings"),
        F.hll_union_agg(REPOS).alias(REPOS),
        F.theta_union_agg(VALUES, lg).alias(VALUES),
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """The sketch columns replaced by ``n_repos`` and ``n_values``."""
    rest = [c for c in sketches.columns if c not in (REPOS, VALUES)]
    return sketches.select(
        *rest,
        F.hll_sketch_estimate(REPOS).alias("n_repos"),
        F.theta_sketch_estimate(VALUES).alias("n_values"),
    )


def value_overlap(left: DataFrame, right: DataFrame, by: Sequence[str] = ("secret_type",)) -> DataFrame:
    """Values of both sides, of the left only and of the right only, per group, from sketches alone.

    A group has one row a side (:func:`merge_sketches`); one of a single side counts there. The error of each number is relative
    to the values of both sides together.
    """
    a = left.select(*by, F.col(VALUES).alias("_a"), F.lit(None).cast("binary").alias("_b"))
    b = right.select(*by, F.lit(None).cast("binary").alias("_a"), F.col(VALUES).alias("_b"))
    both = a.unionByName(b).groupBy(*by).agg(F.any_value("_a", True).alias("_a"), F.any_value("_b", True).alias("_b"))
    total, kept, gone = _estimate(F.theta_intersection("_a", "_b")), _only("_a", "_b"), _only("_b", "_a")
    return both.select(*by, F.coalesce(total, F.lit(0)).alias("n_both"), kept.alias("n_left"), gone.alias("n_right"))


def _estimate(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch).cast("long")


def _only(own: str, other: str) -> Column:
    alone = F.when(F.col(other).isNull(), _estimate(F.col(own)))
    return F.coalesce(alone, _estimate(F.theta_difference(own, other)), F.lit(0))


def within(estimate: Column, exact: Column, scale: Column | None = None, lg: int = LG) -> Column:
    """Whether an estimate is within :func:`error_bound` of ``exact``, relative to ``scale`` (else ``exact``)."""
    allowed = F.greatest((scale if scale is not None else exact) * F.lit(error_bound(lg)), F.lit(0.5))
    return F.abs(estimate - exact) <= allowed

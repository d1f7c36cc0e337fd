"""Aggregations over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.display import secret_status


def secrets_only(findings: DataFrame) -> DataFrame:
    """Findings that are not reads of an environment variable."""
    return findings.filter(~F.col("is_env_reference"))


def env_references(findings: DataFrame) -> DataFrame:
    """Findings that only read an environment variable."""
    return findings.filter("is_env_reference")


def secrets_per_repo(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """``n_secrets, n_env_references, status`` for every analysed repository."""
    counts = findings.groupBy("repo_url").agg(
        F.count_if(~F.col("is_env_reference")).alias("n_secrets"),
        F.count_if("is_env_reference").alias("n_env_references"),
    )
    return (
        repos.join(counts, "repo_url", "left")
        .fillna(0, ["n_secrets", "n_env_references"])
        .withColumn("status", secret_status("n_secrets"))
    )


def quiet_filter(per_repo: DataFrame) -> DataFrame:
    """Only repositories with at least one finding."""
    return per_repo.filter(F.col("n_secrets") > 0)


def findings_by_type(findings: DataFrame, by_repo: bool = False) -> DataFrame:
    """Findings and repositories per secret type; ``by_repo`` gives the full cube.

    Reduced per type and repository first, so a type that makes up most of
    the findings does not end up in one task.
    """
    per_pair = findings.groupBy("secret_type", "repo_url").agg(F.count("*").alias("n"))
    if by_repo:
        return per_pair.cube("secret_type", "repo_url").agg(
            F.sum("n").alias("n_findings"), F.grouping_id().alias("level")
        )
    return per_pair.groupBy("secret_type").agg(
        F.sum("n").alias("n_findings"), F.count("*").alias("n_repos")
    )


def reused_secrets(findings: DataFrame) -> DataFrame:
    """Values, by hash, that occur in more than one repository."""
    per_pair = findings.groupBy("value_sha256", "repo_url").agg(F.count("*").alias("n"))
    return (
        per_pair.groupBy("value_sha256")
        .agg(F.count("*").alias("n_repos"), F.sum("n").alias("n_findings"))
        .filter("n_repos > 1")
    )

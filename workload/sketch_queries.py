"""Merged sketches beside exact counts: estimates are compared by whether they keep their error bound."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakatlas.operators import repos, scan, sketches

from .folders import new_folder
from .inputs import cte, relation
from .registry import query
from .scan_queries import CONFIG_FINDINGS, configs

RUNS = 3


def _config_runs(spark, sf_dir):
    """Findings of the configuration files with the run that read them."""
    found = scan.scan_secrets(configs(spark, sf_dir), key_cols=("repo_url", "path", "k"))
    return found.withColumn("run", F.pmod("k", F.lit(RUNS)).cast("int"))


def _stored_sketches(found, name: str):
    """The sketches of every run, written apart and read together."""
    folder = new_folder(found.sparkSession, name)
    sketches.usage_sketches(found, ("run", "secret_type")).write.partitionBy("run").parquet(folder)
    return found.sparkSession.read.parquet(folder)


@query(
    "findings_by_type_sketch",
    CONFIG_FINDINGS
    + "SELECT secret_type, count(*) AS n_findings, count(DISTINCT repo_url) AS n_repos, count(DISTINCT value_sha256) AS n_values, "
    "true AS repos_within, true AS values_within FROM findings GROUP BY secret_type",
)
def findings_by_type_sketch(spark, sf_dir):
    """Sketches of three runs merged by type, against the exact numbers."""
    found = _config_runs(spark, sf_dir)
    merged = sketches.estimates(sketches.merge_sketches(_stored_sketches(found, "type_sketches")))
    exact = found.groupBy("secret_type").agg(F.countDistinct("repo_url").alias("exact_repos"), F.countDistinct("value_sha256").alias("exact_values"))
    return merged.join(exact, "secret_type").select(
        "secret_type",
        "n_findings",
        F.col("exact_repos").alias("n_repos"),
        F.col("exact_values").alias("n_values"),
        sketches.within(F.col("n_repos"), F.col("exact_repos")).alias("repos_within"),
        sketches.within(F.col("n_values"), F.col("exact_values")).alias("values_within"),
    )


@query(
    "reused_secrets_sketch",
    CONFIG_FINDINGS.rstrip()
    + f", runs AS (SELECT DISTINCT f.secret_type, f.value_sha256, c.k % {RUNS} = 0 AS own FROM findings f JOIN configs c USING (repo_url, path))"
    + ", sides AS (SELECT secret_type, value_sha256, bool_or(own) AS l, bool_or(NOT own) AS r FROM runs GROUP BY secret_type, value_sha256) "
    "SELECT secret_type, count_if(l AND r) AS n_both, count_if(l AND NOT r) AS n_left, count_if(r AND NOT l) AS n_right, true AS estimates_within "
    "FROM sides GROUP BY secret_type",
)
def reused_secrets_sketch(spark, sf_dir):
    """Values of the first run that later runs hold too, from sketches, against the exact numbers."""
    found = _config_runs(spark, sf_dir)
    stored = _stored_sketches(found, "value_sketches")
    first = sketches.merge_sketches(stored.filter("run = 0"))
    later = sketches.merge_sketches(stored.filter("run > 0"))
    near = sketches.value_overlap(first, later).toDF("secret_type", "_both", "_left", "_right")
    sides = found.groupBy("secret_type", "value_sha256").agg(F.bool_or(F.col("run") == 0).alias("l"), F.bool_or(F.col("run") > 0).alias("r"))
    exact = sides.groupBy("secret_type").agg(
        F.count_if(F.expr("l AND r")).alias("n_both"), F.count_if(F.expr("l AND NOT r")).alias("n_left"), F.count_if(F.expr("r AND NOT l")).alias("n_right"), F.count("*").alias("_all")
    )
    ok = [sketches.within(F.col(f"_{s}"), F.col(f"n_{s}"), F.col("_all")) for s in ("both", "left", "right")]
    return exact.join(near, "secret_type").select("secret_type", "n_both", "n_left", "n_right", (ok[0] & ok[1] & ok[2]).alias("estimates_within"))


@query("unique_repo_count_sketch", cte("hits") + "SELECT count(DISTINCT repo_url) AS n_repos, true AS estimate_within FROM hits")
def unique_repo_count_sketch(spark, sf_dir):
    """Repositories of all pages from one sketch a page."""
    hits = relation(spark, sf_dir, "hits")
    merged = hits.groupBy("page").agg(F.hll_sketch_agg("repo_url", sketches.LG).alias("s")).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("near"))
    both = repos.unique_repo_count(hits).select("n_repos", F.lit(None).cast("long").alias("near")).unionByName(merged.select(F.lit(None).cast("long").alias("n_repos"), "near"))
    total = both.agg(F.max("n_repos").alias("n_repos"), F.max("near").alias("near"))
    return total.select("n_repos", sketches.within(F.col("near"), F.col("n_repos")).alias("estimate_within"))

"""Sketches merge over runs as if all findings had been read at once."""

from pyspark.sql import functions as F

from leakatlas.operators import sketches


def findings(spark, low, high):
    return spark.range(low, high).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("secret_type"),
        F.concat(F.lit("r"), F.col("id") % 5000).alias("repo_url"),
        F.sha2(F.col("id").cast("string"), 256).alias("value_sha256"),
    )


def by_type(df):
    return {r.secret_type: r for r in df.collect()}


def test_merged_runs_equal_one_pass(spark):
    runs = [sketches.usage_sketches(findings(spark, k * 20_000, (k + 1) * 20_000)) for k in range(3)]
    merged = by_type(sketches.estimates(sketches.merge_sketches(runs[0].unionByName(runs[1]).unionByName(runs[2]))))
    whole = by_type(sketches.estimates(sketches.usage_sketches(findings(spark, 0, 60_000))))
    bound = sketches.error_bound()
    for t, n_repos, n_values in (("hot", 4500, 54_000), ("cold", 500, 6000)):
        assert merged[t].n_findings == whole[t].n_findings == n_values
        assert merged[t].n_repos == whole[t].n_repos
        assert abs(merged[t].n_repos - n_repos) <= bound * n_repos
        assert abs(merged[t].n_values - n_values) <= bound * n_values
    again = sketches.merge_sketches(runs[0].unionByName(runs[0]))  # the same run twice: counts add, distinct ones do not
    assert by_type(sketches.estimates(again))["hot"].n_values == by_type(sketches.estimates(runs[0]))["hot"].n_values


def test_overlap_of_two_runs(spark):
    left, right = (sketches.usage_sketches(findings(spark, a, b)) for a, b in ((0, 30_000), (20_000, 60_000)))
    rows = by_type(sketches.value_overlap(left, right.filter("secret_type = 'hot'")))
    bound = sketches.error_bound() * 54_000
    assert abs(rows["hot"].n_both - 9000) <= bound and abs(rows["hot"].n_left - 18_000) <= bound and abs(rows["hot"].n_right - 27_000) <= bound
    assert rows["cold"].n_both == rows["cold"].n_right == 0 and abs(rows["cold"].n_left - 3000) <= sketches.error_bound() * 3000


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("t", None, None), (None, "r", "v"), (None, "r", "v")], "secret_type string, repo_url string, value_sha256 string")
    got = by_type(sketches.estimates(sketches.merge_sketches(sketches.usage_sketches(rows))))
    assert tuple(got["t"])[1:] == (1, 0, 0) and tuple(got[None])[1:] == (2, 1, 1)
    none = sketches.usage_sketches(rows.limit(0))
    assert sketches.estimates(sketches.merge_sketches(none)).count() == 0 and sketches.value_overlap(none, none).count() == 0

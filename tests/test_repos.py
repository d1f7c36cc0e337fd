import datetime

import pytest
from pyspark.sql import functions as F

from leakatlas.operators import eligibility, health, paths, ranking, records, repos
from test_scan import plan_of


def hits(spark, rows):
    return spark.createDataFrame(rows, "page int, pos int, repo_url string, path string")


def test_dedup_lowest_page_last_item(spark):
    df = hits(spark, [(1, 0, "A", "f1"), (1, 1, "A", "f2"), (2, 0, "A", "f3"), (2, 1, "B", "f4")])
    once = repos.dedup_repo(df)
    assert sorted((r.repo_url, r.path) for r in once.collect()) == [("A", "f2"), ("B", "f4")]
    assert sorted(repos.dedup_repo(once).collect()) == sorted(once.collect())
    plan = plan_of(repos.dedup_repo(df))
    # The first rows are picked before the exchange, so a hot repository is cheap.
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index(", Final") < plan.index("Exchange") < plan.index(", Partial")


def page_rows(sizes, fresh):
    """Pages of the given sizes; each repeats repository 'old' but for ``fresh`` new ones."""
    rows = []
    for p, (size, new) in enumerate(zip(sizes, fresh), start=1):
        for i in range(size):
            rows.append((p, i, f"r{p}-{i}" if i < new else "old", "f"))
    return rows


def read_pages(df):
    return sorted(r.page for r in df.filter("is_read").collect())


def test_page_stop_rules(spark):
    short = hits(spark, page_rows([100, 100, 40, 100], [100, 100, 40, 100]))
    assert read_pages(repos.page_stop(short)) == [1, 2, 3]
    full = hits(spark, page_rows([100] * 12, [100] * 12))
    assert read_pages(repos.page_stop(full)) == list(range(1, 13))
    assert read_pages(repos.page_stop(full, max_results=1_000)) == list(range(1, 11))
    assert read_pages(repos.page_stop(full, max_repos=150)) == [1, 2]
    # Only kept rows count towards the cap: repeats of a known repository do not.
    dull = hits(spark, page_rows([100] * 12, [50] * 12))
    got = {r.page: (r.kept, r.total_kept) for r in repos.page_stop(dull).collect()}
    assert got[1] == (100, 100) and got[2] == (50, 150)
    assert read_pages(repos.page_stop(dull)) == list(range(1, 13))
    # An empty landed page ends the search.
    sizes = spark.createDataFrame([(1, 100), (2, 0), (3, 100)], "page int, n_items int")
    gap = hits(spark, [r for r in page_rows([100] * 3, [100] * 3) if r[0] != 2])
    assert read_pages(repos.page_stop(gap, sizes)) == [1, 2]


def test_page_stop_per_search(spark):
    df = hits(spark, page_rows([100, 100, 10], [100, 100, 10])).withColumn("search", F.lit("a"))
    df = df.unionByName(hits(spark, page_rows([100, 5], [100, 5])).withColumn("search", F.lit("b")))
    got = repos.page_stop(df, keys=["search"]).filter("is_read").groupBy("search").agg(F.max("page").alias("p"))
    assert {r.search: r.p for r in got.collect()} == {"a": 3, "b": 2}


def test_limit_repos(spark):
    df = hits(spark, page_rows([100, 100, 100], [100, 100, 100]))
    assert repos.limit_repos(df, 20).count() == 20
    assert {r.page for r in repos.limit_repos(df, 20).collect()} == {1}
    assert repos.limit_repos(df, 20, mode="page").count() == 100
    assert repos.limit_repos(df, 150, mode="page").count() == 200
    for bad in (0, -1):
        with pytest.raises(ValueError):
            repos.limit_repos(df, bad)


def test_running_totals_cross_blocks(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("page"), (F.col("id") % 7).alias("n"))
    out = ranking.running_totals(df, [], "page", {"t": "n"}, block=16).orderBy("page").collect()
    total = 0
    for r in out:
        total += r.n
        assert r.t == total
    assert len(out) == 1000


def test_top_n_two_steps(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("repo_url"),
        F.sha2(F.col("id").cast("string"), 256).alias("path"),
    )
    for n in (5, 1500):  # below and above the map-side limit
        got = paths.cap_files(df, n).select("repo_url", "path")
        from pyspark.sql import Window

        w = Window.partitionBy("repo_url").orderBy("path")
        want = df.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        assert got.filter("repo_url = 'hot'").count() == n
    with pytest.raises(ValueError):
        paths.cap_files(df, 0)


def test_records_keep_every_item(spark):
    items = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 100)).alias("repo_url"),
        F.lit("files").alias("section"),
        F.concat(F.lit("p"), F.col("id")).alias("path"),
    )
    items = items.unionByName(items.limit(100))  # repeats count once
    header = items.select("repo_url").distinct().withColumn("mark", F.lit("m"))
    header = header.unionByName(spark.createDataFrame([("empty", "m")], header.schema))
    once = records.distinct_items(items, ["repo_url"])
    facts = header.join(records.count_items(once, ["repo_url"], ["files"]), "repo_url", "left").fillna(0)
    out = records.with_header(facts, once, ["repo_url"])
    heads = {r.repo_url: r.n_files for r in out.filter("section = 'repository'").collect()}
    assert heads["hot"] == 2500 and heads["empty"] == 0 and len(heads) == 52
    got = out.filter("section = 'files'").select("repo_url", "path")
    want = items.select("repo_url", "path").distinct()
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_records_of_header_keys_only(spark):
    items = spark.createDataFrame([("a", "files", "x"), ("b", "files", "y"), (None, "files", "z")], "repo_url string, section string, path string")
    header = spark.createDataFrame([("a", 1)], "repo_url string, v int")
    rows = records.with_header(header, records.distinct_items(items, ["repo_url"]), ["repo_url"], ["v"]).collect()
    assert sorted((r.section, r.repo_url, r.v, r.path) for r in rows if r.path) == [("files", "a", 1, "x")] and len(rows) == 2


def test_records_run_their_input_once(spark):
    items = spark.range(100).select(F.lit("r").alias("repo_url"), F.lit("files").alias("section"), F.col("id").cast("string").alias("path"))
    once = records.distinct_items(items.repartition(4, "path"), ["repo_url"])
    out = records.with_header(records.count_items(once, ["repo_url"], ["files"]), once, ["repo_url"])
    out.collect()
    plan = plan_of(out).split("Initial Plan")[0]
    assert plan.count("Range (") == 1 and "ReusedExchange" in plan


def test_limits_of_several_searches(spark):
    rows = [(q, f"{q}{p}-{i}", p, i) for q, n in (("a", 4), ("b", 2)) for p in range(1, n + 1) for i in range(100)]
    df = spark.createDataFrame(rows, "q string, repo_url string, page int, pos int")
    exact = {r.q: r["count"] for r in repos.limit_repos(df, 150, keys=["q"]).groupBy("q").count().collect()}
    assert exact == {"a": 150, "b": 150}
    pages = {(r.q, r.page) for r in repos.limit_repos(df, 250, mode="page", keys=["q"]).collect()}
    assert pages == {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)}
    assert {r.page for r in repos.limit_repos(df, 10_000, mode="page", keys=["q"], max_results=200).collect()} == {1, 2}
    with pytest.raises(TypeError):
        repos.limit_repos(df, 5, pages=3)


def test_sort_repos(spark):
    d = datetime.datetime
    df = spark.createDataFrame(
        [("b", d(2024, 1, 1), d(2024, 3, 1)), ("a", d(2024, 1, 1), d(2024, 2, 1)), ("c", d(2025, 1, 1), d(2024, 1, 1))],
        "repo_url string, last_commit_file timestamp, last_commit_repo timestamp",
    )
    order = lambda **o: [r.repo_url for r in repos.sort_repos(df, **o).collect()]
    assert order() == ["c", "a", "b"]
    assert order(sort="ASC") == ["a", "b", "c"]
    assert order(commit_date="Repo") == ["b", "a", "c"]
    assert order(limit=1) == ["c"]
    assert "TakeOrderedAndProject" in plan_of(repos.sort_repos(df, limit=1))
    for bad in ({"sort": "up"}, {"commit_date": "tag"}, {"limit": 0}):
        with pytest.raises(ValueError):
            repos.sort_repos(df, **bad)


def test_commit_dates_default_to_run_time(spark):
    d = datetime.datetime
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "repo_url string, path string")
    commits = spark.createDataFrame(
        [("a", "x", d(2024, 1, 1)), ("a", "x", d(2024, 1, 5)), ("a", "z", d(2024, 2, 1))],
        "repo_url string, path string, committed_at timestamp",
    )
    out = repos.join_commit_dates(
        base, repos.last_commit_per_repo(commits), repos.last_commit_per_file(commits), "2025-01-01 00:00:00"
    )
    got = {r.repo_url: (r.last_commit_repo, r.last_commit_file, r.date_missing) for r in out.collect()}
    assert got == {
        "a": (d(2024, 2, 1), d(2024, 1, 5), False),
        "b": (d(2025, 1, 1), d(2025, 1, 1), True),
    }


def test_eligibility_goldens(spark):
    rows = [
        ("x", "payments", None, [], False, None, None),
        ("x", "docker-app", None, [], False, "name", "doc"),
        ("x", "my-docs-test", None, [], False, "name", "doc"),
        ("x", "cold-store", None, [], False, "name", "old"),
        ("AcmeCorp", "payments", None, [], True, "owner", "acmecorp"),
        ("x", "payments", "A Demo app", [], False, "description", "demo"),
        ("x", "payments", None, ["api", "Latest"], False, "topic", "'Latest' indicates it's a test"),
        ("x", "payments", None, [], True, "archived", "archived"),
    ]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, owner string, name string, description string, topics array<string>, is_archived boolean, kind string, part string",
    )
    got = eligibility.should_scan_repo(df, "acme.com").orderBy("i").collect()
    for r in got:
        assert r.reason_class == r.kind and r.should_scan == (r.kind is None)
        assert r.kind is None or r.part in r.reason
    token = eligibility.should_scan_repo(df, "acme.com", match="token").orderBy("i").collect()
    assert [r.reason_class for r in token] == [None, None, "name", None, "owner", "description", None, "archived"]
    # An empty label matches every owner.
    assert {r.reason_class for r in eligibility.should_scan_repo(df, ".com").collect()} == {"name", "owner"}
    with pytest.raises(ValueError):
        eligibility.should_scan_repo(df, "acme.com", match="regex")


def test_token_words_are_cut_once(spark):
    """Long texts without a skip word are cut into words once, not once for each of them."""
    df = spark.createDataFrame([(None,), ("",), ("Demo of docs",), ("tmp, OLD-spec",), ("docker cold",)], "t string")
    word = eligibility.first_skip_word(df.t, "token")
    assert [r[0] for r in df.select(word).collect()] == [None, None, "docs", "spec", None]
    assert str(word).count("split(") == 1


def test_http_errors(spark):
    log = spark.createDataFrame([(s, "b") for s in (200, 401, 403, 403, 404, 418, 429, 500, 502, 503)], "status int, body string")
    got = {r.bucket: (r.label, r.n) for r in health.http_error_counts(log).collect()}
    assert {k: v[1] for k, v in got.items()} == {
        "401": 1, "403": 2, "404": 1, "429": 1, "500": 1, "503": 1, "other": 2, "total": 9,
    }
    assert got["other"][0] == "Other Errors" and got["429"][0] == "Rate Limit Exceeded"
    assert health.http_error_counts(log.filter("status = 200")).count() == 0
    assert sum(n for k, (_, n) in got.items() if k != "total") == got["total"][1]


def test_rate_limits(spark):
    rows = [
        (429, "any", True),
        (403, "API rate limit exceeded", True),
        (403, "X-RateLimit-Remaining: 0", True),
        (403, "Rate Limit", False),
        (403, None, False),
        (500, "rate limit", False),
    ]
    df = spark.createDataFrame(rows, "status int, body string, want boolean")
    assert df.filter(health.is_rate_limited() != F.col("want")).count() == 0


def test_interesting_paths(spark):
    paths_in = {
        ".env.local": True, "a/.ENV": True, "src/Config.py": True, "a.yml": True, "b/c.JSON": True,
        "config.md": False, "x.html": False, "main.rs": False, "configs/main.rs": False, "pom.xml": True,
    }
    df = spark.createDataFrame([(p,) for p in paths_in], "path string")
    assert {r.path: r.k for r in df.select("path", paths.is_interesting("path").alias("k")).collect()} == paths_in


def test_domain_search_pushes_the_path_test(spark):
    df = spark.createDataFrame(
        [("a.py", "see Example.COM"), ("b.rs", "example.com"), ("c.py", "none")], "path string, text string"
    )
    assert [r.path for r in paths.domain_search(df, "example.com", [" ..PY", "", "."]).collect()] == ["a.py"]
    assert paths.domain_search(df, "example.com", ["."]).count() == 2
    with pytest.raises(ValueError):
        paths.domain_search(df, "localhost")


def test_anti_seen(spark):
    df = hits(spark, [(1, 0, "A", "f"), (1, 1, "B", "f")])
    assert [r.repo_url for r in repos.anti_seen(df, df.filter("repo_url = 'A'")).collect()] == ["B"]


def test_approximate_count(spark):
    df = hits(spark, page_rows([100] * 3, [100] * 3))
    assert repos.unique_repo_count(df).first().n_repos == 300
    assert abs(repos.unique_repo_count(df, approximate=True).first().n_repos - 300) < 30

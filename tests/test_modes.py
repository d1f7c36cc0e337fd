import datetime

import pytest
from pyspark.sql import functions as F

from goldens import A
from leakatlas import list_mode, single_file_mode, whole_repo_mode
from leakatlas.operators.scan import scan_secrets
from leakatlas.streaming.scan_stream import read_scan, scan_stream, start_scan
from test_scan import plan_of

D = datetime.datetime


def facts(spark, names):
    return spark.createDataFrame(
        [(n, D(2024, 1, 1 + i), D(2024, 2, 1 + i)) for i, n in enumerate(names)],
        "repo_url string, last_commit_file timestamp, last_commit_repo timestamp",
    )


def files(spark):
    return spark.createDataFrame(
        [
            ("A", "src/config.json", "url: api.example.com\ndb_password=" + A(10)),
            ("A", ".env", "EXAMPLE.com\nDB_PASSWORD=${DB_PASSWORD}"),
            ("A", "other.env", "db_password=" + A(12)),
            ("B", "b.py", "example.com only"),
            ("C", "c.py", "db_password=" + A(10)),
        ],
        "repo_url string, path string, text string",
    )


def section(rows, name, repo=None):
    return [r for r in rows if r.section == name and repo in (None, r.repo_url)]


def test_single_file_mode(spark):
    langs = spark.createDataFrame([("A", "C#", 9978), ("A", "Dockerfile", 22)], "repo_url string, lang string, bytes long")
    rows = single_file_mode(files(spark), facts(spark, "ABC"), "example.com", languages=langs).collect()
    b, a = section(rows, "repository")  # newest file first; C has no matching file
    assert (b.repo_url, b.status, b.n_secrets, b.n_files) == ("B", "No secrets detected", 0, 1)
    assert (a.repo_url, a.status, a.n_secrets, a.n_files) == ("A", "Secrets Found", 1, 2)
    assert [r.path for r in section(rows, "files")] == ["b.py", ".env", "src/config.json"]
    assert [(f.path, f.line_no, f.key_name, f.secret_type) for f in section(rows, "findings")] == [("src/config.json", 2, "db_password", "Password")]
    assert [(f.path, f.key_name) for f in section(rows, "env_refs")] == [(".env", "DB_PASSWORD")]
    assert [(x.lang, x.pct) for x in section(rows, "languages")] == [("C#", 99.78), ("Dockerfile", 0.22)]
    # A repository's rows stand together, its header first.
    assert [r.repo_url for r in rows] == ["B"] * 2 + ["A"] * 7
    assert rows[0].section == rows[2].section == "repository"
    quiet = single_file_mode(files(spark), facts(spark, "ABC"), "example.com", quiet=True)
    assert {r.repo_url for r in quiet.collect()} == {"A"}
    only_py = single_file_mode(files(spark), facts(spark, "ABC"), "example.com", include_ext=[".py"], sort="asc")
    assert {r.repo_url for r in only_py.collect()} == {"B"}
    one = single_file_mode(files(spark), facts(spark, "ABC"), "example.com", max_repos=2)
    assert {r.repo_url for r in one.collect()} == {"B"}  # B and C come first, C has no file


def test_reports_never_hold_the_value(spark):
    text = str(single_file_mode(files(spark), facts(spark, "ABC"), "example.com").collect())
    assert A(10) not in text and "db_password" in text


def test_shape_does_not_depend_on_size(spark):
    """A repository of 30,000 items is a header and 30,000 rows."""
    many = spark.range(15_000).select(
        F.lit("A").alias("repo_url"),
        F.format_string("f%05d", "id").alias("path"),
        F.concat(F.lit("example.com\ndb_password="), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
    )
    report = single_file_mode(many, facts(spark, "A"), "example.com", quiet=True)
    counts = {r.section: r["count"] for r in report.groupBy("section").count().collect()}
    assert counts == {"repository": 1, "files": 15_000, "findings": 15_000}
    header = report.filter("section = 'repository'").collect()[0]
    assert (header.n_files, header.n_secrets) == (15_000, 15_000)


def whole_inputs(spark):
    repos = facts(spark, ["u/pay", "u/docs", "u/arch"]).withColumns(
        {
            "owner": F.lit("u"),
            "name": F.substring_index("repo_url", "/", -1),
            "description": F.lit(None).cast("string"),
            "topics": F.array().cast("array<string>"),
            "is_archived": F.col("repo_url") == "u/arch",
        }
    )
    tree = spark.createDataFrame(
        [
            ("u/pay", "a/.env", "s1"),
            ("u/pay", "b/.env", "s1"),
            ("u/pay", "c/app.yml", "s2"),
            ("u/pay", "readme.md", "s1"),
            ("u/pay", "main.rs", "s1"),
            ("u/pay", "z.json", "gone"),
            ("u/docs", "x.env", "s1"),
            ("u/arch", "x.env", "s1"),
        ],
        "repo_url string, path string, sha string",
    )
    blobs = spark.createDataFrame(
        [
            ("s1", f"secret_key={A(16)}\nsecret_key={A(16)}"),
            ("s1", f"secret_key={A(16)}\nsecret_key={A(16)}"),  # landed twice
            ("s2", "db_password = os.getenv('X_LONG_NAME')"),
        ],
        "sha string, content string",
    )
    return repos, tree, blobs


def test_whole_repo_mode(spark):
    rows = whole_repo_mode(*whole_inputs(spark), "acme.com").collect()
    assert {r.repo_url for r in rows} == {"u/pay"}
    (r,) = section(rows, "repository")
    assert (r.n_files, r.n_secrets, r.n_env_refs) == (4, 4, 1)
    assert [f.path for f in section(rows, "files")] == ["a/.env", "b/.env", "c/app.yml", "z.json"]
    assert [(f.path, f.line_no) for f in section(rows, "findings")] == [("a/.env", 1), ("a/.env", 2), ("b/.env", 1), ("b/.env", 2)]
    assert [(e.ext, e.n_of_ext) for e in section(rows, "skipped_exts")] == [(".md", 1), (".rs", 1)]
    capped = whole_repo_mode(*whole_inputs(spark), "acme.com", max_files=1).collect()
    (r,) = section(capped, "repository")
    assert (r.n_files, r.n_wanted, r.capped, r.n_secrets) == (1, 4, True, 2)
    assert [f.path for f in section(capped, "files")] == ["a/.env"]
    yml = whole_repo_mode(*whole_inputs(spark), "acme.com", include_ext=["YML"], prune_blobs=True).collect()
    assert [f.path for f in section(yml, "files")] == ["c/app.yml"] and len(section(yml, "env_refs")) == 1
    assert whole_repo_mode(*whole_inputs(spark), "acme.com", max_repos=1, sort="asc").count() == len(rows)


def test_reports_scan_once(spark):
    """The final plan runs the rules in one place, although items are counted and listed."""
    for report in (
        whole_repo_mode(*whole_inputs(spark), "acme.com"),
        single_file_mode(files(spark), facts(spark, "ABC"), "example.com"),
    ):
        report.collect()
        plan = plan_of(report).split("Initial Plan")[0]
        assert sum("posexplode" in line for line in plan.split("\n") if "Generate" in line) == 1


def test_whole_repo_mode_does_not_shuffle_content(spark):
    plan = plan_of(whole_repo_mode(*whole_inputs(spark), "acme.com"))
    for line in plan.split("\n"):
        if "Exchange" in line:
            assert "content" not in line
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def hits(spark):
    rows = [
        ("A", "a", "o", f"https://github.com/o/a/blob/main/{f}", D(2024, 1, d), D(2024, 3, 1))
        for f, d in (("x/b.py", 1), ("a.env", 2))
    ] + [("B", "b", "o", "https://github.com/o/b/blob/main/c.html", D(2024, 1, 3), D(2024, 2, 1))]
    return spark.createDataFrame(
        rows,
        "repo_url string, repo_name string, owner_url string, file_url string, last_commit_file timestamp, last_commit_repo timestamp",
    )


def test_list_mode(spark):
    rows = list_mode(hits(spark)).collect()
    assert [(r.repo_url, r.name) for r in rows] == [("B", None), ("B", "c.html"), ("A", None), ("A", "a.env"), ("A", "b.py")]
    rows = list_mode(hits(spark), commit_date="repo", exclude_ext=["html"]).collect()
    assert [(r.repo_url, r.n_files) for r in section(rows, "repository")] == [("A", 2), ("B", 0)]
    rows = list_mode(hits(spark), include_ext=["py"], max_repos=1, sort="asc").collect()
    assert [(r.repo_url, r.name) for r in rows] == [("A", None), ("A", "b.py")]
    with pytest.raises(ValueError):
        list_mode(hits(spark), max_repos=0)


def arriving(spark, folder, day):
    both = files(spark).union(files(spark)).unionByName(files(spark).withColumn("repo_url", F.lit("fork")))
    ts = F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")
    both.select("*", F.sha2("text", 256).alias("sha"), ts.alias("ts")).repartition(3).write.mode("append").parquet(folder)


STREAM_SCHEMA = "repo_url string, path string, text string, sha string, ts timestamp"
VERSION = ["repo_url", "path", "sha"]


def wanted(spark):
    once = files(spark).unionByName(files(spark).withColumn("repo_url", F.lit("fork"))).withColumn("sha", F.sha2("text", 256)).distinct()
    return scan_secrets(once, key_cols=VERSION)


def test_stream_reports_each_version_once(spark, tmp_path):
    arriving(spark, str(tmp_path / "in"), 1)
    found = scan_stream(spark.readStream.schema(STREAM_SCHEMA).parquet(str(tmp_path / "in")))
    run = (
        found.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    want = wanted(spark)
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).select(*want.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_late_files_have_an_output_of_their_own(spark, tmp_path):
    folder, source = str(tmp_path / "scan"), str(tmp_path / "in")

    def run():
        start_scan(spark.readStream.schema(STREAM_SCHEMA).parquet(source), folder, watermark="1 day").awaitTermination()
        return [read_scan(spark, folder, name) for name in ("findings", "late")]

    want = wanted(spark)
    arriving(spark, source, 20)
    first, late = run()
    assert first.select(*want.columns).exceptAll(want).count() == 0 and first.count() == want.count() and late.count() == 0
    arriving(spark, source, 20)  # the same versions again
    again, late = run()
    assert again.count() == want.count() and late.count() == 0
    arriving(spark, source, 5)  # older than the watermark
    again, late = run()
    assert again.count() == want.count() and late.select(VERSION).distinct().count() == want.select(VERSION).distinct().count()


def test_cap_moves_slices_of_a_hot_repository(spark):
    """The first cut of a large cap is spread by salt even if the input lies by repository."""
    from leakatlas.operators import paths

    tree = spark.range(10).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo_url"), F.col("id").cast("string").alias("path"))
    plan = plan_of(paths.cap_files(tree.repartition("repo_url"), 5000))
    assert any("Exchange" in line and "_salt" in line for line in plan.split("\n"))

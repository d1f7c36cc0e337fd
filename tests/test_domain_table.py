"""Searches for a table of domains."""

from pyspark.sql import functions as F

from leakatlas.operators.domain_table import HOST_CHARS, domain_list, domains_inventory, domains_search
from plans import exchanged_columns
from test_scan import plan_of

TEXTS = [
    ("a", "see https://api.example.com/x and http://API.example.com. then https://example.community"),
    ("b", "https://a.b.example.com:80/ https://other.org? https://notexample.com https://..example.com./"),
    ("c", None),
    ("d", ""),
    ("e", "example.com without a scheme, ftp://example.com, https://" + "a." * HOST_CHARS + "example.com"),
]
NAMES = ["https://www.Example.com/x", "example.com", "b.example.com", "other.org:8080", "localhost", None, "", "unseen.net"]


def inputs(spark):
    return spark.createDataFrame(TEXTS, "path string, text string"), spark.createDataFrame([(n,) for n in NAMES], "domain string")


def test_domains_are_cleaned(spark):
    assert sorted(r.domain for r in domain_list(inputs(spark)[1]).collect()) == ["b.example.com", "example.com", "other.org", "unseen.net"]


def test_whole_labels_only(spark):
    got = sorted(map(tuple, domains_inventory(*inputs(spark)).collect()))
    assert got == [
        ("b.example.com", "a.b.example.com", 1, 1),
        ("example.com", "a.b.example.com", 1, 1),
        ("example.com", "api.example.com", 1, 2),
        ("example.com", "example.com", 1, 1),
        ("other.org", "other.org", 1, 1),
    ]
    got = sorted(map(tuple, domains_search(*inputs(spark)).collect()))
    assert got == [("b.example.com", "b", 1), ("example.com", "a", 2), ("example.com", "b", 2), ("other.org", "b", 1)]


def test_empty_tables(spark):
    files, names = inputs(spark)
    for f, n in ((files.limit(0), names), (files, names.limit(0))):
        assert domains_inventory(f, n).count() == domains_search(f, n).count() == 0


def test_a_thousand_domains_are_one_pass_without_nested_loops(spark, tmp_path):
    inputs(spark)[0].write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    names = spark.range(1000).select(F.concat(F.lit("d"), "id", F.lit(".example.com")).alias("domain"))
    plan = plan_of(domains_inventory(files, names))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("FileScan parquet") == 1
    assert "text" not in exchanged_columns(domains_search(files, names)) | exchanged_columns(domains_inventory(files, names))

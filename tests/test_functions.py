import pytest
from pyspark.sql import functions as F

from leakatlas.functions import display, domains, urls


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first().x


def many(spark, fn, inputs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, u string")
    return [r.x for r in df.select("i", fn("u").alias("x")).orderBy("i").collect()]


URL_GOLDENS = [
    ('"https://h/a.py?ref=x" ', "https://h/a.py", "a.py", ".py"),
    ("https://github.com/u/r/blob/main/src/a.py", None, "src/a.py", ".py"),
    ("https://github.com/u/r/blob/main/x/blob/y.py", None, "x", ""),
    ("https://github.com/u/r/blob/feature/z/a.py", None, "z/a.py", ".py"),
    ("https://github.com/u/r/blob/main", None, "main", ""),
    ("https://raw.githubusercontent.com/u/r/main/d/a.py", None, "d/a.py", ".py"),
    ("https://raw.githubusercontent.com/u/r/a.py", None, "a.py", ".py"),
    ("https://h/d/a.py#L3", None, "a.py#L3", ".py#l3"),
    ("\u00a0https://h/a b.py\u00a0", "https://h/a b.py", "a b.py", ".py"),
    ("", "", "", ""),
]


def test_url_goldens(spark):
    inputs = [g[0] for g in URL_GOLDENS]
    assert many(spark, urls.clean_url, inputs) == [g[0] if g[1] is None else g[1] for g in URL_GOLDENS]
    assert many(spark, urls.extract_file_path, inputs) == [g[2] for g in URL_GOLDENS]
    path_ext = lambda u: urls.file_extension(urls.extract_file_path(u))
    assert many(spark, path_ext, inputs) == [g[3] for g in URL_GOLDENS]


def test_clean_file_name(spark):
    assert many(spark, urls.clean_file_name, ["https://h/d/a.py?x=1/2", "a", "https://h/d/", None]) == ["a.py", "a", "", None]


def test_file_extension(spark):
    goldens = {
        "src/A.RS": ".rs",
        ".env": ".env",
        "Makefile": "",
        "a.": ".",
        "a.tar.gz": ".gz",
        "d.v1/Makefile": "",
        "https://github.com/u/r/blob/main/d.v1/Makefile": ".v1/makefile",
        "https://h/a.py?x=1": ".py?x=1",
    }
    assert many(spark, urls.file_extension, list(goldens)) == list(goldens.values())


def test_normalize_ext(spark):
    inputs = [" .RS ", "rs", "", "  ", ".tar.gz"]
    want = [".rs", ".rs", "", "", ".tar.gz"]
    assert many(spark, urls.normalize_ext, inputs) == want
    assert [urls.normalize_ext_option(i) for i in inputs] == want


@pytest.mark.parametrize(
    "include, exclude, want",
    [
        (None, None, ["a.rs", "b.md", "Makefile"]),
        (["rs"], None, ["a.rs"]),
        ([" .RS "], None, ["a.rs"]),
        ([], ["md"], ["a.rs", "b.md", "Makefile"]),
        ([""], None, ["Makefile"]),
        (None, ["md"], ["a.rs", "Makefile"]),
        (["rs"], ["rs"], []),
    ],
)
def test_ext_filter(spark, include, exclude, want):
    files = ["a.rs", "b.md", "Makefile"]
    assert one(spark, urls.filter_files("f", include, exclude), f=files) == want
    rows = many(spark, lambda u: urls.ext_allowed(u, include, exclude), files)
    assert [f for f, keep in zip(files, rows) if keep] == want


def test_repo_owner_name(spark):
    got = many(
        spark,
        urls.repo_owner_name,
        ["https://github.com/o/r/blob/x", "https://github.com/o", "https://gitlab.com/o/r", "http://github.com/o/r"],
    )
    assert [tuple(r) if r else None for r in got] == [("o", "r"), None, ("https:", ""), ("o", "r")]


def test_domains(spark):
    inputs = ["http://www.Acme.com:8080/x", "api.acme.com", ".com"]
    assert many(spark, domains.clean_domain, inputs) == ["acme.com", "api.acme.com", ".com"]
    assert many(spark, domains.domain_label, inputs) == ["acme", "api", ""]
    assert domains.check_domain("a.b") == "a.b"
    with pytest.raises(ValueError):
        domains.check_domain("localhost")


def test_url_mining(spark):
    text = "http://a.example.com/x https://a.example.com http://a.example.com https://EXAMPLE.com https://example.community https://user@example.com"
    assert one(spark, domains.extract_urls("t", "example.com"), t=text) == [
        "http://a.example.com",
        "https://a.example.com",
        "https://example.com",
    ]
    assert one(spark, domains.extract_subdomains("t", "example.com"), t=text) == ["a.example.com", "example.com"]
    assert one(spark, domains.extract_urls("t", "example.com"), t="nothing") == []
    # The dot of the domain is a literal one.
    assert one(spark, domains.extract_urls("t", "example.com"), t="http://examplexcom") == []


def test_display(spark):
    ts = F.lit("2025-02-24 10:30:00").cast("timestamp")
    assert one(spark, display.fmt_commit_date(ts), a="x") == "24/02/2025 10:30:00 UTC"
    assert one(spark, display.finding_label("p", "k", "t"), p="a/b.env", k="db_password", t="Password") == "a/b.env (db_password: Password)"

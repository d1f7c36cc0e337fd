"""A scan of each text once gives the findings of the plain scan."""

import pytest
from pyspark.sql import functions as F

from goldens import A
from leakatlas.operators.distinct_scan import repeated_texts, scan_secrets_distinct
from leakatlas.operators.scan import scan_secrets
from plans import exchanged_columns
from test_scan import plan_of

SECRET = "x = 1\ndb_password=" + A(10) + "\napi_key: " + A(20)
ROWS = [
    *[(f"r{i}", "hot.env", SECRET) for i in range(30)],
    ("r1", "hot.env", SECRET),  # a repeated row
    ("r1", "hot.env", SECRET),
    ("r2", "one.env", "db_password=" + A(11)),
    ("r3", "two.env", "nothing"),
    ("r4", "two.env", "nothing"),
    (None, None, SECRET),
    (None, "null.env", "db_password=" + A(12)),
    ("r5", "null.env", "db_password=" + A(12)),
    ("r6", "empty", ""),
    ("r7", "empty", ""),
    ("r8", "null", None),
    ("r9", "null", None),
]


def table(spark):
    return spark.createDataFrame(ROWS, "repo_url string, path string, text string")


@pytest.mark.parametrize("max_texts", [200_000, 1, 0])
def test_equal_findings(spark, max_texts):
    files = table(spark)
    want, got = scan_secrets(files), scan_secrets_distinct(files, max_texts=max_texts)
    assert got.columns == want.columns and want.count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    hashed = files.withColumn("sha", F.when(F.col("repo_url") != "r4", F.sha2("text", 256)))
    got = scan_secrets_distinct(hashed, sha_col="sha", max_texts=max_texts)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert scan_secrets_distinct(files.limit(0)).count() == 0


def test_most_repeated_texts_come_first(spark):
    rows = repeated_texts(table(spark), F.sha2("text", 256), ["repo_url", "path"], 1).collect()
    assert len(rows) == 1 and rows[0]["_holder"].path is None  # nulls are least


def test_texts_are_not_moved(spark, tmp_path):
    table(spark).withColumn("sha", F.sha2("text", 256)).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    found = scan_secrets_distinct(files, sha_col="sha")
    assert not {"text", "_text"} & exchanged_columns(found)
    assert "text:string" not in plan_of(repeated_texts(files, F.col("sha"), ["repo_url", "path"]))
    reads = [line for line in plan_of(found).split("\n") if "ReadSchema" in line]
    assert sum("text:string" in line for line in reads) == 2 < len(reads)  # the scan for either side of the union

"""Bucketed layouts and the ledger of runs."""

import re
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from leakatlas.operators import paths
from leakatlas.plans.modes import whole_repo_mode
from leakatlas.rules import make_rule, rules_version, shipped_rules
from leakatlas.sources import ledger as ledger_module
from leakatlas.sources.layout import Layout
from leakatlas.sources.ledger import Ledger


def folder(name="t"):
    return f"file://{tempfile.mkdtemp(prefix='run-layout-')}/{name}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def no_exchange_above(df, column):
    """No exchange in the final plan carries ``column`` (its output would name it)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    formatted = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", formatted)
    assert "Bucketed: true" in formatted
    assert not [e for e in exchanges if re.search(rf"\b{column}#", e)], exchanges
    return plan


BLOBS = [("a", "base64", "aGVsbG8="), ("b", "utf-8", "plain"), ("c", "base64", "!!"), ("d", None, None), (None, "utf-8", "no key"), ("unused", "utf-8", "x" * 1000)]
TREE = [("r1", "f1", "a"), ("r1", "f2", "b"), ("r2", "f1", "a"), ("r2", "f3", "missing"), ("r3", "f", None), ("r3", "g", "c"), ("r3", "h", "d")] + [("hot", f"p{i}", "b") for i in range(200)]


@pytest.fixture
def tree(spark):
    return spark.createDataFrame(TREE, "repo_url string, path string, sha string")


@pytest.fixture
def blobs(spark):
    return spark.createDataFrame(BLOBS, "sha string, encoding string, content string")


@pytest.mark.parametrize("buckets", [1, 5])
def test_layout_join_equals_the_plain_join(spark, tree, blobs, buckets):
    want = rows(paths.join_tree_blobs(tree, blobs).select("repo_url", "path", "sha", "content", "decode_status"))
    laid = Layout.write(blobs, folder(), buckets)
    assert rows(laid.table) == rows(blobs)
    got = paths.join_tree_layout(tree, laid).select("repo_url", "path", "sha", "content", "decode_status")
    assert rows(got) == want
    no_exchange_above(got, "content")
    both = paths.join_tree_layout(Layout.write(tree, folder(), buckets), laid).select("repo_url", "path", "sha", "content", "decode_status")
    assert rows(both) == want


@pytest.mark.parametrize("hot_bytes", [0, 1 << 20])
def test_hot_blob_is_joined_apart(spark, tree, blobs, monkeypatch, hot_bytes):
    want = rows(paths.join_tree_blobs(tree, blobs).select("repo_url", "path", "sha", "content", "decode_status"))
    monkeypatch.setattr(paths, "HOT_FILES", 50)
    monkeypatch.setattr(paths, "HOT_BYTES", hot_bytes)
    got = paths.join_tree_layout(tree, Layout.write(blobs, folder(), 4))
    assert rows(got.select("repo_url", "path", "sha", "content", "decode_status")) == want


def test_layout_is_reopened_and_appended(spark, blobs):
    place = folder()
    first = Layout.write(blobs.filter("sha in ('a', 'b')"), place, 3)
    first.append(spark.createDataFrame([("b", "x", "other"), ("e", "utf-8", "new"), ("e", "utf-8", "new"), (None, "x", "y")], blobs.schema))
    first.close()
    again = Layout(spark, place)
    assert rows(again.table) == sorted([("a", "base64", "aGVsbG8="), ("b", "utf-8", "plain"), ("e", "utf-8", "new")], key=str)
    again.append(blobs)
    assert again.table.count() == 6 and again.table.select("sha").distinct().count() == 6
    with pytest.raises(Exception, match="non-empty directory"):
        Layout.write(blobs, place, 3)
    with pytest.raises(ValueError, match="buckets"):
        Layout.write(blobs, folder(), 0)
    assert rows(Layout(spark, place).matching(spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "sha string"))) == [("a", "base64", "aGVsbG8=")]


def test_matching_moves_keys_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.sha2("text", 256).alias("sha"), F.col("text").alias("content"))
    laid = Layout.write(docs.dropDuplicates(["sha"]), folder(), 6)
    no_exchange_above(laid.matching(docs.limit(300).select("sha")), "content")


def test_whole_repo_mode_over_a_layout(spark):
    repositories = spark.createDataFrame(
        [("https://github.com/o/r", "o", "r", None, [], False, None, None)],
        "repo_url string, owner string, name string, description string, topics array<string>, is_archived boolean, last_commit_repo timestamp, last_commit_file timestamp",
    )
    tree = spark.createDataFrame([("https://github.com/o/r", ".env", "s1"), ("https://github.com/o/r", "x.yaml", "s2")], "repo_url string, path string, sha string")
    blobs = spark.createDataFrame([("s1", "db_password=abcdefgh1"), ("s2", "nothing"), ("s3", "app_password=abcdefgh2")], "sha string, content string")
    laid = Layout.write(blobs, folder(), 4)
    want = rows(whole_repo_mode(repositories, tree, blobs, "example.org", prune_blobs=True))
    kept = laid.matching(tree)
    assert rows(whole_repo_mode(repositories, tree, kept, "example.org")) == want
    no_exchange_above(whole_repo_mode(repositories, tree, kept, "example.org"), "content")


# --- ledger ---


FILES = "repo_url string, path string, sha string, text string"


def files(spark, keys):
    return spark.createDataFrame([(f"r{k % 3}" if k is not None else None, f"p{k}", f"s{k}" if k is not None else None, "t" * 50) for k in keys], FILES)


def names(df):
    return sorted(r.path for r in df.collect())


def test_runs_see_each_content_once(spark):
    ledger = Ledger(spark, folder())
    assert ledger.current() == (0, []) and ledger.seen().count() == 0
    first = files(spark, [1, 2, 3, 3, None])
    assert names(ledger.unseen(first)) == ["p1", "p2", "p3", "p3", "pNone"]
    assert ledger.record(first, "a") == 1
    second = files(spark, [2, 3, 4, None])
    assert names(ledger.unseen(second)) == ["p4", "pNone"]
    assert ledger.unseen(second).columns == second.columns
    # The same content in another repository is new there.
    assert names(ledger.unseen(spark.createDataFrame([("other", "q", "s2", "t")], FILES))) == ["q"]
    assert ledger.record(second, "b") == 2
    assert sorted((r.sha, r.run_id) for r in ledger.seen().collect()) == [("s1", "a"), ("s2", "a"), ("s3", "a"), ("s4", "b")]
    assert Ledger(spark, ledger.folder).current() == ledger.current()


def test_other_rules_scan_again(spark):
    ledger = Ledger(spark, folder())
    ledger.record(files(spark, [1, 2]), "a")
    own = [make_rule(0, "(own)=(x+)", "Own")]
    assert rules_version(own) != rules_version() == rules_version(shipped_rules())
    assert names(ledger.unseen(files(spark, [1, 2]))) == []
    assert names(ledger.unseen(files(spark, [1, 2]), own)) == ["p1", "p2"]
    ledger.record(files(spark, [1]), "b", own)
    assert names(ledger.unseen(files(spark, [1, 2]), own)) == ["p2"]


def test_a_crashed_run_leaves_the_old_state(spark, monkeypatch):
    ledger = Ledger(spark, folder())
    ledger.record(files(spark, [1]), "a")
    before = ledger.current()

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_publish", crash)
        with pytest.raises(RuntimeError):
            ledger.record(files(spark, [1, 2]), "b")
        with pytest.raises(RuntimeError):
            ledger.compact()
    assert ledger.current() == before and names(ledger.unseen(files(spark, [1, 2]))) == ["p2"]
    assert ledger.record(files(spark, [1, 2]), "b") == 2
    assert ledger.seen().count() == 2
    with pytest.raises(Exception, match="(?i)exists"):  # a version is never replaced
        ledger._publish(2, "late", [], 0)


def test_compaction_keeps_the_entries(spark):
    ledger = Ledger(spark, folder())
    for run in range(3):
        ledger.record(files(spark, range(run, run + 5)), f"run-{run}")
    entries = rows(ledger.seen())
    assert ledger.compact() == 4
    assert len(ledger.current()[1]) == 1 and rows(ledger.seen()) == entries
    assert [r.rows for r in ledger.versions().orderBy("version").collect()] == [5, 6, 7, 7]


@pytest.mark.parametrize("share", [0.3, 0.001])
def test_filter_bounds(spark, share):
    """No seen key passes as new; about the promised share of new ones is held back, and still found."""
    ledger = Ledger(spark, folder(), share)
    keys = spark.range(40_000).select(F.concat(F.lit("r"), F.col("id") % 7).alias("repo_url"), F.sha2(F.col("id").cast("string"), 256).alias("sha"), F.lit("x").alias("text"), F.col("id").cast("string").alias("path"))
    ledger.record(keys.filter("cast(path as int) < 20000"), "a")
    held = ledger.seen().select("repo_url", "sha")
    marked = ledger._maybe(keys, ledger._bloom(held, held.count()))
    assert marked.filter("cast(path as int) < 20000 and not _maybe").count() == 0
    assert marked.filter("cast(path as int) >= 20000 and _maybe").count() <= 20_000 * share * 1.3 + 5
    assert ledger.unseen(keys).filter("cast(path as int) < 20000").count() == 0
    assert ledger.unseen(keys).count() == 20_000


def test_without_filter_and_with_many_held_back(spark, monkeypatch):
    ledger = Ledger(spark, folder(), 0.5)
    ledger.record(files(spark, range(100)), "a")
    monkeypatch.setattr(ledger_module, "FEW_KEYS", 0)
    assert ledger.unseen(files(spark, range(300))).count() == 200
    monkeypatch.setattr(ledger_module, "BLOOM_BYTES", 0)
    assert ledger.unseen(files(spark, range(300))).count() == 200


def test_texts_are_not_shuffled(spark):
    ledger = Ledger(spark, folder())
    ledger.record(files(spark, range(50)), "a")
    new = ledger.unseen(files(spark, range(40, 90)))
    new.collect()
    formatted = new._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", formatted)
    assert exchanges and not [e for e in exchanges if "text#" in e]


def test_bad_share(spark):
    with pytest.raises(ValueError, match="false_positives"):
        Ledger(spark, folder(str(uuid.uuid4())), 0)

import base64
import datetime
import json

from pyspark.sql import functions as F

from leakatlas import load_rules
from leakatlas.rules import rules_table, shipped_rules
from leakatlas.sources import payloads, sinks


def body(spark, key, rows):
    return spark.createDataFrame(rows, f"{key}, body string")


def item(repo="https://github.com/o/r", **drop):
    out = {
        "html_url": "https://github.com/o/r/blob/main/a.py",
        "url": "https://api.github.com/x",
        "repository": {
            "name": "r",
            "html_url": repo,
            "commits_url": "https://api.github.com/repos/o/r/commits{/sha}",
            "owner": {"html_url": "https://github.com/o"},
        },
    }
    for k in drop:
        out.pop(k)
    return out


def test_search_items_and_quarantine(spark):
    pages = body(
        spark,
        "page int",
        [
            (1, json.dumps({"total_count": 2, "items": [item(), item(url=0)]})),
            (2, json.dumps({"items": []})),
            (3, "{}"),
            (4, "not json"),
        ],
    )
    rows = payloads.search_items(pages).collect()
    assert [(r.page, r.pos, r.repo_url, r.commits_url) for r in rows] == [
        (1, 0, "https://github.com/o/r", "https://api.github.com/repos/o/r/commits")
    ]
    bad = sorted((r.page, r.pos, r.detail) for r in payloads.search_items_quarantine(pages).collect())
    assert bad == [(1, 1, "missing url"), (3, None, "missing items"), (4, None, "missing items")]
    sizes = sorted(tuple(r) for r in payloads.search_page_sizes(pages).collect())
    assert sizes == [(1, 2), (2, 0)]


def test_repo_tree(spark):
    tree = {
        "tree": [
            {"type": "blob", "path": "a", "sha": "1"},
            {"type": "tree", "path": "b", "sha": "2"},
            {"type": "blob", "path": "c"},
            {"type": "blob", "sha": "4"},
            {"path": "e", "sha": "5"},
        ]
    }
    rows = payloads.repo_tree(body(spark, "repo_url string", [("r", json.dumps(tree)), ("s", "{}")])).collect()
    assert [tuple(r) for r in rows] == [("r", "a", "1")]


def test_blob_decoding(spark):
    b64 = lambda s: base64.b64encode(s).decode()
    cases = {
        "plain": ({"encoding": "base64", "content": "aGVsbG8="}, "hello", "ok"),
        "newline": ({"encoding": "base64", "content": "aGVs\nbG8=\r\n"}, "hello", "ok"),
        "utf8": ({"encoding": "base64", "content": b64("é€".encode())}, "é€", "ok"),
        "bad_utf8": ({"encoding": "base64", "content": b64(b"\xffA")}, None, "invalid_utf8"),
        "bad_b64": ({"encoding": "base64", "content": "!!!"}, None, "invalid_base64"),
        "text": ({"encoding": "utf-8", "content": "as is"}, "as is", "ok"),
        "no_encoding": ({"content": "as is"}, "as is", "ok"),
        "missing": ({"encoding": "base64"}, None, "missing_content"),
        "empty": ({"encoding": "base64", "content": ""}, "", "ok"),
        "junk": ("not json", None, "missing_content"),
    }
    rows = [(k, v[0] if isinstance(v[0], str) else json.dumps(v[0])) for k, v in cases.items()]
    got = {r.sha: (r.content, r.decode_status) for r in payloads.decode_blobs(body(spark, "sha string", rows)).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}


def test_commit_dates(spark):
    def commits(*dates):
        return json.dumps([{"commit": {"committer": {"date": d}}} for d in dates])

    d = datetime.datetime
    cases = {
        "offset": (commits("2025-02-24T10:30:00+02:00", "2030-01-01T00:00:00Z"), d(2025, 2, 24, 8, 30), "ok"),
        "zulu": (commits("2025-02-24T10:30:00Z"), d(2025, 2, 24, 10, 30), "ok"),
        "fraction": (commits("2025-02-24T10:30:00.5Z"), d(2025, 2, 24, 10, 30, 0, 500000), "ok"),
        "empty": ("[]", None, "no_commits"),
        "local": (commits("2025-02-24T10:30:00"), None, "invalid_date"),
        "words": (commits("yesterday"), None, "invalid_date"),
        "none": (json.dumps([{"commit": {}}]), None, "missing_date"),
        "object": ("{", None, "invalid_payload"),
    }
    rows = [(k, v[0]) for k, v in cases.items()]
    got = {r.repo_url: (r.committed_at, r.outcome) for r in payloads.commit_dates(body(spark, "repo_url string", rows)).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}


def test_repo_metadata(spark):
    infos = body(
        spark,
        "owner string, name string",
        [
            ("o", "a", json.dumps({"default_branch": "main", "description": "d", "archived": True})),
            ("o", "b", json.dumps({"default_branch": "dev", "description": None})),
            ("o", "c", json.dumps({"description": "no branch"})),
        ],
    )
    topics = body(
        spark, "owner string, name string", [("o", "a", '{"names": ["x", 5, null, "y"]}'), ("o", "b", "oops")]
    )
    got = {r.name: r for r in payloads.repo_metadata(infos, topics).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].topics, got["a"].is_archived, got["a"].description) == (["x", "y"], True, "d")
    assert (got["b"].topics, got["b"].is_archived, got["b"].description) == ([], False, None)
    branches = payloads.default_branch(payloads.repo_metadata(infos, topics))
    assert sorted(tuple(r) for r in branches.collect()) == [("o", "a", "main"), ("o", "b", "dev")]


def test_languages(spark):
    df = body(spark, "repo_url string", [("r", '{"C#": 9978, "Dockerfile": 22}'), ("s", "{}")])
    from leakatlas.operators.repos import language_share

    rows = language_share(payloads.repo_languages(df)).orderBy(F.desc("pct")).collect()
    assert [(r.lang, r.pct) for r in rows] == [("C#", 99.78), ("Dockerfile", 0.22)]


def test_rule_file_round_trip(spark, tmp_path):
    shipped = shipped_rules()
    path = tmp_path / "rules.json"
    records = [
        {"pattern": r.pattern, "secret_type": r.secret_type, "description": "d", **({"disabled": True} if r.disabled else {})}
        for r in shipped
    ]
    path.write_text(json.dumps(records, indent=1))
    loaded = load_rules(spark, str(path))
    assert [(r.rule_id, r.pattern, r.disabled) for r in loaded] == [(r.rule_id, r.pattern, r.disabled) for r in shipped]
    # Shipped patterns keep their tuned form.
    assert [(r.anchors, r.spark_pattern) for r in loaded] == [(r.anchors, r.spark_pattern) for r in shipped]
    table = rules_table(spark, loaded)
    assert table.count() == 31 and table.filter("disabled").count() == 2
    assert table.select("secret_type").distinct().count() == 28


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([("r", None)], "repo_url string, note string")
    sinks.write_json(df, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert [json.loads(r.value) for r in lines] == [{"repo_url": "r", "note": None}]
    assert [r.json for r in sinks.to_json_lines(df).collect()] == ['{"repo_url":"r","note":null}']


def test_raw_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.env").write_text("x=1\ny=2\n")
    rows = payloads.read_raw_files(spark, str(tmp_path)).collect()
    assert [r.text for r in rows] == ["x=1\ny=2\n"] and rows[0].file_url.endswith("d/a.env")

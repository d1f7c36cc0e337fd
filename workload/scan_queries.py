"""Queries over the detection rules: scans, counts, precedence, redaction, modes."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from leakatlas.functions.display import finding_label, fmt_commit_date
from leakatlas.operators import distinct_scan, repos, scan, summaries
from leakatlas.plans.modes import single_file_mode, whole_repo_mode
from leakatlas.rules import load_rules, rules_table, shipped_rules
from leakatlas.sources.sinks import to_json_lines
from leakatlas.sources.tables import read_table

from .inputs import cte, relation, spread
from .registry import query

ENV_SQL = scan.ENV_REFERENCE_PATTERN
FINDING_COLS = (
    "repo_url", "path", "line_no", "rule_id", "secret_type", "key_name", "value_sha256", "value_len", "is_env_reference",
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits_ctes(source: str, include_disabled: bool, resolve: str = "first", env_by: str = "value") -> str:
    """CTEs ``raw_hits`` and ``findings`` over a relation with repo_url, path, text."""
    rules = [r for r in shipped_rules() if include_disabled or not r.disabled]
    branches = []
    for r in rules:
        p = quote(r.pattern)
        tier = r.tier * 1000000 + r.rule_id if resolve == "specific" else r.rule_id
        branches.append(
            f"SELECT repo_url, path, line_no, line, {r.rule_id} AS rule_id, {quote(r.secret_type)} AS secret_type, "
            f"{tier} AS prio, unnest(regexp_extract_all(line, {p}, 1)) AS key_name, "
            f"unnest(regexp_extract_all(line, {p}, {1 if r.value_group == r.key_group else 2})) AS v FROM numbered WHERE regexp_matches(line, {p})"
        )
    covered = (
        "SELECT 1 FROM raw_hits y WHERE y.repo_url = x.repo_url AND y.path = x.path AND y.line_no = x.line_no "
        "AND y.prio < x.prio AND contains(y.value, x.value)"
    )
    keep = "" if resolve == "all" else f" WHERE NOT EXISTS ({covered})"
    return f"""
, pieces AS MATERIALIZED (SELECT repo_url, path, unnest(string_split(text, chr(10))) AS piece,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {source})
, numbered AS MATERIALIZED (SELECT repo_url, path, CAST(line_no AS INTEGER) AS line_no,
    regexp_replace(piece, '\\r$', '') AS line FROM pieces)
, raw_hits AS MATERIALIZED (SELECT * EXCLUDE (v), CASE WHEN v <> '' THEN v ELSE key_name END AS value FROM (
    {' UNION ALL '.join(branches)}))
, findings AS MATERIALIZED (SELECT repo_url, path, line_no, rule_id, secret_type, key_name,
    sha256(value) AS value_sha256, CAST(length(value) AS INTEGER) AS value_len,
    regexp_matches({env_by}, {quote(ENV_SQL)}) AS is_env_reference, value FROM raw_hits x{keep})
"""


def docs(spark, sf_dir):
    return spread(relation(spark, sf_dir, "docs").select("repo_url", "path", "text"), "path")


def configs(spark, sf_dir):
    return spread(relation(spark, sf_dir, "configs"), "path")


DOC_FINDINGS = cte("docs") + hits_ctes("docs", True)
CONFIG_FINDINGS = cte("configs") + hits_ctes("configs", False)
CONFIG_ALL = cte("configs") + hits_ctes("configs", True, "all")
ALL_COLS = ", ".join(FINDING_COLS)


@query("scan_secrets", DOC_FINDINGS + f"SELECT {ALL_COLS} FROM findings")
def scan_secrets(spark, sf_dir):
    return scan.scan_secrets(docs(spark, sf_dir), include_disabled=True).select(*FINDING_COLS)


@query("apply_rules", CONFIG_ALL + f"SELECT {ALL_COLS} FROM findings")
def apply_rules(spark, sf_dir):
    found = scan.scan_secrets(configs(spark, sf_dir), include_disabled=True, resolve="all")
    return found.select(*FINDING_COLS)


@query("rule_precedence", CONFIG_FINDINGS + f"SELECT {ALL_COLS} FROM findings")
def rule_precedence(spark, sf_dir):
    return scan.scan_secrets(configs(spark, sf_dir)).select(*FINDING_COLS)


@query(
    "rule_precedence_specific",
    cte("configs") + hits_ctes("configs", True, "specific") + f"SELECT {ALL_COLS} FROM findings",
)
def rule_precedence_specific(spark, sf_dir):
    found = scan.scan_secrets(configs(spark, sf_dir), include_disabled=True, resolve="specific")
    return found.select(*FINDING_COLS)


@query(
    "rule_enabled",
    CONFIG_FINDINGS + "SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id",
)
def rule_enabled(spark, sf_dir):
    return scan.scan_secrets(configs(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "env_reference",
    CONFIG_FINDINGS
    + "SELECT repo_url, path, line_no, key_name, secret_type FROM findings WHERE is_env_reference",
)
def env_reference(spark, sf_dir):
    found = summaries.env_references(scan.scan_secrets(configs(spark, sf_dir)))
    return found.select("repo_url", "path", "line_no", "key_name", "secret_type")


@query(
    "env_reference_lines",
    cte("configs")
    + hits_ctes("configs", False, env_by="line")
    + "SELECT repo_url, path, line_no, key_name, secret_type, is_env_reference FROM findings",
)
def env_reference_lines(spark, sf_dir):
    """The reading in which a line that reads the environment holds no secret."""
    found = scan.scan_secrets(configs(spark, sf_dir), env_by="line")
    return found.select("repo_url", "path", "line_no", "key_name", "secret_type", "is_env_reference")


# A line with a read of the environment and a secret beside it, from documents.
BOTH_KINDS = "concat('url=${{HOST}} db_password=', substr({0}, 1, 12), ' other_password = os.getenv(', doc_id, 'ABCD)')"


@query(
    "env_reference_mixed",
    f"WITH mixed AS (SELECT source AS repo_url, CAST(doc_id AS VARCHAR) AS path, {BOTH_KINDS.format('sha256(text)')} AS text FROM documents)"
    + hits_ctes("mixed", False)
    + "SELECT repo_url, path, line_no, key_name, value_sha256, is_env_reference FROM findings",
)
def env_reference_mixed(spark, sf_dir):
    files = read_table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_url"), F.col("doc_id").cast("string").alias("path"), F.expr(BOTH_KINDS.format("sha2(text, 256)")).alias("text")
    )
    return scan.scan_secrets(files).select("repo_url", "path", "line_no", "key_name", "value_sha256", "is_env_reference")


@query(
    "finding_label",
    CONFIG_FINDINGS
    + "SELECT repo_url, concat(path, ' (', key_name, ': ', secret_type, ')') AS label FROM findings WHERE NOT is_env_reference",
)
def finding_labels(spark, sf_dir):
    found = summaries.secrets_only(scan.scan_secrets(configs(spark, sf_dir)))
    return found.select("repo_url", finding_label("path", "key_name", "secret_type").alias("label"))


def _count_branches(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {r.rule_id} AS rule_id, {quote(r.secret_type)} AS secret_type, "
        f"CAST(coalesce(sum(len(regexp_extract_all(text, {quote(r.pattern)}, 0))), 0) AS BIGINT) AS n_matches FROM {source}"
        for r in shipped_rules()
    )


@query("count_matches", cte("docs") + " " + _count_branches("docs"))
def count_matches(spark, sf_dir):
    return scan.count_matches(docs(spark, sf_dir), include_disabled=True)


@query("count_matches_configs", cte("configs") + " " + _count_branches("configs"))
def count_matches_configs(spark, sf_dir):
    return scan.count_matches(configs(spark, sf_dir), include_disabled=True)


OWN_RULES = os.path.join(os.path.dirname(__file__), "own_rules.json")


def _rule_values() -> str:
    shipped = [(r.rule_id, r.pattern, r.secret_type, r.disabled) for r in shipped_rules()]
    with open(OWN_RULES, encoding="utf-8") as f:
        own = [(1000 + i, r["pattern"], r["secret_type"], bool(r.get("disabled"))) for i, r in enumerate(json.load(f))]
    return ", ".join(f"({i}, {quote(p)}, {quote(t)}, {str(d).lower()})" for i, p, t, d in shipped + own)


@query(
    "src_rules",
    CONFIG_ALL
    + f", r(rule_id, pattern, secret_type, disabled) AS (VALUES {_rule_values()})"
    + ", doc_lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)"
    + ", own AS (SELECT r.rule_id, CAST(sum(len(regexp_extract_all(line, pattern))) AS BIGINT) AS n FROM doc_lines, r WHERE r.rule_id >= 1000 AND regexp_matches(line, pattern) GROUP BY r.rule_id)"
    + ", hits AS (SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id UNION ALL FROM own)"
    + " SELECT r.rule_id, r.pattern, r.secret_type, r.disabled, coalesce(n, 0) AS n_hits FROM r LEFT JOIN hits USING (rule_id)",
)
def src_rules(spark, sf_dir):
    """Both rule tables, the shipped one and one read from a rule file, with the number of hits of each rule."""
    found = scan.scan_secrets(configs(spark, sf_dir), include_disabled=True, resolve="all")
    own = load_rules(spark, "file://" + OWN_RULES)
    in_docs = scan.scan_secrets(docs(spark, sf_dir), own, include_disabled=True, resolve="all")
    hits = found.select("rule_id").union(in_docs.select(F.col("rule_id") + 1000))
    counts = hits.groupBy("rule_id").agg(F.count("*").alias("n"))
    rules = rules_table(spark).union(rules_table(spark, own).withColumn("rule_id", F.col("rule_id") + 1000))
    return rules.join(counts, "rule_id", "left").select(
        "rule_id", "pattern", "secret_type", "disabled", F.coalesce("n", F.lit(0)).alias("n_hits")
    )


PLAIN_RULES = os.path.join(os.path.dirname(__file__), "plain_rules.json")


def _plain_values() -> str:
    with open(PLAIN_RULES, encoding="utf-8") as f:
        return ", ".join(f"({i}, {quote(r['pattern'])}, {quote(r['secret_type'])})" for i, r in enumerate(json.load(f)))


@query(
    "src_rules_derived",
    f"WITH r(rule_id, pattern, secret_type) AS (VALUES {_plain_values()}), doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), "
    "hits AS (SELECT rule_id, doc_id, CAST(len(regexp_extract_all(line, pattern)) AS BIGINT) AS n FROM doc_lines, r WHERE regexp_matches(line, pattern)) "
    "SELECT rule_id, secret_type, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_hits, count(DISTINCT doc_id) AS n_documents FROM r LEFT JOIN hits USING (rule_id) GROUP BY ALL",
)
def src_rules_derived(spark, sf_dir):
    """Hits of a rule file that names no anchors; one of its rules has no literal to be tested for."""
    rules = load_rules(spark, "file://" + PLAIN_RULES)
    found = scan.scan_secrets(docs(spark, sf_dir), rules, include_disabled=True, resolve="all")
    counts = found.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("d"))
    return rules_table(spark, rules).join(counts, "rule_id", "left").select(
        "rule_id", "secret_type", F.coalesce("n", F.lit(0)).alias("n_hits"), F.coalesce("d", F.lit(0)).alias("n_documents")
    )


def _redact_sql(source: str, key: str) -> str:
    out = "text"
    for r in shipped_rules():
        out = f"regexp_replace({out}, {quote(r.pattern)}, '[redacted:{r.rule_id}]', 'g')"
    return cte(source) + f" SELECT {key}, sha256({out}) AS masked_sha FROM {source}"


@query("redact", _redact_sql("docs", "path"))
def redact(spark, sf_dir):
    return docs(spark, sf_dir).select("path", F.sha2(scan.redact("text"), 256).alias("masked_sha"))


@query("redact_configs", _redact_sql("configs", "path"))
def redact_configs(spark, sf_dir):
    return configs(spark, sf_dir).select("path", F.sha2(scan.redact("text"), 256).alias("masked_sha"))


PER_REPO = (
    "SELECT s.repo_url, count(*) FILTER (NOT is_env_reference) AS n_secrets, count(*) FILTER (is_env_reference) AS n_env_references "
    "FROM (SELECT DISTINCT repo_url FROM {src}) s LEFT JOIN findings f ON f.repo_url = s.repo_url GROUP BY s.repo_url"
)
STATUS = "CASE WHEN n_secrets > 0 THEN 'Secrets Found' ELSE 'No secrets detected' END AS status"


def _per_repo(files, **options):
    return summaries.secrets_per_repo(
        files.select("repo_url").distinct(), scan.scan_secrets(files, **options)
    )


@query(
    "secrets_per_repo",
    DOC_FINDINGS + f"SELECT *, {STATUS} FROM ({PER_REPO.format(src='docs')})",
)
def secrets_per_repo(spark, sf_dir):
    return _per_repo(docs(spark, sf_dir), include_disabled=True)


@query(
    "secrets_per_repo_configs",
    CONFIG_FINDINGS + f"SELECT *, {STATUS} FROM ({PER_REPO.format(src='configs')})",
)
def secrets_per_repo_configs(spark, sf_dir):
    return _per_repo(configs(spark, sf_dir))


@query(
    "quiet_filter",
    DOC_FINDINGS + f"SELECT *, {STATUS} FROM ({PER_REPO.format(src='docs')}) WHERE n_secrets > 0",
)
def quiet_filter(spark, sf_dir):
    return summaries.quiet_filter(_per_repo(docs(spark, sf_dir), include_disabled=True))


@query(
    "findings_by_type",
    CONFIG_FINDINGS
    + "SELECT secret_type, count(*) AS n_findings, count(DISTINCT repo_url) AS n_repos FROM findings GROUP BY secret_type",
)
def findings_by_type(spark, sf_dir):
    return summaries.findings_by_type(scan.scan_secrets(configs(spark, sf_dir)))


@query(
    "findings_by_type_cube",
    CONFIG_FINDINGS
    + "SELECT secret_type, repo_url, count(*) AS n_findings, CAST(grouping(secret_type, repo_url) AS BIGINT) AS level "
    "FROM findings GROUP BY CUBE (secret_type, repo_url)",
)
def findings_by_type_cube(spark, sf_dir):
    return summaries.findings_by_type(scan.scan_secrets(configs(spark, sf_dir)), by_repo=True)


@query(
    "reused_secrets",
    CONFIG_FINDINGS
    + "SELECT value_sha256, count(DISTINCT repo_url) AS n_repos, count(*) AS n_findings FROM findings "
    "GROUP BY value_sha256 HAVING count(DISTINCT repo_url) > 1",
)
def reused_secrets(spark, sf_dir):
    return summaries.reused_secrets(scan.scan_secrets(configs(spark, sf_dir)))


# --- modes ------------------------------------------------------------------

# Repository facts of the generated configuration files.
CONFIG_REPOS_SQL = (
    "SELECT repo_url, min(DATE '2020-01-01' + CAST(k % 1000 AS INTEGER)) AS first_day, "
    "max(DATE '2020-01-01' + CAST(k % 1000 AS INTEGER)) AS last_day FROM configs GROUP BY repo_url"
)


def _config_repos(files):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("k") % 1000).cast("int"))
    return files.groupBy("repo_url").agg(
        F.min(day).cast("timestamp").alias("last_commit_file"),
        F.max(day).cast("timestamp").alias("last_commit_repo"),
    )


def _config_languages(files):
    return files.select("repo_url", F.substring("path", 6, 1).alias("lang"), (F.col("k") % 100 + 1).alias("bytes"))


REPORT_COLS = ("repo_url", "section", "n_files", "n_secrets", "n_env_refs", "status", "path", "line_no", "key_name", "secret_type", "rule_id", "value_sha256", "value_len")
STATUS_SQL = STATUS.removesuffix(" AS status")


def report_sql(header: str, files: str, extra: str = "", quiet: bool = False) -> str:
    """Header and item rows; ``header`` has repo_url and the wanted facts, ``files`` repo_url and path."""
    return (
        f", counts AS (SELECT repo_url, count(*) AS n_files FROM {files} GROUP BY repo_url)"
        + ", sums AS (SELECT repo_url, count_if(NOT is_env_reference) AS s, count_if(is_env_reference) AS e FROM findings GROUP BY repo_url)"
        + f", heads AS (SELECT h.repo_url, coalesce(n_files, 0) AS n_files, coalesce(s, 0) AS n_secrets, coalesce(e, 0) AS n_env_refs "
        f"FROM {header} h LEFT JOIN counts USING (repo_url) LEFT JOIN sums USING (repo_url){' WHERE coalesce(s, 0) > 0' if quiet else ''})"
        + ", report AS (SELECT repo_url, 'repository' AS section, n_files, n_secrets, n_env_refs, "
        + STATUS_SQL
        + " AS status, NULL AS path, NULL AS line_no, NULL AS key_name, NULL AS secret_type, NULL AS rule_id, NULL AS value_sha256, NULL AS value_len, "
        "NULL AS label, CAST(NULL AS DOUBLE) AS amount FROM heads "
        f"UNION ALL SELECT repo_url, 'files', NULL, NULL, NULL, NULL, path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {files} SEMI JOIN heads USING (repo_url) "
        "UNION ALL SELECT repo_url, CASE WHEN is_env_reference THEN 'env_refs' ELSE 'findings' END, NULL, NULL, NULL, NULL, path, line_no, key_name, secret_type, rule_id, "
        f"value_sha256, value_len, NULL, NULL FROM findings SEMI JOIN heads USING (repo_url) {extra}) "
    )


LANGS_SQL = (
    ", langs AS (SELECT repo_url, lang, round(b * 100 / sum(b) OVER (PARTITION BY repo_url), 2) AS pct FROM "
    "(SELECT repo_url, substr(path, 6, 1) AS lang, CAST(sum(k % 100 + 1) AS DOUBLE) AS b FROM configs GROUP BY ALL))"
)
LANG_ITEMS = "UNION ALL SELECT repo_url, 'languages', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, lang, pct FROM langs SEMI JOIN heads USING (repo_url)"


def single_sql(quiet: bool = False, limit: int | None = None) -> str:
    top = f" ORDER BY first_day DESC, repo_url LIMIT {limit}" if limit else ""
    return (
        cte("configs")
        + f", facts AS (SELECT * FROM ({CONFIG_REPOS_SQL}){top})"
        + ", matched AS (SELECT configs.* FROM configs SEMI JOIN facts USING (repo_url) WHERE contains(lower(text), 'c.example.com'))"
        + hits_ctes("matched", False)
        + LANGS_SQL
        + ", found AS (SELECT * FROM facts SEMI JOIN matched USING (repo_url))"
        + report_sql("found", "matched", LANG_ITEMS, quiet)
    )


def _single_report(spark, sf_dir, **options):
    files = configs(spark, sf_dir)
    report = single_file_mode(
        files.select("repo_url", "path", "text"), _config_repos(files), "c.example.com", languages=_config_languages(files), **options
    )
    return report.withColumns({"label": F.col("lang"), "amount": F.col("pct")})


SHOWN = f"SELECT {', '.join(REPORT_COLS)}, label, amount FROM report"


@query("scan_single_file_mode", single_sql(quiet=True) + SHOWN)
def scan_single_file_mode(spark, sf_dir):
    return _single_report(spark, sf_dir, quiet=True).select(*REPORT_COLS, "label", "amount")


@query("scan_single_file_limited", single_sql(limit=7) + SHOWN)
def scan_single_file_limited(spark, sf_dir):
    """Only the seven repositories that the report would show first."""
    return _single_report(spark, sf_dir, max_repos=7).select(*REPORT_COLS, "label", "amount")


@query(
    "repo_report",
    single_sql()
    + f"SELECT {', '.join('r.' + c for c in REPORT_COLS)}, label, amount, strftime(last_day, '%d/%m/%Y') || ' 00:00:00 UTC' AS last_commit FROM report r JOIN facts USING (repo_url)",
)
def repo_report(spark, sf_dir):
    report = _single_report(spark, sf_dir, commit_date="repo", sort="asc")
    return report.select(*REPORT_COLS, "label", "amount", fmt_commit_date("last_commit_repo").alias("last_commit"))


@query(
    "sink_report",
    single_sql()
    + "SELECT repo_url, section, CAST(n_files AS VARCHAR) AS n_files, CAST(n_secrets AS VARCHAR) AS n_secrets, status, path, key_name FROM report",
)
def sink_report(spark, sf_dir):
    """Fields read back from the JSON lines of the report."""
    lines = to_json_lines(_single_report(spark, sf_dir))
    names = ("repo_url", "section", "n_files", "n_secrets", "status", "path", "key_name")
    return lines.select(*[F.get_json_object("json", f"$.{c}").alias(c) for c in names])


# Whole-repository mode: documents are the trees and blobs, parts the metadata.
WHOLE_REPOS_SQL = (
    "SELECT repo_url, split_part(repo_url, '/', 4) AS owner, split_part(repo_url, '/', 5) AS name, "
    "max(doc_id) AS last_id FROM docs GROUP BY repo_url"
)
KEEP_SQL = (
    "((starts_with(base, '.env') OR contains(base, 'config') OR ext IN ('.env', '.yaml', '.yml', '.json', '.toml', "
    "'.ini', '.cfg', '.conf', '.properties', '.xml')) AND ext NOT IN ('.html', '.csv', '.md'))"
)
TREE_SQL = (
    "tree AS (SELECT repo_url, path, sha, text, base, ext, " + KEEP_SQL + " AS keep FROM (SELECT repo_url, path, sha, text, "
    "lower(split_part(path, '/', -1)) AS base, CASE WHEN contains(split_part(path, '/', -1), '.') "
    "THEN concat('.', lower(split_part(split_part(path, '/', -1), '.', -1))) ELSE '' END AS ext FROM docs))"
)


SKIP_ITEMS = (
    "UNION ALL SELECT repo_url, 'skipped_exts', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ext, CAST(count(*) AS DOUBLE) "
    "FROM tree SEMI JOIN heads USING (repo_url) WHERE NOT keep GROUP BY repo_url, ext"
)


def whole_sql(kept: str = "keep") -> str:
    return (
        cte("docs")
        + f", facts AS ({WHOLE_REPOS_SQL}), {TREE_SQL}"
        + ", eligible AS (SELECT repo_url, last_id FROM facts WHERE last_id % 5 <> 0)"
        + f", kept AS (SELECT tree.* FROM tree SEMI JOIN eligible USING (repo_url) WHERE {kept})"
        + hits_ctes("kept", True)
        + report_sql("eligible", "kept", SKIP_ITEMS)
    )


def _whole_report(spark, sf_dir, **options):
    files = relation(spark, sf_dir, "docs")
    facts = repos.with_owner_name(
        files.groupBy("repo_url").agg(F.max("doc_id").alias("last_id"))
    ).select(
        "repo_url",
        "owner",
        "name",
        F.lit("payments").alias("description"),
        F.array(F.lit("billing")).alias("topics"),
        (F.col("last_id") % 5 == 0).alias("is_archived"),
        F.timestamp_seconds(F.col("last_id")).alias("last_commit_repo"),
        F.timestamp_seconds(F.col("last_id")).alias("last_commit_file"),
    )
    blobs = spread(files.select("sha", F.col("text").alias("content")), "sha")
    report = whole_repo_mode(
        facts, files.select("repo_url", "path", "sha"), blobs, "acme.com", include_disabled=True, commit_date="repo", **options
    )
    return report.withColumns({"label": F.col("ext"), "amount": F.col("n_of_ext").cast("double")})


@query("scan_whole_repo_mode", whole_sql() + SHOWN)
def scan_whole_repo_mode(spark, sf_dir):
    return _whole_report(spark, sf_dir).select(*REPORT_COLS, "label", "amount")


@query("scan_whole_repo_ext", whole_sql("keep AND ext IN ('.env', '.yaml')") + SHOWN)
def scan_whole_repo_ext(spark, sf_dir):
    """Only files of two extensions, and only blobs that they name."""
    report = _whole_report(spark, sf_dir, include_ext=["env", ".YAML"], prune_blobs=True)
    return report.select(*REPORT_COLS, "label", "amount")


@query("scan_secrets_distinct", DOC_FINDINGS + f"SELECT {ALL_COLS} FROM findings")
def scan_secrets_distinct(spark, sf_dir):
    """The findings of ``scan_secrets``, each text scanned once."""
    return distinct_scan.scan_secrets_distinct(docs(spark, sf_dir), include_disabled=True).select(*FINDING_COLS)

"""Queries over URLs, payloads, repository relations, paths and fetch logs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from leakatlas.functions import domains, urls
from leakatlas.functions.display import fmt_commit_date
from leakatlas.operators import eligibility, health, paths, repos
from leakatlas.operators.ranking import running_totals
from leakatlas.plans.modes import list_mode, search_front
from leakatlas.sources import payloads
from leakatlas.sources.layout import Layout
from leakatlas.sources.ledger import Ledger
from leakatlas.sources.sinks import to_json_lines
from leakatlas.sources.tables import read_table

from .folders import new_folder
from .inputs import cte, relation, spread
from .registry import query
from .scan_queries import KEEP_SQL, TREE_SQL, quote

RUN_TS = "2025-02-24 10:30:00"

# --- URL functions ----------------------------------------------------------

CLEAN_SQL = r"regexp_replace(replace(split_part(u, '?', 1), chr(34), ''), '^\s+|\s+$', '', 'g')"
PATH_SQL = (
    "CASE WHEN contains(c, '/blob/') AND contains(split_part(c, '/blob/', 2), '/') "
    "THEN regexp_replace(split_part(c, '/blob/', 2), '^[^/]*/', '') "
    "WHEN contains(c, 'raw.githubusercontent.com/') AND len(string_split(split_part(c, 'raw.githubusercontent.com/', 2), '/')) > 3 "
    "THEN array_to_string(list_slice(string_split(split_part(c, 'raw.githubusercontent.com/', 2), '/'), 4, len(string_split(split_part(c, 'raw.githubusercontent.com/', 2), '/'))), '/') "
    "ELSE split_part(c, '/', -1) END"
)
URL_CTES = (
    cte("urls")
    + f", cleaned AS (SELECT page_id, u, {CLEAN_SQL} AS c FROM urls)"
    + f", pathed AS (SELECT *, {PATH_SQL} AS p FROM cleaned)"
    + ", ext AS (SELECT *, CASE WHEN contains(u, '/blob/') OR contains(u, 'raw.githubusercontent.com') THEN p "
    "ELSE split_part(u, '/', -1) END AS ep FROM pathed) "
)
EXT_SQL = "CASE WHEN contains({0}, '.') THEN lower(concat('.', split_part({0}, '.', -1))) ELSE '' END"


def _urls(spark, sf_dir):
    return relation(spark, sf_dir, "urls")


@query("clean_url", URL_CTES + "SELECT page_id, c AS clean FROM cleaned")
def clean_url(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.clean_url("u").alias("clean"))


@query("clean_file_name", URL_CTES + "SELECT page_id, split_part(c, '/', -1) AS file_name FROM cleaned")
def clean_file_name(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.clean_file_name("u").alias("file_name"))


@query("extract_file_path", URL_CTES + "SELECT page_id, p AS path FROM pathed")
def extract_file_path(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.extract_file_path("u").alias("path"))


@query("file_extension", URL_CTES + f"SELECT page_id, {EXT_SQL.format('ep')} AS ext FROM ext")
def file_extension(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.file_extension("u").alias("ext"))


RAW_EXT = "CASE doc_id % 4 WHEN 0 THEN concat(' ', upper(lang), ' ') WHEN 1 THEN concat('.', lang) WHEN 2 THEN ' ' ELSE source END"


@query(
    "normalize_ext",
    f"SELECT doc_id, CASE WHEN e = '' OR starts_with(e, '.') THEN e ELSE concat('.', e) END AS ext "
    f"FROM (SELECT doc_id, lower(trim({RAW_EXT})) AS e FROM documents)",
)
def normalize_ext(spark, sf_dir):
    raw = read_table(spark, sf_dir, "documents").select("doc_id", F.expr(RAW_EXT).alias("raw"))
    return raw.select("doc_id", urls.normalize_ext("raw").alias("ext"))


@query(
    "repo_owner_name",
    cte("urls")
    + ", s AS (SELECT page_id, string_split(replace(replace(u, 'https://github.com/', ''), 'http://github.com/', ''), '/') AS l FROM urls) "
    "SELECT page_id, CASE WHEN len(l) >= 2 THEN l[1] END AS owner, CASE WHEN len(l) >= 2 THEN l[2] END AS name FROM s",
)
def repo_owner_name(spark, sf_dir):
    found = _urls(spark, sf_dir).select("page_id", urls.repo_owner_name("u").alias("r"))
    return found.select("page_id", "r.owner", "r.name")


@query(
    "fmt_commit_date",
    "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') || ' UTC' AS shown FROM orders",
)
def fmt_commit_dates(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", fmt_commit_date(F.col("o_orderdate").cast("timestamp")).alias("shown"))


RAW_DOMAIN = (
    "CASE page_id % 4 WHEN 0 THEN concat(upper(split_part(url, '/', 3)), ':8080/x') WHEN 1 THEN url "
    "WHEN 2 THEN concat('www.', split_part(url, '/', 3)) ELSE split_part(url, '/', 3) END"
)
CLEAN_DOMAIN_SQL = (
    "split_part(split_part(replace(replace(replace(lower(d), 'www.', ''), 'http://', ''), 'https://', ''), '/', 1), ':', 1)"
)


def _raw_domains(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.expr(RAW_DOMAIN).alias("d"))


@query("clean_domain", f"SELECT page_id, {CLEAN_DOMAIN_SQL} AS host FROM (SELECT page_id, {RAW_DOMAIN} AS d FROM pages)")
def clean_domain(spark, sf_dir):
    return _raw_domains(spark, sf_dir).select("page_id", domains.clean_domain("d").alias("host"))


@query(
    "domain_label",
    f"SELECT page_id, split_part({CLEAN_DOMAIN_SQL}, '.', 1) AS label FROM (SELECT page_id, {RAW_DOMAIN} AS d FROM pages)",
)
def domain_label(spark, sf_dir):
    return _raw_domains(spark, sf_dir).select("page_id", domains.domain_label("d").alias("label"))


# --- URL mining -------------------------------------------------------------

DOMAIN = "example.com"
MINED_SQL = (
    cte("page_texts")
    + r", found AS (SELECT page_id, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM (SELECT page_id, "
    r"regexp_extract_all(text, 'https?://(?:([0-9a-z\-\.]+)\.)?example\.com', 0) AS m FROM page_texts)) "
)
STRIPPED = "replace(replace(m, 'https://', ''), 'http://', '')"


def _page_texts(spark, sf_dir):
    return relation(spark, sf_dir, "page_texts")


def _first_seen(value: str, out: str) -> str:
    return (
        MINED_SQL
        + f", firsts AS (SELECT page_id, {value} AS v, min(i) AS i FROM found GROUP BY ALL) "
        + f"SELECT t.page_id, coalesce(string_agg(v, ' ' ORDER BY i), '') AS {out} FROM page_texts t LEFT JOIN firsts f "
        "ON f.page_id = t.page_id GROUP BY t.page_id"
    )


@query("extract_urls", _first_seen("m", "urls"))
def extract_urls(spark, sf_dir):
    return _page_texts(spark, sf_dir).select(
        "page_id", F.array_join(domains.extract_urls("text", DOMAIN), " ").alias("urls")
    )


@query("extract_subdomains", _first_seen(STRIPPED, "hosts"))
def extract_subdomains(spark, sf_dir):
    return _page_texts(spark, sf_dir).select(
        "page_id", F.array_join(domains.extract_subdomains("text", DOMAIN), " ").alias("hosts")
    )


@query(
    "subdomain_inventory",
    MINED_SQL
    + f"SELECT {STRIPPED} AS subdomain, count(DISTINCT page_id) AS n_files, count(*) AS n_occurrences, "
    "min(page_id) AS first_seen, max(page_id) AS last_seen FROM found GROUP BY 1",
)
def subdomain_inventory(spark, sf_dir):
    return paths.subdomain_inventory(
        _page_texts(spark, sf_dir), DOMAIN, file_key="page_id", seen_at="page_id"
    )


@query(
    "unique_values",
    "WITH w AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM "
    "(SELECT doc_id, string_split(text, ' ') AS l FROM documents)), f AS (SELECT doc_id, v, min(i) AS i FROM w GROUP BY ALL) "
    "SELECT doc_id, count(*) AS n_values, sha256(string_agg(v, ' ' ORDER BY i)) AS values_sha FROM f GROUP BY doc_id",
)
def unique_values(spark, sf_dir):
    words = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.array_distinct(F.split("text", " ")).alias("v")
    )
    return words.select(
        "doc_id",
        F.size("v").cast("bigint").alias("n_values"),
        F.sha2(F.array_join("v", " "), 256).alias("values_sha"),
    )


# --- filters ----------------------------------------------------------------


@query(
    "domain_search",
    cte("page_texts")
    + "SELECT page_id FROM page_texts WHERE contains(lower(text), 'example.com') AND "
    f"{EXT_SQL.format('''split_part(path, '/', -1)''')} IN ('.html')",
)
def domain_search(spark, sf_dir):
    found = paths.domain_search(_page_texts(spark, sf_dir), "Example.com", [" ..HTML", "."])
    return found.select("page_id")


@query(
    "domain_search_all",
    cte("page_texts") + "SELECT page_id, path FROM page_texts WHERE contains(lower(text), 'tiontion.example.com')",
)
def domain_search_all(spark, sf_dir):
    return paths.domain_search(_page_texts(spark, sf_dir), "tiontion.example.com").select("page_id", "path")


RAW_VALID = "CASE page_id % 3 WHEN 0 THEN split_part(url, '/', 3) ELSE replace(split_part(url, '/', 3), '.', '') END"


@query("valid_domain", f"SELECT page_id, contains({RAW_VALID}, '.') AS is_valid FROM pages")
def valid_domain(spark, sf_dir):
    d = read_table(spark, sf_dir, "pages").select("page_id", F.expr(RAW_VALID).alias("d"))
    return d.select("page_id", domains.valid_domain("d").alias("is_valid"))


EXT_OPTIONS = {
    "neither": (None, None),
    "html_only": ([" .HTML "], None),
    "empty_include": ([], ["html"]),
    "extensionless": ([""], None),
    "no_html": (None, ["html", ".gz"]),
    "both": (["html", ".gz"], ["html"]),
}
EXT_TESTS = {
    "neither": "true",
    "html_only": "e IN ('.html')",
    "empty_include": "true",
    "extensionless": "e IN ('')",
    "no_html": "e NOT IN ('.html', '.gz')",
    "both": "e IN ('.html', '.gz') AND e NOT IN ('.html')",
}
PATH_EXT_SQL = EXT_SQL.format("split_part(p, '/', -1)")


@query(
    "ext_filter",
    URL_CTES
    + "SELECT page_id, "
    + ", ".join(f"{t} AS {n}" for n, t in EXT_TESTS.items())
    + f" FROM (SELECT page_id, {PATH_EXT_SQL} AS e FROM pathed)",
)
def ext_filter(spark, sf_dir):
    return _urls(spark, sf_dir).select(
        "page_id", *[urls.ext_allowed("u", inc, exc).alias(n) for n, (inc, exc) in EXT_OPTIONS.items()]
    )


@query(
    "ext_filter_rows",
    URL_CTES + f"SELECT page_id FROM (SELECT page_id, {PATH_EXT_SQL} AS e FROM pathed) WHERE e IN ('.html', '.gz')",
)
def ext_filter_rows(spark, sf_dir):
    return paths.ext_filter(_urls(spark, sf_dir), ["html", "gz"], url_col="u").select("page_id")


@query(
    "ext_filter_array",
    URL_CTES + f"SELECT page_id, CASE WHEN e NOT IN ('.html') THEN u ELSE '' END AS kept FROM (SELECT page_id, u, {PATH_EXT_SQL} AS e FROM pathed)",
)
def ext_filter_array(spark, sf_dir):
    kept = urls.filter_files(F.array("u"), None, ["html"])
    return _urls(spark, sf_dir).select("page_id", F.array_join(kept, ",").alias("kept"))


ENTRY_TYPE = "CASE WHEN doc_id % 10 = 0 THEN 'tree' ELSE 'blob' END"
ENTRY_PATH = "CASE WHEN doc_id % 13 <> 0 THEN path END"
ENTRY_SHA = "CASE WHEN doc_id % 17 <> 0 THEN sha END"


@query(
    "blob_only",
    cte("docs") + "SELECT repo_url, path, sha FROM docs WHERE doc_id % 10 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0",
)
def blob_only(spark, sf_dir):
    entries = relation(spark, sf_dir, "docs").select(
        "repo_url",
        F.expr(ENTRY_TYPE).alias("type"),
        F.expr(ENTRY_PATH).alias("path"),
        F.expr(ENTRY_SHA).alias("sha"),
    )
    return payloads.blob_only(entries).drop("type")


WORDS_SQL = "[" + ", ".join(quote(w) for w in eligibility.SKIP_WORDS) + "]"


def _first_word(text: str) -> str:
    return f"list_filter({WORDS_SQL}, lambda w: contains(lower({text}), w))[1]"


def _first_token(text: str) -> str:
    return f"list_filter({WORDS_SQL}, lambda w: list_contains(string_split_regex(lower({text}), '[^a-z0-9]+'), w))[1]"


def _verdict_sql(first) -> str:
    likely = " (likely documentation/report/analysis repo)"
    return (
        cte("metadata")
        + f", w AS (SELECT *, {first('name')} AS nw, {first('description')} AS dw, {first('topic1')} AS w1, "
        f"{first('topic2')} AS w2, contains(lower(owner), 'example') AS same FROM metadata)"
        + ", v AS (SELECT p_partkey, CASE WHEN nw IS NOT NULL THEN 'name' WHEN same THEN 'owner' WHEN dw IS NOT NULL THEN 'description' "
        "WHEN w1 IS NOT NULL OR w2 IS NOT NULL THEN 'topic' WHEN is_archived THEN 'archived' END AS reason_class, "
        f"CASE WHEN nw IS NOT NULL THEN concat('Repository name contains ''', nw, '''{likely}') "
        "WHEN same THEN concat('Repository owner ''', lower(owner), ''' matches domain ''Example.com'' (likely same company)') "
        f"WHEN dw IS NOT NULL THEN concat('Repository description contains ''', dw, '''{likely}') "
        "WHEN w1 IS NOT NULL THEN concat('Repository topic ''', topic1, ''' indicates it''s a ', w1, ' repository') "
        "WHEN w2 IS NOT NULL THEN concat('Repository topic ''', topic2, ''' indicates it''s a ', w2, ' repository') "
        "WHEN is_archived THEN 'Repository is archived' END AS reason FROM w) "
    )


def _metadata(spark, sf_dir):
    return relation(spark, sf_dir, "metadata").withColumn("topics", F.array("topic1", "topic2"))


VERDICT_COLS = "SELECT p_partkey, reason IS NULL AS should_scan, reason_class, reason FROM v"


@query("should_scan_repo", _verdict_sql(_first_word) + VERDICT_COLS)
def should_scan_repo(spark, sf_dir):
    out = eligibility.should_scan_repo(_metadata(spark, sf_dir), "Example.com")
    return out.select("p_partkey", "should_scan", "reason_class", "reason")


@query("should_scan_repo_token", _verdict_sql(_first_token) + VERDICT_COLS)
def should_scan_repo_token(spark, sf_dir):
    out = eligibility.should_scan_repo(_metadata(spark, sf_dir), "Example.com", match="token")
    return out.select("p_partkey", "should_scan", "reason_class", "reason")


@query(
    "skip_summary",
    _verdict_sql(_first_word)
    + "SELECT coalesce(reason_class, 'scanned') AS reason_class, count(*) AS n_repos FROM v GROUP BY 1",
)
def skip_summary(spark, sf_dir):
    return eligibility.skip_summary(eligibility.should_scan_repo(_metadata(spark, sf_dir), "Example.com"))


@query("interesting_path", cte("docs") + f", {TREE_SQL} SELECT repo_url, path FROM tree WHERE keep")
def interesting_path(spark, sf_dir):
    return paths.interesting_path(relation(spark, sf_dir, "docs").select("repo_url", "path"))


@query(
    "skipped_files",
    cte("docs")
    + f", {TREE_SQL} SELECT repo_url, 'repository' AS section, count(*) AS n_files, count_if(NOT keep) AS n_skipped, NULL AS ext FROM tree GROUP BY repo_url "
    "UNION ALL SELECT DISTINCT repo_url, 'extensions', NULL, NULL, ext FROM tree WHERE NOT keep",
)
def skipped_files(spark, sf_dir):
    return paths.skipped_files(relation(spark, sf_dir, "docs").select("repo_url", "path"))


@query(
    "cap_files",
    cte("docs")
    + f", {TREE_SQL} SELECT repo_url, path FROM tree WHERE keep QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY path) <= 10",
)
def cap_files(spark, sf_dir):
    tree = paths.interesting_path(relation(spark, sf_dir, "docs").select("repo_url", "path"))
    return paths.cap_files(tree, 10)


# --- fetch log --------------------------------------------------------------


def _fetch_log(spark, sf_dir):
    return relation(spark, sf_dir, "fetch_log")


LIMITED_SQL = "(status = 429 OR (status = 403 AND (contains(body, 'rate limit') OR contains(body, 'X-RateLimit-Remaining'))))"


@query("is_rate_limited", cte("fetch_log") + f"SELECT event_id, {LIMITED_SQL} AS limited FROM fetch_log")
def is_rate_limited(spark, sf_dir):
    return _fetch_log(spark, sf_dir).select("event_id", health.is_rate_limited().alias("limited"))


@query(
    "http_error_counts",
    cte("fetch_log")
    + ", e AS (SELECT CASE WHEN status IN (401, 403, 404, 422, 429, 500, 503) THEN CAST(status AS VARCHAR) ELSE 'other' END AS b "
    "FROM fetch_log WHERE status NOT BETWEEN 200 AND 299) "
    "SELECT b AS bucket, CASE b WHEN '401' THEN 'Unauthorized' WHEN '403' THEN 'Forbidden' WHEN '404' THEN 'Not Found' "
    "WHEN '422' THEN 'Unprocessable Entity' WHEN '429' THEN 'Rate Limit Exceeded' WHEN '500' THEN 'Internal Server Error' "
    "WHEN '503' THEN 'Service Unavailable' ELSE 'Other Errors' END AS label, count(*) AS n FROM e GROUP BY b "
    "UNION ALL SELECT 'total', 'Total HTTP Errors', count(*) FROM e",
)
def http_error_counts(spark, sf_dir):
    return health.http_error_counts(_fetch_log(spark, sf_dir))


@query(
    "outcome_counts",
    cte("fetch_log")
    + f"SELECT call, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN {LIMITED_SQL} THEN 'rate_limited' WHEN call <> 'search' THEN 'error' "
    "WHEN status = 403 THEN 'forbidden' WHEN status = 401 THEN 'unauthorized' WHEN status = 422 THEN 'invalid_query' "
    "ELSE 'page_skipped' END AS outcome, count(*) AS n FROM fetch_log GROUP BY ALL",
)
def outcome_counts(spark, sf_dir):
    return health.outcome_counts(_fetch_log(spark, sf_dir))


# --- repository relations ---------------------------------------------------


def _hits(spark, sf_dir):
    return relation(spark, sf_dir, "hits")


DEDUP_SQL = "dedup AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY page, pos DESC) = 1)"
HIT_COLS = ["repo_url", "repo_name", "owner_url", "page", "pos", "file_url"]


@query("dedup_repo", cte("hits") + f", {DEDUP_SQL} SELECT {', '.join(HIT_COLS)} FROM dedup")
def dedup_repo(spark, sf_dir):
    return repos.dedup_repo(_hits(spark, sf_dir)).select(*HIT_COLS)


@query("unique_repo_count", cte("hits") + "SELECT count(DISTINCT repo_url) AS n_repos FROM hits")
def unique_repo_count(spark, sf_dir):
    return repos.unique_repo_count(_hits(spark, sf_dir))


def _stop_sql(per_page: int, max_results: int, max_repos: int) -> str:
    return (
        cte("hits")
        + ", firsts AS (SELECT repo_url, min(page) AS page FROM hits GROUP BY repo_url)"
        + ", gained AS (SELECT h.page, count(*) AS kept, count(DISTINCT h.repo_url) AS new_repos FROM hits h "
        "JOIN firsts f ON f.repo_url = h.repo_url AND f.page = h.page GROUP BY h.page)"
        + ", sizes AS (SELECT page, count(*) AS n_items FROM hits GROUP BY page)"
        + ", totals AS (SELECT s.page, n_items, coalesce(kept, 0) AS kept, coalesce(new_repos, 0) AS new_repos, "
        "CAST(sum(coalesce(kept, 0)) OVER (ORDER BY s.page) AS BIGINT) AS total_kept, "
        "CAST(sum(coalesce(new_repos, 0)) OVER (ORDER BY s.page) AS BIGINT) AS total_repos FROM sizes s LEFT JOIN gained g ON g.page = s.page)"
        + f", stop AS (SELECT min(page) AS last FROM totals WHERE n_items < {per_page} OR total_kept >= {max_results} OR total_repos >= {max_repos}) "
    )


@query(
    "page_stop",
    _stop_sql(100, 1000, 10**9) + "SELECT totals.*, coalesce(page <= last, true) AS is_read FROM totals, stop",
)
def page_stop(spark, sf_dir):
    return repos.page_stop(_hits(spark, sf_dir), max_results=repos.SEARCH_RESULTS)


@query(
    "limit_repos",
    cte("hits")
    + f", {DEDUP_SQL} SELECT repo_url, page, pos, CAST(row_number() OVER (ORDER BY page, pos, repo_url) - 1 AS BIGINT) AS position FROM dedup "
    "ORDER BY page, pos, repo_url LIMIT 20",
)
def limit_repos(spark, sf_dir):
    return _emitted(repos.limit_repos(_hits(spark, sf_dir), 20)).select("repo_url", "page", "pos", F.col("at").alias("position"))


@query(
    "limit_repos_page",
    _stop_sql(100, 1000, 20)
    + f", read AS (SELECT hits.* FROM hits, stop WHERE page <= coalesce(last, page)), {DEDUP_SQL.replace('FROM hits', 'FROM read')} "
    "SELECT repo_url, page, pos FROM dedup",
)
def limit_repos_page(spark, sf_dir):
    found = repos.limit_repos(_hits(spark, sf_dir), 20, mode="page", max_results=repos.SEARCH_RESULTS)
    return found.select("repo_url", "page", "pos")


# Two searches over the same pages, the second without the first repositories.
SEARCHES_SQL = cte("hits") + ", searches AS (SELECT 'a' AS q, * FROM hits UNION ALL SELECT 'b', * FROM hits WHERE page_id % 3 <> 0)"


@query(
    "limit_repos_keys",
    SEARCHES_SQL
    + ", d AS (SELECT * FROM searches QUALIFY row_number() OVER (PARTITION BY q, repo_url ORDER BY page, pos DESC) = 1)"
    + ", exact AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY page, pos, repo_url) <= 7)"
    + ", firsts AS (SELECT q, repo_url, min(page) AS page FROM searches GROUP BY ALL)"
    + ", sizes AS (SELECT q, page, count(*) AS n FROM searches GROUP BY ALL)"
    + ", totals AS (SELECT s.q, s.page, n, sum((SELECT count(*) FROM firsts f WHERE f.q = s.q AND f.page = s.page)) OVER (PARTITION BY s.q ORDER BY s.page) AS known FROM sizes s)"
    + ", stop AS (SELECT q, min(page) AS last FROM totals WHERE n < 60 OR known >= 7 GROUP BY q)"
    + " SELECT 'exact' AS mode, q, repo_url, page, pos FROM exact UNION ALL "
    "SELECT 'page', d.q, repo_url, d.page, pos FROM d LEFT JOIN stop ON stop.q = d.q WHERE d.page <= coalesce(last, d.page)",
)
def limit_repos_keys(spark, sf_dir):
    """Limits of several searches at once, in both modes."""
    hits = _hits(spark, sf_dir)
    both = hits.withColumn("q", F.lit("a")).unionByName(hits.filter("page_id % 3 <> 0").withColumn("q", F.lit("b")))
    out = [
        repos.limit_repos(both, 7, mode=mode, keys=["q"], per_page=60).select(F.lit(mode).alias("mode"), "q", "repo_url", "page", "pos")
        for mode in ("exact", "page")
    ]
    return out[0].unionByName(out[1])


@query(
    "repo_rollup",
    cte("hits")
    + "SELECT repo_url, 'repository' AS section, count(DISTINCT file_url) AS n_files, NULL AS file FROM hits GROUP BY repo_url "
    "UNION ALL SELECT DISTINCT repo_url, 'files', NULL, file_url FROM hits",
)
def repo_rollup(spark, sf_dir):
    return repos.repo_rollup(_hits(spark, sf_dir), path="file_url")


@query(
    "anti_seen",
    cte("hits") + "SELECT page_id, repo_url FROM hits WHERE repo_url NOT IN (SELECT repo_url FROM hits WHERE page = 1)",
)
def anti_seen(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return repos.anti_seen(hits, hits.filter("page = 1")).select("page_id", "repo_url")


# Three runs that see overlapping parts of the documents, the last all of them.
RUNS = ("lang = 'en'", "doc_id % 2 = 0", "true")
RUNS_SQL = (
    cte("docs")
    + ", seen AS (SELECT repo_url, sha, min(CASE "
    + " ".join(f"WHEN {when} THEN {i}" for i, when in enumerate(RUNS))
    + " END) AS first_run FROM docs GROUP BY repo_url, sha), visits AS ("
    + " UNION ALL ".join(f"SELECT {i} AS run, repo_url, path, sha FROM docs WHERE {when}" for i, when in enumerate(RUNS))
    + ") SELECT run, repo_url, path, sha FROM visits JOIN seen USING (repo_url, sha) WHERE run = first_run"
)


@query("anti_seen_runs", RUNS_SQL)
def anti_seen_runs(spark, sf_dir):
    """What each of three runs has to scan, given what the ledger holds of the runs before."""
    files = relation(spark, sf_dir, "docs")
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    results = new_folder(spark, "unseen")
    for run, when in enumerate(RUNS):
        new = ledger.unseen(files.filter(when))
        new.select(F.lit(run).alias("run"), "repo_url", "path", "sha").write.mode("append").parquet(results)
        ledger.record(files.filter(when), f"run-{run}")
    return spark.read.parquet(results)


def _commits(spark, sf_dir):
    return relation(spark, sf_dir, "commits").withColumn("committed_at", F.col("committed_at").cast("timestamp"))


@query(
    "agg_last_commit",
    cte("commits")
    + "SELECT repo_url, '' AS path, strftime(max(committed_at), '%Y-%m-%d %H:%M:%S') AS last_commit FROM commits GROUP BY repo_url "
    "UNION ALL SELECT repo_url, path, strftime(max(committed_at), '%Y-%m-%d %H:%M:%S') FROM commits GROUP BY repo_url, path",
)
def agg_last_commit(spark, sf_dir):
    commits = _commits(spark, sf_dir)
    per_file = repos.last_commit_per_file(commits)
    per_repo = repos.newest_per_repo(per_file)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("last_commit")
    return per_repo.select("repo_url", F.lit("").alias("path"), shown("last_commit_repo")).unionByName(
        per_file.select("repo_url", "path", shown("last_commit_file"))
    )


DATED_SQL = (
    cte("commits", "commit_repos")
    + ", rd AS (SELECT repo_url, max(committed_at) AS t FROM commits GROUP BY repo_url)"
    + ", fd AS (SELECT repo_url, path, max(committed_at) AS t FROM commits GROUP BY repo_url, path)"
    + f", dated AS (SELECT c_custkey, r.repo_url, r.path, coalesce(rd.t, TIMESTAMP '{RUN_TS}') AS repo_at, "
    f"coalesce(fd.t, TIMESTAMP '{RUN_TS}') AS file_at, rd.t IS NULL OR fd.t IS NULL AS date_missing FROM commit_repos r "
    "LEFT JOIN rd ON rd.repo_url = r.repo_url LEFT JOIN fd ON fd.repo_url = r.repo_url AND fd.path = r.path) "
)


def _dated(spark, sf_dir):
    per_file = repos.last_commit_per_file(_commits(spark, sf_dir))
    return repos.join_commit_dates(
        relation(spark, sf_dir, "commit_repos"), repos.newest_per_repo(per_file), per_file, RUN_TS
    )


@query(
    "join_commit_dates",
    DATED_SQL
    + "SELECT c_custkey, repo_url, path, strftime(repo_at, '%d/%m/%Y %H:%M:%S') || ' UTC' AS repo_date, "
    "strftime(file_at, '%d/%m/%Y %H:%M:%S') || ' UTC' AS file_date, date_missing FROM dated",
)
def join_commit_dates(spark, sf_dir):
    return _dated(spark, sf_dir).select(
        "c_custkey",
        "repo_url",
        "path",
        fmt_commit_date("last_commit_repo").alias("repo_date"),
        fmt_commit_date("last_commit_file").alias("file_date"),
        "date_missing",
    )


def _emitted(df):
    """Rows with their place in the order in which ``df`` emits them."""
    return df.withColumn("at", F.monotonically_increasing_id())


@query(
    "sort_repos",
    DATED_SQL
    + "SELECT DISTINCT repo_url, strftime(file_at, '%Y-%m-%d') AS file_date, CAST(dense_rank() OVER (ORDER BY file_at DESC, repo_url) AS BIGINT) AS position "
    "FROM dated",
)
def sort_repos(spark, sf_dir):
    """Places by the emitted order: rows are numbered as they come, then places counted."""
    rows = _emitted(repos.sort_repos(_dated(spark, sf_dir)).select("repo_url", "last_commit_file"))
    first = rows.groupBy("repo_url", "last_commit_file").agg(F.min("at").alias("at"))
    # Numbers grow with the emitted order; the running count only ranks them.
    ranked = running_totals(first.withColumn("one", F.lit(1)), [], "at", {"position": "one"}, block=1 << 33)
    return ranked.select("repo_url", F.date_format("last_commit_file", "yyyy-MM-dd").alias("file_date"), "position")


@query(
    "sort_repos_top",
    DATED_SQL
    + "SELECT repo_url, strftime(repo_at, '%Y-%m-%d') AS repo_date, CAST(row_number() OVER (ORDER BY repo_at, repo_url) - 1 AS BIGINT) AS position "
    "FROM (SELECT DISTINCT repo_url, repo_at FROM dated) ORDER BY repo_at, repo_url LIMIT 50",
)
def sort_repos_top(spark, sf_dir):
    """The 50 repositories with the oldest last commit, with the places at which they are emitted."""
    distinct = _dated(spark, sf_dir).select("repo_url", "last_commit_repo").distinct()
    top = repos.sort_repos(distinct, commit_date="Repo", sort="ASC", limit=50)
    # The limited rows are one partition, in order.
    return _emitted(top).select("repo_url", F.date_format("last_commit_repo", "yyyy-MM-dd").alias("repo_date"), F.col("at").alias("position"))


SHARE_SQL = (
    "share AS (SELECT repo_url, lang, b AS bytes, round(b * 100.0 / CAST(sum(b) OVER (PARTITION BY repo_url) AS DOUBLE), 2) AS pct FROM "
    "(SELECT repo_url, lang, CAST(sum(n_chars) AS BIGINT) AS b FROM docs GROUP BY ALL))"
)


def _languages(spark, sf_dir):
    return relation(spark, sf_dir, "docs").select("repo_url", "lang", F.col("n_chars").alias("bytes"))


@query("language_share", cte("docs") + f", {SHARE_SQL} SELECT * FROM share")
def language_share(spark, sf_dir):
    return repos.language_share(_languages(spark, sf_dir))


# Repositories of hits that have no languages keep a row.
LANG_REPOS = "SELECT DISTINCT concat('https://github.com/org/src', {0}) AS repo_url FROM documents"


@query(
    "join_languages",
    cte("docs")
    + f", {SHARE_SQL}, r AS ({LANG_REPOS.format('CAST(doc_id % 30 AS VARCHAR)')}) "
    "SELECT r.repo_url, lang, bytes, pct FROM r LEFT JOIN share USING (repo_url)",
)
def join_languages(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://github.com/org/src"), (F.col("doc_id") % 30).cast("string")).alias("repo_url")
    )
    return repos.join_languages(wanted.distinct(), _languages(spark, sf_dir))


@query(
    "join_metadata",
    cte("metadata")
    + ", m AS (SELECT owner, split_part(repo_url, '/', -1) AS name, p_partkey, is_archived FROM metadata WHERE p_partkey % 4 <> 0) "
    "SELECT r.repo_url, r.owner, split_part(r.repo_url, '/', -1) AS name, m.p_partkey AS meta_key, m.is_archived FROM metadata r "
    "LEFT JOIN m ON m.owner = r.owner AND m.name = split_part(r.repo_url, '/', -1)",
)
def join_metadata(spark, sf_dir):
    rows = relation(spark, sf_dir, "metadata")
    metadata = rows.filter("p_partkey % 4 <> 0").select(
        "owner",
        F.substring_index("repo_url", "/", -1).alias("name"),
        F.col("p_partkey").alias("meta_key"),
        "is_archived",
    )
    joined = repos.join_metadata(rows.select("repo_url"), metadata)
    return joined.select("repo_url", "owner", "name", "meta_key", "is_archived")


BLOBS_SQL = (
    "blobs AS (SELECT sha, any_value(text) AS content FROM docs WHERE doc_id % 11 <> 0 GROUP BY sha)"
)


JOINED_SQL = (
    cte("docs")
    + f", {TREE_SQL}, {BLOBS_SQL} SELECT repo_url, path, tree.sha, sha256(content) AS content_sha, "
    "CASE WHEN content IS NULL THEN 'missing_blob' ELSE 'ok' END AS decode_status FROM tree LEFT JOIN blobs ON blobs.sha = tree.sha WHERE keep"
)


def _tree_and_blobs(spark, sf_dir):
    files = relation(spark, sf_dir, "docs")
    landed = spread(files.filter("doc_id % 11 <> 0").select("sha", "text"), "sha").dropDuplicates(["sha"])
    blobs = landed.select(
        "sha", F.lit("base64").alias("encoding"), F.base64(F.col("text").cast("binary")).alias("content")
    )
    return paths.interesting_path(files.select("repo_url", "path", "sha")), blobs


@query("join_tree_blobs", JOINED_SQL)
def join_tree_blobs(spark, sf_dir):
    joined = paths.join_tree_blobs(*_tree_and_blobs(spark, sf_dir))
    return joined.select("repo_url", "path", "sha", F.sha2("content", 256).alias("content_sha"), "decode_status")


@query("join_tree_blobs_bucketed", JOINED_SQL)
def join_tree_blobs_bucketed(spark, sf_dir):
    """Blobs laid out by sha once; the join then reads them in their buckets."""
    tree, blobs = _tree_and_blobs(spark, sf_dir)
    laid_out = Layout.write(blobs, new_folder(spark, "blobs"), 2 * spark.sparkContext.defaultParallelism)
    joined = paths.join_tree_layout(tree, laid_out)
    return joined.select("repo_url", "path", "sha", F.sha2("content", 256).alias("content_sha"), "decode_status")


LIST_FACTS = (
    "concat('2024-', lpad(CAST(page_id % 12 + 1 AS {0}), 2, '0'), '-', lpad(CAST(page_id % 28 + 1 AS {0}), 2, '0'), ' 00:00:00')"
)
LIST_SQL = (
    cte("hits")
    + f", h AS (SELECT *, {LIST_FACTS.format('VARCHAR')} AS day, regexp_replace(split_part(file_url, '?', 1), '.*/', '') AS fname FROM hits)"
    + ", facts AS (SELECT repo_url, min(repo_name) AS repo_name, min(owner_url) AS owner_url, max(day) AS day FROM h GROUP BY repo_url)"
    + f", kept AS (SELECT DISTINCT repo_url, fname, file_url FROM h WHERE {EXT_SQL.format('fname')} NOT IN ('.html'))"
    + ", heads AS (SELECT f.repo_url, 'repository' AS section, repo_name, owner_url, day, count(file_url) AS n_files FROM facts f LEFT JOIN kept k ON k.repo_url = f.repo_url GROUP BY ALL)"
    + ", l AS (SELECT repo_url, section, repo_name, owner_url, day, n_files, NULL AS name, NULL AS url FROM heads "
    "UNION ALL SELECT repo_url, 'files', NULL, NULL, day, NULL, fname, file_url FROM kept JOIN facts USING (repo_url)) "
)
LIST_COLS = ("repo_url", "section", "repo_name", "owner_url", "n_files", "name", "url")


def _list(spark, sf_dir, **options):
    hits = relation(spark, sf_dir, "hits")
    at = F.expr(LIST_FACTS.format("STRING")).cast("timestamp")
    return list_mode(
        hits.withColumns({"last_commit_repo": at, "last_commit_file": at}), exclude_ext=["html"], **options
    )


def _day(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("last_commit")


@query("list_mode", LIST_SQL + f"SELECT {', '.join(LIST_COLS)}, day AS last_commit FROM l")
def list_repositories(spark, sf_dir):
    return _list(spark, sf_dir).select(*LIST_COLS, _day("last_commit_file"))


@query(
    "list_mode_limited",
    LIST_SQL
    + f"SELECT {', '.join(LIST_COLS)}, day AS last_commit FROM l WHERE repo_url IN (SELECT repo_url FROM facts ORDER BY day, repo_url LIMIT 25)",
)
def list_repositories_limited(spark, sf_dir):
    return _list(spark, sf_dir, sort="asc", commit_date="repo", max_repos=25).select(*LIST_COLS, _day("last_commit_repo"))


@query(
    "sink_list_json",
    LIST_SQL + "SELECT repo_url, section, repo_name, CAST(n_files AS VARCHAR) AS n_files, name AS file FROM l",
)
def sink_list_json(spark, sf_dir):
    """Fields read back from the JSON lines of the list."""
    lines = to_json_lines(_list(spark, sf_dir))
    return lines.select(
        F.get_json_object("json", "$.repo_url").alias("repo_url"),
        F.get_json_object("json", "$.section").alias("section"),
        F.get_json_object("json", "$.repo_name").alias("repo_name"),
        F.get_json_object("json", "$.n_files").alias("n_files"),
        F.get_json_object("json", "$.name").alias("file"),
    )


# Search hits of commit repositories, with metadata under owner "c".
FRONT_HITS = (
    "SELECT repo_url, path, CAST(c_custkey // 100 + 1 AS INT) AS page, CAST(c_custkey % 100 AS INT) AS pos FROM commit_repos"
)


@query(
    "search_front",
    DATED_SQL
    + f", fh AS ({FRONT_HITS}), first AS (SELECT * FROM fh QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY page, pos DESC) = 1)"
    + ", top AS (SELECT * FROM first ORDER BY page, pos, repo_url LIMIT 200)"
    + f" SELECT top.repo_url, top.path, 'c' AS owner, split_part(top.repo_url, '/', -1) AS name, strftime(coalesce(rd.t, TIMESTAMP '{RUN_TS}'), '%Y-%m-%d') AS repo_date, "
    f"strftime(coalesce(fd.t, TIMESTAMP '{RUN_TS}'), '%Y-%m-%d') AS file_date, CASE WHEN p_partkey % 20 <> 0 THEN 'main' END AS default_branch, "
    "rd.t IS NULL OR fd.t IS NULL AS date_missing FROM top LEFT JOIN rd USING (repo_url) LEFT JOIN fd ON fd.repo_url = top.repo_url AND fd.path = top.path "
    "LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = split_part(top.repo_url, '/', -1)",
)
def search_front_query(spark, sf_dir):
    """What every mode reads: deduplicated and limited hits with dates and metadata."""
    hits = relation(spark, sf_dir, "commit_repos").select(
        "repo_url", "path", F.expr("int(c_custkey div 100 + 1)").alias("page"), F.expr("int(c_custkey % 100)").alias("pos")
    )
    per_file = repos.last_commit_per_file(_commits(spark, sf_dir))
    metadata = _parts_metadata(spark, sf_dir).select(F.lit("c").alias("owner"), F.col("p_partkey").cast("string").alias("name"), "default_branch")
    front = search_front(hits, repos.newest_per_repo(per_file), per_file, metadata, RUN_TS, max_repos=200)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    return front.select(
        "repo_url", "path", "owner", "name", shown("last_commit_repo").alias("repo_date"), shown("last_commit_file").alias("file_date"), "default_branch", "date_missing"
    )


# --- landed payloads --------------------------------------------------------


def _search_pages(spark, sf_dir):
    """Search responses packed from the hits; every 17th item lacks its owner."""
    item = F.struct(
        F.col("file_url").alias("html_url"),
        F.col("file_api_url").alias("url"),
        F.struct(
            F.col("repo_name").alias("name"),
            F.col("repo_url").alias("html_url"),
            F.concat("file_api_url", F.lit("/commits{/sha}")).alias("commits_url"),
            F.struct(F.when(F.col("page_id") % 17 != 0, F.col("owner_url")).alias("html_url")).alias("owner"),
        ).alias("repository"),
    )
    # At most 100 items make a page.
    paged = _hits(spark, sf_dir).groupBy("page").agg(
        F.count("*").alias("total_count"), F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("i")
    )
    return paged.select(
        "page", F.to_json(F.struct("total_count", F.transform("i", lambda x: x["item"]).alias("items"))).alias("body")
    )


@query(
    "src_search_items",
    cte("hits")
    + "SELECT page, pos, repo_url, repo_name, owner_url, file_url, file_api_url, concat(file_api_url, '/commits') AS commits_url "
    "FROM hits WHERE page_id % 17 <> 0",
)
def src_search_items(spark, sf_dir):
    return payloads.search_items(_search_pages(spark, sf_dir)).select(
        "page", "pos", "repo_url", "repo_name", "owner_url", "file_url", "file_api_url", "commits_url"
    )


@query(
    "src_search_items_quarantine",
    cte("hits") + "SELECT page, pos, 'missing repository.owner.html_url' AS detail FROM hits WHERE page_id % 17 = 0",
)
def src_search_items_quarantine(spark, sf_dir):
    return payloads.search_items_quarantine(_search_pages(spark, sf_dir))


@query(
    "src_repo_tree",
    cte("docs") + "SELECT repo_url, path, sha FROM docs WHERE doc_id % 10 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0",
)
def src_repo_tree(spark, sf_dir):
    entry = F.struct(
        F.expr(ENTRY_TYPE).alias("type"), F.expr(ENTRY_PATH).alias("path"), F.expr(ENTRY_SHA).alias("sha")
    )
    # Payloads of at most 100 entries.
    trees = (
        relation(spark, sf_dir, "docs")
        .groupBy("repo_url", F.expr("doc_id div 100").alias("chunk"))
        .agg(F.to_json(F.struct(F.collect_list(entry).alias("tree"))).alias("body"))
    )
    return payloads.repo_tree(trees)


@query(
    "src_repo_tree_quarantine",
    "SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 END AS INTEGER) AS pos, "
    "CASE WHEN doc_id % 5 = 0 THEN 'missing tree' WHEN doc_id % 5 = 1 THEN 'missing path' ELSE 'missing sha' END AS detail FROM documents WHERE doc_id % 5 < 3",
)
def src_repo_tree_quarantine(spark, sf_dir):
    """Trees of two entries, some without a tree, a path or a sha."""
    kind = F.col("doc_id") % 5
    second = F.struct(
        F.lit("blob").alias("type"), F.when(kind != 1, F.col("source")).alias("path"), F.when(kind != 2, F.col("lang")).alias("sha")
    )
    first = F.struct(F.lit("tree").alias("type"), F.lit(None).cast("string").alias("path"), F.lit("x").alias("sha"))
    body = F.when(kind == 0, '{"message": "Not Found"}').otherwise(F.to_json(F.struct(F.array(first, second).alias("tree"))))
    trees = read_table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return payloads.repo_tree_quarantine(trees, keys=["doc_id"])


BLOB_KIND = "CASE WHEN doc_id % 97 = 1 THEN 'junk' WHEN doc_id % 101 = 1 THEN 'bytes' WHEN doc_id % 103 = 1 THEN 'gone' WHEN doc_id % 3 = 0 THEN 'plain' ELSE 'b64' END"


@query(
    "src_blob_decode",
    f"SELECT doc_id, CASE k WHEN 'junk' THEN 'invalid_base64' WHEN 'bytes' THEN 'invalid_utf8' WHEN 'gone' THEN 'missing_content' ELSE 'ok' END AS decode_status, "
    f"CASE WHEN k IN ('plain', 'b64') THEN sha256(text) END AS content_sha FROM (SELECT doc_id, text, {BLOB_KIND} AS k FROM documents)",
)
def src_blob_decode(spark, sf_dir):
    content = (
        F.when(F.col("k") == "junk", "!!!")
        .when(F.col("k") == "bytes", "/0E=")
        .when(F.col("k") == "plain", F.col("text"))
        .when(F.col("k") == "b64", F.base64(F.col("text").cast("binary")))
    )
    bodies = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn(
        "k", F.expr(BLOB_KIND)
    ).select(
        "doc_id",
        F.to_json(
            F.struct(F.when(F.col("k") == "plain", "utf-8").otherwise("base64").alias("encoding"), content.alias("content"))
        ).alias("body"),
    )
    decoded = payloads.decode_blobs(bodies, keys=["doc_id"])
    return decoded.select("doc_id", "decode_status", F.sha2("content", 256).alias("content_sha"))


@query(
    "src_commit_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'no_commits' WHEN o_orderkey % 50 = 1 THEN 'invalid_date' "
    "WHEN o_orderkey % 50 = 2 THEN 'missing_date' WHEN o_orderkey % 50 = 3 THEN 'invalid_payload' ELSE 'ok' END AS outcome, "
    "CASE WHEN o_orderkey % 50 > 3 THEN strftime(CASE WHEN o_orderkey % 2 = 1 THEN o_orderdate - INTERVAL 2 HOUR ELSE o_orderdate END, "
    "'%Y-%m-%d %H:%M:%S') END AS committed_at FROM orders",
)
def src_commit_date(spark, sf_dir):
    stamp = F.concat(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.col("o_orderkey") % 2 == 1, "+02:00").otherwise("Z"),
    )
    kind = F.col("o_orderkey") % 50
    body = (
        F.when(kind == 0, "[]")
        .when(kind == 1, '[{"commit": {"committer": {"date": "yesterday"}}}]')
        .when(kind == 2, '[{"commit": {"committer": {}}}]')
        .when(kind == 3, "not json")
        .otherwise(F.concat(F.lit('[{"commit": {"committer": {"date": "'), stamp, F.lit('"}}}, {"commit": null}]')))
    )
    bodies = read_table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    dates = payloads.commit_dates(bodies, keys=["o_orderkey"])
    return dates.select("o_orderkey", "outcome", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at"))


def _parts_infos(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.to_json(
            F.struct(
                F.when(F.col("p_partkey") % 20 != 0, "main").alias("default_branch"),
                F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("description"),
                F.when(F.col("p_size") % 5 != 0, F.col("p_size") > 25).alias("archived"),
            )
        ).alias("body"),
    )


def _parts_metadata(spark, sf_dir):
    part, infos = read_table(spark, sf_dir, "part"), _parts_infos(spark, sf_dir)
    names = F.concat(F.lit('{"names": ["'), F.lower("p_type"), F.lit('", 5, null, "'), F.col("p_brand"), F.lit('"]}'))
    topics = part.filter("p_partkey % 7 <> 0").select(
        "p_partkey", F.when(F.col("p_partkey") % 30 == 1, "{bad").otherwise(names).alias("body")
    )
    return payloads.repo_metadata(infos, topics, keys=["p_partkey"])


@query(
    "src_repo_metadata",
    "SELECT p_partkey, 'main' AS default_branch, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS description, "
    "CASE WHEN p_size % 5 <> 0 THEN p_size > 25 ELSE false END AS is_archived, "
    "CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 30 <> 1 THEN concat(lower(p_type), ',', p_brand) ELSE '' END AS topics "
    "FROM part WHERE p_partkey % 20 <> 0",
)
def src_repo_metadata(spark, sf_dir):
    return _parts_metadata(spark, sf_dir).withColumn("topics", F.array_join("topics", ","))


@query(
    "src_repo_metadata_quarantine",
    "SELECT p_partkey, CASE WHEN p_partkey % 60 = 0 THEN 'invalid payload' ELSE 'missing default_branch' END AS detail FROM part WHERE p_partkey % 20 = 0",
)
def src_repo_metadata_quarantine(spark, sf_dir):
    infos = _parts_infos(spark, sf_dir).withColumn("body", F.when(F.col("p_partkey") % 60 == 0, "{bad").otherwise(F.col("body")))
    return payloads.repo_metadata_quarantine(infos, keys=["p_partkey"])


@query(
    "src_repo_languages_quarantine",
    "SELECT doc_id, 'invalid payload' AS detail FROM documents WHERE doc_id % 4 < 2",
)
def src_repo_languages_quarantine(spark, sf_dir):
    kind = F.col("doc_id") % 4
    body = F.when(kind == 0, "not json").when(kind == 1, '{"C": "many"}').when(kind == 2, "{}").otherwise('{"C": 5}')
    maps = read_table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return payloads.repo_languages_quarantine(maps, keys=["doc_id"])


@query("src_default_branch", "SELECT p_partkey, 'main' AS default_branch FROM part WHERE p_partkey % 20 <> 0")
def src_default_branch(spark, sf_dir):
    return payloads.default_branch(_parts_metadata(spark, sf_dir), keys=["p_partkey"])


@query(
    "src_repo_languages",
    cte("docs") + "SELECT repo_url, lang, CAST(sum(n_chars) AS BIGINT) AS bytes FROM docs GROUP BY ALL",
)
def src_repo_languages(spark, sf_dir):
    per_lang = _languages(spark, sf_dir).groupBy("repo_url", "lang").agg(F.sum("bytes").alias("bytes"))
    # One entry per language.
    bodies = per_lang.groupBy("repo_url").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "bytes")))).alias("body")
    )
    return payloads.repo_languages(bodies)


@query(
    "src_raw_content",
    f"SELECT page_id, {CLEAN_SQL} AS file_url, sha256(html) AS text_sha FROM (SELECT page_id, html, concat('\"', url, '\" ') AS u FROM pages)",
)
def src_raw_content(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").withColumn("u", F.concat(F.lit('"'), "url", F.lit('" ')))
    out = payloads.raw_content(pages, url="u", text="html", keys=["page_id"])
    return out.select("page_id", "file_url", F.sha2("text", 256).alias("text_sha"))

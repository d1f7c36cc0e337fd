"""Input relations that the registered queries derive from the supplied tables.

Every relation is defined once as SQL over the tables, with ``{...}`` marks for
the few functions that Spark and DuckDB name differently, so that both sides
read exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SPARK_WORDS = {
    "sha": "sha2({0}, 256)",
    "div": "({0} div {1})",
    "str": "CAST({0} AS STRING)",
    "nl": "'\\n'",
    "each": "transform(array({0}), i -> {1})",
    "join": "array_join({0}, {1})",
}
DUCK_WORDS = {
    "sha": "sha256({0})",
    "div": "({0} // {1})",
    "str": "CAST({0} AS VARCHAR)",
    "nl": "chr(10)",
    "each": "list_transform([{0}], lambda i: {1})",
    "join": "array_to_string({0}, {1})",
}


class _Dialect:
    def __init__(self, words: dict[str, str]):
        self.words = words

    def __call__(self, name: str, *args: str) -> str:
        return self.words[name].format(*args)


SPARK = _Dialect(SPARK_WORDS)
DUCK = _Dialect(DUCK_WORDS)

PATH_ENDS = (".env", ".yaml", ".json", ".py", ".md", ".html", "/config.js", "/Makefile")


def _case(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def docs_sql(d: _Dialect) -> str:
    """Documents as files of repositories: one repository per source."""
    end = _case("doc_id % 8", [f"'{e}'" for e in PATH_ENDS])
    return (
        "SELECT concat('https://github.com/org/', source) AS repo_url, "
        f"concat(lang, '/d', {d('str', 'doc_id % 9')}, '/', {d('str', 'doc_id')}, {end}) AS path, "
        f"text, {d('sha', 'text')} AS sha, doc_id, lang, n_chars FROM documents"
    )


# Lines that fire the rules, one kind per rule and some that must stay silent.
# {h} is a hexadecimal hash of the row; nothing here is a credential by itself.
LINE_KINDS = (
    """concat('<add key="dbPassword" value="', substr({h}, 1, 9), '" />')""",
    """concat('<add key="passwdPMC" value="', substr({h}, 1, 9), '" />')""",
    """concat('<add key="usuarioPMC" value="', substr({h}, 1, 5), '" />')""",
    """concat('<add key="sshostKey" value="', substr({h}, 1, 16), '" />')""",
    "concat('APP_PUBLIC_KEY=', substr({h}, 1, 20))",
    "concat('APP_PRIVATE_KEY: ', substr({h}, 1, 20))",
    "concat('db_password=', name)",
    "concat('a_password=', substr({h}, 1, 8), ' b_passwd=', substr({h}, 9, 9))",
    "concat('db_password=', substr({h}, 1, 3))",
    "concat('aws_access_key_id=', 'AKIA', upper(substr({h}, 1, 16)))",
    "concat('aws_secret_access_key=', substr({h}, 1, 40))",
    "concat('aws_secret_access_key=', substr({h}, 1, 18), '/', substr({h}, 1, 30))",
    "concat('github_token=', 'gh', 'p_', substr({h}, 1, 36))",
    "concat('github_oauth_token=', 'gh', 'o_', substr({h}, 1, 36))",
    "concat('my_api_key=', substr({h}, 1, 24))",
    "concat('apiKey: ', substr({h}, 1, 24))",
    "concat('token=', substr({h}, 1, 24))",
    "concat('jwt_token=', 'ey', 'J', substr({h}, 1, 10), '.', substr({h}, 11, 10), '.', substr({h}, 21, 9))",
    "concat('-----BEGIN ', 'RSA PRIVATE KEY-----')",
    "concat('-----BEGIN ', 'PRIVATE KEY-----')",
    "concat('-----BEGIN ', 'EC PRIVATE KEY-----')",
    "concat('-----BEGIN ', 'OPENSSH PRIVATE KEY-----')",
    "concat('-----BEGIN ', 'PUBLIC KEY-----')",
    "concat('google_api_key=', 'AI', 'za', substr({h}, 1, 35))",
    "concat('google_client_secret=', substr({h}, 1, 24))",
    "concat('stripe_secret_key=', 'sk_', 'live_', substr({h}, 1, 24))",
    "concat('stripe_api_key=', 'sk_', 'test_', substr({h}, 1, 24))",
    "concat('stripe_publishable_key=', 'pk_', 'live_', substr({h}, 1, 24))",
    "concat('slack_token=', 'xo', 'xb-', substr({h}, 1, 12))",
    "concat('discord_bot_token=', substr({h}, 1, 60))",
    "concat('secret_key=', substr({h}, 1, 16))",
    "concat('database_uri=', 'postgres', '://', substr({h}, 1, 5), '@h/db')",
    "concat('credential=', substr({h}, 1, 16))",
    "concat('azure_storage_key=', substr(concat({h}, {h}), 1, 86), '==')",
    "concat('twilio_auth_token=', substr({h}, 1, 32))",
    "concat('twilio_api_key=', substr({h}, 1, 32))",
    "concat('mailgun_api_key=', 'key-', substr({h}, 1, 32))",
    "concat('sendgrid_api_key=', 'SG.', substr({h}, 1, 22), '.', substr(concat({h}, {h}), 1, 43))",
    "concat('example_pattern=', substr({h}, 1, 10))",
    """concat('db_password = os.getenv("DB_', upper(substr({h}, 1, 8)), '")')""",
    "concat('DB_PASSWORD=${{DB_', upper(substr({h}, 1, 8)), '}}')",
    "concat('my_api_key = process.env.', upper(substr({h}, 1, 24)))",
    "concat('1', substr({h}, 1, 4), '_password=', substr({h}, 5, 12), ' x-api-key=', substr({h}, 1, 22))",
    "concat('https://api.example.com/v1 www.example.com ', substr({h}, 1, 8))",
)


def configs_sql(d: _Dialect) -> str:
    """Configuration files with three generated lines each and a URL, from customers and suppliers."""
    kinds = len(LINE_KINDS)
    line = _case("i", [k.format(h="h") for k in LINE_KINDS])
    picks = ["k", "k * 7 + 3", d("div", "k", str(kinds))]
    lines = d("each", ", ".join(f"({p}) % {kinds}" for p in picks), line)
    return (
        "SELECT concat('https://github.com/team', {team}, '/cfg') AS repo_url, "
        "concat('conf/', origin, {key}, '.env') AS path, "
        "concat('see https://', origin, '.example.com/x', {nl}, {joined}) AS text, k FROM ("
        "SELECT 'c' AS origin, c_custkey AS k, c_nationkey AS nat, c_name AS name, {hc} AS h FROM customer UNION ALL "
        "SELECT 's' AS origin, s_suppkey AS k, s_nationkey AS nat, s_name AS name, {hs} AS h FROM supplier)"
    ).format(
        team=d("str", "nat % 20"),
        key=d("str", "k"),
        joined=d("join", lines, d("nl")),
        nl=d("nl"),
        hc=d("sha", "c_name"),
        hs=d("sha", "s_name"),
    )


def hits_sql(d: _Dialect) -> str:
    """Search hits from pages: the host is the repository, 100 hits a page."""
    return (
        "SELECT CAST({p} + 1 AS INT) AS page, CAST(page_id % 100 AS INT) AS pos, "
        "concat('https://github.com/sites/', host) AS repo_url, host AS repo_name, "
        "concat('https://github.com/', split_part(host, '.', 1)) AS owner_url, "
        "concat('https://github.com/sites/', host, '/blob/main/', tail) AS file_url, "
        "concat('https://api.github.com/repos/sites/', host, '/contents/', {id}) AS file_api_url, "
        "page_id, url FROM (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS host, "
        "substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 2) AS tail "
        "FROM pages)"
    ).format(p=d("div", "page_id", "100"), id=d("str", "page_id"))


URL_FORMS = (
    "concat('\"', url, '\" ')",
    "concat('https://github.com/u/r/blob/main/', tail)",
    "concat('https://github.com/u/r/blob/main/x/blob/', tail)",
    "concat('https://raw.githubusercontent.com/u/r/main/', tail)",
    "concat('https://raw.githubusercontent.com/u/', tail)",
    "concat('http://github.com/', host)",
    "concat('https://github.com/u/r/blob/main/d.v1/', {str}, 'Makefile?x=1')",
    "concat(host, '/A.TAR.Gz ')",
)


def urls_sql(d: _Dialect) -> str:
    """URLs of many forms, one per page row."""
    form = _case("page_id % 8", URL_FORMS).replace("{str}", d("str", "page_id"))
    return (
        f"SELECT page_id, {form} AS u FROM (SELECT page_id, url, "
        "split_part(split_part(url, '://', 2), '/', 1) AS host, "
        "substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 2) AS tail "
        "FROM pages)"
    )


def page_texts_sql(d: _Dialect) -> str:
    """Page bodies that hold absolute URLs, repeated and in both schemes."""
    return (
        "SELECT page_id, url, split_part(split_part(url, '?', 1), '#', 1) AS path, "
        "concat(url, ' ', replace(url, 'https://', 'http://'), ' <', url, '> ', html) AS text FROM pages"
    )


STATUSES = (200, 401, 403, 404, 422, 429, 500, 503, 502, 201)
CALLS = ("search", "blob", "tree", "commits")


def fetch_log_sql(d: _Dialect) -> str:
    return (
        f"SELECT event_id, {_case('event_id % 4', [repr(c) for c in CALLS])} AS call, "
        f"concat('https://api.github.com/', {d('str', 'event_id')}) AS url, "
        f"{_case(f'''{d('div', 'event_id', '4')} % 10''', [str(s) for s in STATUSES])} AS status, "
        "CASE event_type WHEN 'error' THEN 'API rate limit exceeded for user' "
        "WHEN 'view' THEN 'X-RateLimit-Remaining: 0' WHEN 'click' THEN 'Rate Limit' ELSE props END AS body "
        "FROM events"
    )


def metadata_sql(d: _Dialect) -> str:
    """Repository metadata from parts, with whole documents as descriptions."""
    return (
        f"SELECT p_partkey, concat('https://github.com/', o, '/', {d('str', 'p_partkey')}) AS repo_url, "
        "o AS owner, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN text END AS description, "
        "lower(p_type) AS topic1, p_brand AS topic2, p_size > 45 AS is_archived "
        "FROM (SELECT part.*, CASE WHEN p_partkey % 7 = 0 THEN concat('My', 'Example', p_brand) "
        "ELSE p_brand END AS o FROM part) p LEFT JOIN documents ON doc_id = p_partkey"
    )


def commits_sql(d: _Dialect) -> str:
    """Commit history: the customer is the repository, the priority the file."""
    return (
        f"SELECT concat('https://github.com/c/', {d('str', 'o_custkey')}) AS repo_url, "
        "o_orderpriority AS path, o_orderdate AS committed_at FROM orders"
    )


def commit_repos_sql(d: _Dialect) -> str:
    """Repositories whose commits are in :func:`commits_sql`, or partly missing."""
    path = _case("c_custkey % 6", ["'1-URGENT'", "'2-HIGH'", "'3-MEDIUM'", "'4-NOT SPECIFIED'", "'5-LOW'", "'none'"])
    return (
        f"SELECT concat('https://github.com/c/', {d('str', 'c_custkey + c_custkey % 3')}) AS repo_url, "
        f"{path} AS path, c_custkey FROM customer"
    )


RELATIONS = {
    "docs": docs_sql,
    "configs": configs_sql,
    "hits": hits_sql,
    "urls": urls_sql,
    "page_texts": page_texts_sql,
    "fetch_log": fetch_log_sql,
    "metadata": metadata_sql,
    "commits": commits_sql,
    "commit_repos": commit_repos_sql,
}

BASE_TABLES = {
    "docs": ("documents",),
    "configs": ("customer", "supplier"),
    "hits": ("pages",),
    "urls": ("pages",),
    "page_texts": ("pages",),
    "fetch_log": ("events",),
    "metadata": ("part", "documents"),
    "commits": ("orders",),
    "commit_repos": ("customer",),
}


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal a test table, one file of one row group, over all cores.

    Tables of many files are read as they lie: their text is not moved.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= slots else df.repartition(slots, *cols)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a DataFrame."""
    from leakatlas.sources.tables import read_table

    frames = {t: read_table(spark, sf_dir, t) for t in BASE_TABLES[name]}
    sql = RELATIONS[name](SPARK)
    # Named DataFrames in SQL text: {documents} refers to the keyword argument.
    for t in frames:
        for lead in ("FROM ", "JOIN "):
            sql = sql.replace(lead + t, f"{lead}__{t}__")
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in frames:
        sql = sql.replace(f"__{t}__", "{" + t + "} AS " + t)
    return spark.sql(sql, **frames)


def cte(*names: str) -> str:
    """``WITH`` clause that defines relations for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n](DUCK)})" for n in names)

"""Searches for all domains of a table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakatlas.operators import domain_table
from leakatlas.sources.tables import read_table

from .inputs import cte, relation, spread
from .registry import query

# The hosts of all pages, the domains above them, a few spellings and names that are no domains.
NAMES_SQL = (
    ", named AS (SELECT page_id, split_part(url, '/', 3) AS host FROM pages)"
    ", names AS (SELECT CASE page_id % 5 WHEN 0 THEN concat('https://WWW.', host, '/x') WHEN 1 THEN host "
    "WHEN 2 THEN substr(host, position('.' IN host) + 1) WHEN 3 THEN split_part(host, '.', 1) ELSE concat(host, ':8080') END AS name FROM named)"
)
HOSTS_SQL = (
    cte("page_texts")
    + NAMES_SQL
    + ", wanted AS (SELECT DISTINCT trim(split_part(split_part(replace(replace(replace(lower(name), 'www.', ''), 'http://', ''), 'https://', ''), '/', 1), ':', 1), '.') AS domain FROM names)"
    + ", domains AS (SELECT domain FROM wanted WHERE contains(domain, '.'))"
    + ", found AS (SELECT page_id, trim(lower(unnest(regexp_extract_all(text, '(?i)https?://([0-9a-z.\\-]+)', 1))), '.') AS host FROM page_texts)"
    + ", per_file AS (SELECT page_id, host, count(*) AS n FROM found WHERE length(host) BETWEEN 1 AND 253 GROUP BY ALL)"
    + ", labels AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM per_file))"
    + ", ends AS (SELECT host, array_to_string(l[i:], '.') AS domain FROM (SELECT host, l, unnest(generate_series(1, len(l))) AS i FROM labels))"
    + ", owned AS (SELECT host, domain FROM ends JOIN domains USING (domain)) "
)


def _inputs(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").withColumn("host", F.expr("split_part(url, '/', 3)"))
    name = F.expr(
        "CASE page_id % 5 WHEN 0 THEN concat('https://WWW.', host, '/x') WHEN 1 THEN host "
        "WHEN 2 THEN substr(host, position('.' IN host) + 1) WHEN 3 THEN split_part(host, '.', 1) ELSE concat(host, ':8080') END"
    )
    return spread(relation(spark, sf_dir, "page_texts"), "page_id"), pages.select(name.alias("domain"))


@query(
    "domains_inventory",
    HOSTS_SQL
    + "SELECT domain, host AS subdomain, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_occurrences FROM owned JOIN per_file USING (host) GROUP BY ALL",
)
def domains_inventory(spark, sf_dir):
    """Sub-domains of every domain that the pages name."""
    return domain_table.domains_inventory(*_inputs(spark, sf_dir), file_key="page_id")


@query(
    "domains_search",
    HOSTS_SQL + "SELECT domain, page_id, CAST(sum(n) AS BIGINT) AS n_urls FROM owned JOIN per_file USING (host) GROUP BY ALL",
)
def domains_search(spark, sf_dir):
    """Pages that hold URLs of each of these domains."""
    return domain_table.domains_search(*_inputs(spark, sf_dir), file_key="page_id")

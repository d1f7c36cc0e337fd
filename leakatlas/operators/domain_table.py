"""Searches for a table of domains: hosts are found once, whatever the number of domains.

A host belongs to a domain if it is the domain or ends with a dot and the domain.
Its label suffixes (``a.b.example.com``, ``b.example.com``, ...) are joined to the
domains by equality, so the join is by hash and no domain costs a pass of its own.
(:func:`.paths.domain_search` looks for one literal anywhere and may match inside
a longer label; here labels are whole.) Hosts are compared in lower case, without
dots at their ends; what is longer than a host name may be is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.domains import clean_domain, valid_domain

HOST_PATTERN = r"(?i)https?://([0-9a-z.\-]+)"
HOST_CHARS = 253  # the longest host name


def hosts(text: Column | str) -> Column:
    """The host of every absolute URL in a text, in order, repeats included."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(c, F.lit(HOST_PATTERN), F.lit(1))
    lower = F.transform(found, lambda h: F.btrim(F.lower(h), F.lit(".")))
    # A match must hold "://".
    return F.when(F.contains(c, F.lit("://")), F.filter(lower, lambda h: F.length(h).between(1, HOST_CHARS)))


def label_suffixes(host: Column | str) -> Column:
    """All endings of a host that begin at a label, the host first."""
    labels = F.split(F.col(host) if isinstance(host, str) else host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def domain_list(domains: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Cleaned, valid, distinct domains; nulls and names without a dot are left out."""
    names = domains.select(F.btrim(clean_domain(domain_col), F.lit(".")).alias("domain"))
    return names.filter(valid_domain("domain")).distinct()


def _per_file(files: DataFrame, file_key: str, text_col: str) -> DataFrame:
    """``_file, host, n``: reduced first, as a host may occur in a third of all rows."""
    found = files.select(F.col(file_key).alias("_file"), F.explode(hosts(text_col)).alias("host"))
    return found.groupBy("_file", "host").agg(F.count("*").alias("n"))


def domains_inventory(files: DataFrame, domains: DataFrame, file_key: str = "path", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """``domain, subdomain, n_files, n_occurrences`` for every domain of a table.

    Hosts are counted over all files first; only distinct hosts meet the domains.
    """
    counted = _per_file(files, file_key, text_col).groupBy("host").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_occurrences"))
    ends = counted.select("*", F.explode(label_suffixes("host")).alias("domain"))
    return ends.join(domain_list(domains, domain_col), "domain").select("domain", F.col("host").alias("subdomain"), "n_files", "n_occurrences")


def domains_search(files: DataFrame, domains: DataFrame, file_key: str = "path", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """``domain, file_key, n_urls``: the files that hold URLs of each domain, without moving texts.

    Which domains a host belongs to is found for distinct hosts; files join that
    by host. A host of very many files is divided by the skew join of the session.
    """
    per_file = _per_file(files, file_key, text_col)
    ends = per_file.select("host").distinct().select("host", F.explode(label_suffixes("host")).alias("domain"))
    wanted = ends.join(domain_list(domains, domain_col), "domain")
    found = per_file.join(wanted, "host").groupBy("domain", "_file").agg(F.sum("n").alias("n_urls"))
    return found.withColumnRenamed("_file", file_key)

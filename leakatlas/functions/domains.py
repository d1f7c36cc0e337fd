"""Domain handling and URL mining inside text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .urls import _col

# What cleaning removes from a domain, and the form of a URL in front of one.
DOMAIN_NOISE = ("www.", "http://", "https://")
URL_FRONT = r"https?://(?:([0-9a-z\-\.]+)\.)?"


def check_domain(domain: str) -> str:
    """Argument check for a search domain: it must contain a dot."""
    if "." not in domain:
        raise ValueError(f"invalid domain {domain!r}: it must contain at least one '.'")
    return domain


def valid_domain(domain: Column | str) -> Column:
    """Column form of :func:`check_domain`."""
    return F.contains(_col(domain), F.lit("."))


def clean_domain(domain: Column | str) -> Column:
    """Lower-case host: no ``www.`` (anywhere), scheme, path or port."""
    d = F.lower(_col(domain))
    for noise in DOMAIN_NOISE:
        d = F.replace(d, F.lit(noise), F.lit(""))
    return F.substring_index(F.substring_index(d, "/", 1), ":", 1)


def domain_label(domain: Column | str) -> Column:
    """Text before the first dot of the cleaned domain (``api`` for ``api.acme.com``)."""
    return F.substring_index(clean_domain(domain), ".", 1)


def _escape_literal(text: str) -> str:
    # Only ASCII punctuation needs escaping; Java rejects escaped letters.
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.ASCII)


def url_pattern(domain: str) -> str:
    """URLs of a domain or its sub-domains, case-sensitive, open to the right."""
    return URL_FRONT + _escape_literal(domain)


def all_urls(text: Column | str, domain: str) -> Column:
    """Every URL match in order, repeats included."""
    c = _col(text)
    hits = F.regexp_extract_all(c, F.lit(url_pattern(domain)), F.lit(0))
    # A match must hold "://<...>domain": skip the regex where the domain is absent.
    return F.when(F.contains(c, F.lit(domain)), hits).when(
        c.isNotNull(), F.array().cast("array<string>")
    )


def extract_urls(text: Column | str, domain: str) -> Column:
    """Distinct URLs of the domain in first-seen order."""
    return F.array_distinct(all_urls(text, domain))


def strip_scheme(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))


def extract_subdomains(text: Column | str, domain: str) -> Column:
    """Distinct host names in first-seen order, schemes removed."""
    return F.array_distinct(F.transform(all_urls(text, domain), strip_scheme))


def mentions_domain(text: Column | str, domain: str) -> Column:
    """Case-insensitive literal test used by the domain search."""
    return F.contains(F.lower(_col(text)), F.lit(domain.lower()))

"""Fetch-log operators: error buckets, outcomes and rate limits.

A fetch log is ``(call, url, status, body, ts)``, one row per response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Named error buckets and their report labels.
ERROR_LABELS = {
    401: "Unauthorized",
    403: "Forbidden",
    404: "Not Found",
    422: "Unprocessable Entity",
    429: "Rate Limit Exceeded",
    500: "Internal Server Error",
    503: "Service Unavailable",
}
OTHER_LABEL = "Other Errors"

# Case-sensitive body marks of a rate limit.
RATE_LIMIT_MARKS = ("rate limit", "X-RateLimit-Remaining")


def is_success(status: Column | str = "status") -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return (s >= 200) & (s < 300)


def is_rate_limited(status: Column | str = "status", body: Column | str = "body") -> Column:
    """Status 429, or 403 with a rate-limit mark in the body."""
    s = F.col(status) if isinstance(status, str) else status
    b = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    marked = F.contains(b, F.lit(RATE_LIMIT_MARKS[0])) | F.contains(b, F.lit(RATE_LIMIT_MARKS[1]))
    return (s == 429) | ((s == 403) & marked)


def error_bucket(status: Column | str = "status") -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.isin(list(ERROR_LABELS)), s.cast("string")).otherwise("other")


def http_error_counts(fetch_log: DataFrame, status: str = "status") -> DataFrame:
    """Failed responses per bucket plus a ``total`` row; empty buckets are absent.

    Output: ``bucket, label, n``. Without any error there is no row at all.
    """
    label = F.lit(OTHER_LABEL)
    for code, text in ERROR_LABELS.items():
        label = F.when(F.col("bucket") == str(code), text).otherwise(label)
    return (
        fetch_log.filter(~is_success(status))
        .select(error_bucket(status).alias("bucket"))
        .rollup("bucket")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("_total"))
        .filter("n > 0")
        .select(
            F.when(F.col("_total") == 1, "total").otherwise(F.col("bucket")).alias("bucket"),
            F.when(F.col("_total") == 1, "Total HTTP Errors").otherwise(label).alias("label"),
            "n",
        )
    )


def fetch_outcome(
    call: Column | str = "call", status: Column | str = "status", body: Column | str = "body"
) -> Column:
    """How a response is handled.

    ``ok`` or ``rate_limited`` for any call; search tells ``forbidden``,
    ``unauthorized``, ``invalid_query`` and ``page_skipped`` apart, the other
    calls know only ``error``.
    """
    c = F.col(call) if isinstance(call, str) else call
    s = F.col(status) if isinstance(status, str) else status
    search = c == "search"
    return (
        F.when(is_success(s), "ok")
        .when(is_rate_limited(s, body), "rate_limited")
        .when(~search, "error")
        .when(s == 403, "forbidden")
        .when(s == 401, "unauthorized")
        .when(s == 422, "invalid_query")
        .otherwise("page_skipped")
    )


def outcome_counts(fetch_log: DataFrame) -> DataFrame:
    """Responses per call and outcome."""
    return (
        fetch_log.select("call", fetch_outcome().alias("outcome"))
        .groupBy("call", "outcome")
        .agg(F.count("*").alias("n"))
    )

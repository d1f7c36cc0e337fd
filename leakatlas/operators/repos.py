"""Repository relations: deduplication, paging, limits, sorting and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.urls import repo_owner_name
from .ranking import first_per_key, running_totals, top_n_per_key
from .records import count_items, distinct_items, with_header

# Page size of a code search, and the results it gives at most.
PER_PAGE = 100
SEARCH_RESULTS = 1_000


def dedup_repo(hits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One hit per repository: the lowest page wins, within it the last item."""
    return first_per_key(hits, [*keys, "repo_url"], [F.col("page").asc(), F.col("pos").desc()])


def unique_repo_count(hits: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return hits.agg(count("repo_url").alias("n_repos"))


def page_stop(
    hits: DataFrame,
    page_sizes: DataFrame | None = None,
    max_repos: int | None = None,
    keys: Sequence[str] = (),
    per_page: int = PER_PAGE,
    max_results: int | None = None,
) -> DataFrame:
    """Which landed pages a paging search would have read.

    After each page the search ends when the page was not full, when
    ``max_results`` items (if given) of new repositories were kept (same-page
    repeats count), or when ``max_repos`` repositories are known. ``page_sizes``
    (``page, n_items``) adds pages without hits; ``keys`` separates searches.

    Output: keys, ``page, n_items, kept, new_repos, total_kept, total_repos,
    is_read``.
    """
    keys = list(keys)
    per_repo_page = hits.groupBy(*keys, "repo_url", "page").agg(F.count("*").alias("n"))
    first_seen = per_repo_page.groupBy(*keys, "repo_url").agg(
        F.min(F.struct("page", "n")).alias("f")
    )
    gained = first_seen.groupBy(*keys, F.col("f.page").alias("page")).agg(
        F.sum("f.n").alias("kept"), F.count("*").alias("new_repos")
    )
    if page_sizes is None:
        page_sizes = per_repo_page.groupBy(*keys, "page").agg(F.sum("n").alias("n_items"))
    pages = page_sizes.join(gained, [*keys, "page"], "left").fillna(0, ["kept", "new_repos"])
    pages = running_totals(
        pages, keys, "page", {"total_kept": "kept", "total_repos": "new_repos"}
    )
    stops = F.col("n_items") < per_page
    if max_results is not None:
        stops = stops | (F.col("total_kept") >= _positive("max_results", max_results))
    if max_repos is not None:
        stops = stops | (F.col("total_repos") >= _positive("max_repos", max_repos))
    last = pages.groupBy(*keys).agg(F.min(F.when(stops, F.col("page"))).alias("_last"))
    # One row per search; without keys a single row.
    joined = pages.join(last, keys) if keys else pages.crossJoin(F.broadcast(last))
    return joined.withColumn(
        "is_read", F.coalesce(F.col("page") <= F.col("_last"), F.lit(True))
    ).drop("_last")


def _positive(name: str, value: int) -> int:
    if int(value) <= 0:
        raise ValueError(f"{name} must be greater than 0")
    return int(value)


def limit_repos(
    hits: DataFrame,
    max_repos: int,
    mode: str = "exact",
    page_sizes: DataFrame | None = None,
    keys: Sequence[str] = (),
    per_page: int = PER_PAGE,
    max_results: int | None = None,
) -> DataFrame:
    """Deduplicated repositories up to ``max_repos`` of each search, in search order.

    ``exact`` returns exactly that many; ``page`` reproduces the paging
    search, which finishes the page on which the limit is reached and so may
    return more. ``keys`` separates searches; without it there is one.
    """
    n, keys = _positive("max_repos", max_repos), list(keys)
    if mode == "exact":
        found, order = dedup_repo(hits, keys), [F.col("page"), F.col("pos"), F.col("repo_url")]
        return top_n_per_key(found, keys, order, n, salt_col="repo_url") if keys else found.orderBy(*order).limit(n)
    if mode != "page":
        raise ValueError(f"unknown limit mode {mode!r}")
    stop = page_stop(hits, page_sizes, n, keys, per_page, max_results)
    read = stop.filter("is_read").select(*keys, "page")
    return dedup_repo(hits.join(read, [*keys, "page"], "left_semi"), keys)


def sort_order(commit_date: str = "file", sort: str = "desc") -> Column:
    """Sort column of the report orders; option values are case-insensitive."""
    kind, direction = commit_date.lower(), sort.lower()
    if kind not in ("file", "repo"):
        raise ValueError(f"invalid commit date kind {commit_date!r}: use 'file' or 'repo'")
    if direction not in ("asc", "desc"):
        raise ValueError(f"invalid sort order {sort!r}: use 'asc' or 'desc'")
    col = F.col(f"last_commit_{kind}")
    return col.asc() if direction == "asc" else col.desc()


def sort_repos(
    repos: DataFrame, commit_date: str = "file", sort: str = "desc", limit: int | None = None
) -> DataFrame:
    """Order by file or repository commit date, ties by ``repo_url``.

    The sort is range-partitioned; with ``limit`` Spark keeps only the top
    rows of each task.
    """
    out = repos.orderBy(sort_order(commit_date, sort), "repo_url")
    return out if limit is None else out.limit(_positive("limit", limit))


def repo_rollup(hits: DataFrame, path: str = "path", keys: Sequence[str] = ("repo_url",)) -> DataFrame:
    """All files of each repository: a header with ``n_files`` and an item ``file`` each."""
    items = hits.select(*keys, F.lit("files").alias("section"), F.col(path).alias("file"))
    items = distinct_items(items, keys)
    return with_header(count_items(items, keys, ["files"]), items, keys)


def anti_seen(new: DataFrame, seen: DataFrame, on: str = "repo_url") -> DataFrame:
    """Rows whose key is not in the state table of earlier runs."""
    return new.join(seen.select(on), on, "left_anti")


# --- commit dates -----------------------------------------------------------


def last_commit_per_file(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_url", "path").agg(F.max("committed_at").alias("last_commit_file"))


def last_commit_per_repo(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_url").agg(F.max("committed_at").alias("last_commit_repo"))


def newest_per_repo(file_dates: DataFrame) -> DataFrame:
    """Repository dates from the dates of all its files, so that commits are read once."""
    return file_dates.groupBy("repo_url").agg(F.max("last_commit_file").alias("last_commit_repo"))


def join_commit_dates(
    repos: DataFrame, repo_dates: DataFrame, file_dates: DataFrame, run_ts: str | Column
) -> DataFrame:
    """Add both last commit dates; an unknown date becomes ``run_ts`` and is flagged.

    Meant for one row per repository (after :func:`dedup_repo`); each date
    table has one row per key.
    """
    now = (F.lit(run_ts) if isinstance(run_ts, str) else run_ts).cast("timestamp")
    joined = repos.join(repo_dates, "repo_url", "left").join(file_dates, ["repo_url", "path"], "left")
    return joined.withColumns(
        {
            "date_missing": F.col("last_commit_repo").isNull() | F.col("last_commit_file").isNull(),
            "last_commit_repo": F.coalesce("last_commit_repo", now),
            "last_commit_file": F.coalesce("last_commit_file", now),
        }
    )


# --- metadata and languages -------------------------------------------------


def with_owner_name(repos: DataFrame, url: str = "repo_url") -> DataFrame:
    r = repo_owner_name(url)
    return repos.withColumns({"owner": r["owner"], "name": r["name"]})


def join_metadata(repos: DataFrame, metadata: DataFrame, url: str = "repo_url") -> DataFrame:
    """Repositories with their metadata; ``owner`` and ``name`` come from the URL."""
    return with_owner_name(repos, url).join(metadata, ["owner", "name"], "left")


def language_share(languages: DataFrame, keys: Sequence[str] = ("repo_url",)) -> DataFrame:
    """Percentage of bytes per language: keys, ``lang, bytes, pct`` (two decimals)."""
    keys = list(keys)
    per_lang = languages.groupBy(*keys, "lang").agg(F.sum("bytes").alias("bytes"))
    # One row per language is left here, so the window groups are small.
    total = F.sum("bytes").over(Window.partitionBy(*keys))
    return per_lang.withColumn("pct", F.round(F.col("bytes") * 100 / total, 2))


def join_languages(
    repos: DataFrame, languages: DataFrame, keys: Sequence[str] = ("repo_url",)
) -> DataFrame:
    """Repositories with one row per language; a repository without any keeps one row."""
    return repos.join(language_share(languages, keys), list(keys), "left")

"""The three ways of running: list, single-file scan and whole-repository scan.

Each builder composes operators into one lazy DataFrame: a row of section
``repository`` per repository and a row per file, finding, environment read,
language or skipped extension. The text column is read and scanned once per
report; it is never shuffled, unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.display import secret_status
from ..functions.urls import clean_file_name, ext_allowed, file_extension
from ..operators import paths, repos as repo_ops
from ..operators.eligibility import should_scan_repo
from ..operators.records import HEADER, count_items, distinct_items, with_header
from ..operators.scan import file_hits
from ..operators.summaries import quiet_filter
from ..rules import Rule, enabled

KEYS = ["repo_url"]
# Order of the sections below a repository.
SECTIONS = (HEADER, "files", "findings", "env_refs", "languages", "skipped_exts")
BROADCAST_REPOS = 100_000  # short urls, a few MB
FINDING_FIELDS = ("line_no", "rule_id", "secret_type", "key_name", "value_sha256", "value_len")
_HIT_TYPE = (
    "struct<line_no int, rule_id int, secret_type string, key_name string, "
    "value_sha256 string, value_len int, is_env_reference boolean>"
)


def search_front(
    hits: DataFrame, repo_dates: DataFrame, file_dates: DataFrame, metadata: DataFrame, run_ts: str | Column, **limits
) -> DataFrame:
    """The part all modes share: one hit per repository, its commit dates, its metadata.

    ``hits`` as the search source gives them, ``metadata`` by ``owner`` and
    ``name``. ``limits`` (``max_repos``, ``mode`` and so on) go to
    :func:`limit_repos`.
    """
    found = repo_ops.limit_repos(hits, **limits) if limits else repo_ops.dedup_repo(hits)
    return repo_ops.join_metadata(repo_ops.join_commit_dates(found, repo_dates, file_dates, run_ts), metadata)


def list_mode(
    hits: DataFrame,
    *,
    include_ext: Iterable[str] | None = None,
    exclude_ext: Iterable[str] | None = None,
    sort: str = "desc",
    commit_date: str = "file",
    max_repos: int | None = None,
) -> DataFrame:
    """Repositories with their matching files, no scan.

    ``hits`` has ``repo_url, repo_name, owner_url, file_url,
    last_commit_repo, last_commit_file``, one row per matching file. A
    repository counts with its newest dates and keeps its row even if the
    extension filter leaves it no file. Items have ``name`` and ``url``.
    """
    header = hits.groupBy("repo_url").agg(
        F.min("repo_name").alias("repo_name"),
        F.min("owner_url").alias("owner_url"),
        F.max("last_commit_repo").alias("last_commit_repo"),
        F.max("last_commit_file").alias("last_commit_file"),
    )
    items = hits.filter(ext_allowed("file_url", include_ext, exclude_ext)).select(
        "repo_url",
        F.lit("files").alias("section"),
        clean_file_name("file_url").alias("name"),
        F.col("file_url").alias("url"),
    )
    header, items = _limited(header, items, max_repos, commit_date, sort)
    return _assembled(header, items, ["files"], sort=sort, commit_date=commit_date)


def _limited(
    header: DataFrame, rows: DataFrame, max_repos: int | None, commit_date: str, sort: str
) -> tuple[DataFrame, DataFrame]:
    """The first ``max_repos`` repositories in report order, and their rows."""
    if max_repos is None:
        return header, rows
    header = header.orderBy(repo_ops.sort_order(commit_date, sort), "repo_url").limit(_positive("max_repos", max_repos))
    # At most max_repos short rows, so no row of the other side moves.
    wanted = header.select("repo_url")
    return header, rows.join(F.broadcast(wanted) if max_repos <= BROADCAST_REPOS else wanted, "repo_url", "left_semi")


def _assembled(
    header: DataFrame,
    items: DataFrame,
    sections: Sequence[str],
    *,
    sort: str,
    commit_date: str,
    require: str | None = None,
    quiet: bool = False,
    status: bool = False,
) -> DataFrame:
    items = distinct_items(items, KEYS)
    counts = [f"n_{s}" for s in sections]
    header = header.join(count_items(items, KEYS, sections), KEYS, "left").fillna(0, counts)
    if require:
        header = header.filter(F.col(f"n_{require}") > 0)
    if "findings" in sections:
        header = header.withColumnRenamed("n_findings", "n_secrets")
        header = quiet_filter(header) if quiet else header
    if status:
        header = header.withColumn("status", secret_status("n_secrets"))
    order = f"last_commit_{commit_date.lower()}"
    rows = with_header(header, items, KEYS, [order])
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    within = [c for c in items.columns if c not in ("repo_url", "section")]
    return rows.orderBy(repo_ops.sort_order(commit_date, sort), "repo_url", rank, *within)


def _positive(name: str, value: int) -> int:
    if int(value) <= 0:
        raise ValueError(f"{name} must be greater than 0")
    return int(value)


def scan_items(
    files: DataFrame,
    rules: Sequence[Rule],
    keys: Sequence[str] = ("repo_url", "path"),
    text_col: str = "text",
    **options,
) -> DataFrame:
    """One pass over the text: a ``files`` item per file and an item per finding.

    Output: keys, ``section`` (``files``, ``findings`` or ``env_refs``),
    ``hit_no`` and the finding columns, NULL on ``files`` items.
    """
    hits = file_hits(text_col, rules, **options)
    return _explode_items(files.select(*keys, hits.alias("_hits")), keys)


def _explode_items(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A ``files`` item and one item per finding from ``(keys, _hits)`` rows."""
    # The NULL element in front stands for the file itself.
    numbered = F.concat(F.array(F.lit(None).cast(_HIT_TYPE)), F.coalesce("_hits", F.array()))
    section = (
        F.when(F.col("h").isNull(), "files")
        .when(F.col("h.is_env_reference"), "env_refs")
        .otherwise("findings")
    )
    return hits.select(*keys, F.posexplode(numbered).alias("hit_no", "h")).select(
        *keys, section.alias("section"), "hit_no", *[F.col(f"h.{c}").alias(c) for c in FINDING_FIELDS]
    )


def single_file_mode(
    files: DataFrame,
    repositories: DataFrame,
    domain: str,
    *,
    languages: DataFrame | None = None,
    rules: Sequence[Rule] | None = None,
    include_disabled: bool = False,
    include_ext: Iterable[str] | None = None,
    sort: str = "desc",
    commit_date: str = "file",
    quiet: bool = False,
    max_repos: int | None = None,
    **scan_options,
) -> DataFrame:
    """Scan only the files that mention the domain.

    ``files`` is ``(repo_url, path, text)``; ``repositories`` has one row per
    repository with ``last_commit_repo``, ``last_commit_file`` and whatever
    else the report should show. ``languages`` is ``(repo_url, lang, bytes)``.
    """
    active = enabled(rules, include_disabled)
    repositories, files = _limited(repositories, files, max_repos, commit_date, sort)
    items = scan_items(paths.domain_search(files, domain, include_ext), active, **scan_options)
    sections = ["files", "findings", "env_refs"]
    if languages is not None:
        share = repo_ops.language_share(languages.join(repositories.select("repo_url"), "repo_url", "left_semi"))
        share = share.select("repo_url", F.lit("languages").alias("section"), "lang", "pct")
        items = items.unionByName(share, allowMissingColumns=True)
    return _assembled(
        repositories, items, sections, sort=sort, commit_date=commit_date, require="files", quiet=quiet, status=True
    )


def whole_repo_mode(
    repositories: DataFrame,
    tree: DataFrame,
    blobs: DataFrame,
    domain: str,
    *,
    rules: Sequence[Rule] | None = None,
    include_disabled: bool = False,
    include_ext: Iterable[str] | None = None,
    max_files: int | None = None,
    match: str = "substring",
    sort: str = "desc",
    commit_date: str = "file",
    quiet: bool = False,
    max_repos: int | None = None,
    prune_blobs: bool = False,
    **scan_options,
) -> DataFrame:
    """Scan the interesting files of every eligible repository.

    ``repositories`` has one row per repository with ``owner, name,
    description, topics, is_archived`` and both commit dates; ``tree`` is
    ``(repo_url, path, sha)``; ``blobs`` is ``(sha, content)``.

    Blobs are scanned where they lie, each once however many repositories
    hold it, and only findings are joined to the tree: content is not
    shuffled. With ``prune_blobs`` only blobs that a wanted path names are
    scanned; unless they are bucketed by sha, that moves content once. With
    ``max_files`` the header says how many files there were (``n_wanted``) and
    whether some were left out (``capped``).
    """
    active = enabled(rules, include_disabled)
    eligible = should_scan_repo(repositories, domain, match).filter("should_scan").drop(
        "should_scan", "reason_class", "reason"
    )
    eligible, tree = _limited(eligible, tree, max_repos, commit_date, sort)
    # Ineligible repositories leave first: what follows is not done for them.
    tree = tree.join(eligible.select("repo_url"), "repo_url", "left_semi")
    wanted = paths.interesting_path(tree)
    exts = paths.search_ext(include_ext)
    if exts:
        wanted = wanted.filter(file_extension("path").isin(exts))
    kept = paths.cap_files(wanted, max_files)
    if max_files is not None:
        sizes = wanted.groupBy("repo_url").agg(F.count("*").alias("n_wanted"))
        eligible = (
            eligible.join(sizes, "repo_url", "left")
            .fillna(0, ["n_wanted"])
            .withColumn("capped", F.col("n_wanted") > max_files)
        )
    if prune_blobs:
        blobs = blobs.join(kept.select("sha").distinct(), "sha", "left_semi")
    # Exploding drops texts without hits and is the only place that holds the scan.
    hits = file_hits("content", active, **scan_options)
    found = blobs.filter("sha IS NOT NULL").select("sha", F.posexplode(hits).alias("hit_no", "h"))
    found = found.select("sha", "hit_no", "h.*").distinct()  # copies of one blob have equal hits
    section = F.when(F.col("is_env_reference"), "env_refs").otherwise("findings")
    findings = kept.join(found, "sha").select("repo_url", "path", section.alias("section"), "hit_no", *FINDING_FIELDS)
    skipped = paths.skipped_extensions(tree).select(
        "repo_url", F.lit("skipped_exts").alias("section"), "ext", F.col("n_files").alias("n_of_ext")
    )
    items = (
        kept.select("repo_url", "path", F.lit("files").alias("section"))
        .unionByName(findings, allowMissingColumns=True)
        .unionByName(skipped, allowMissingColumns=True)
    )
    return _assembled(
        eligible,
        items,
        ["files", "findings", "env_refs"],
        sort=sort,
        commit_date=commit_date,
        quiet=quiet,
        status=True,
    )

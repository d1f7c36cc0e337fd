"""Path filters: domain search, interesting files, caps, trees and blobs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.domains import all_urls, check_domain, mentions_domain, strip_scheme
from ..functions.urls import ext_allowed, file_extension
from ..sources.layout import Layout
from ..sources.payloads import decode_content
from .ranking import top_n_per_key
from .records import with_header

# What a whole-repository scan keeps and drops.
INTERESTING_EXT = (
    ".env", ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".conf", ".properties", ".xml",
)
DROPPED_EXT = (".html", ".csv", ".md")

# A blob with more paths than HOT_FILES, and than a HOT_PARTS-th of all, is joined apart.
HOT_FILES = 100_000
HOT_PARTS = 1_000
HOT_BYTES = 64 << 20
HOT_COPIES = 64


def search_ext(exts: Iterable[str] | None) -> list[str]:
    """Extension qualifiers of a search: no leading dots, lower case, no empties."""
    cleaned = [e.strip().lstrip(".").lower() for e in exts or ()]
    return ["." + e for e in cleaned if e]


def domain_search(
    files: DataFrame,
    domain: str,
    include_ext: Iterable[str] | None = None,
    path_col: str = "path",
    text_col: str = "text",
) -> DataFrame:
    """Files whose content holds the domain, optionally of some extensions only."""
    check_domain(domain)
    exts = search_ext(include_ext)
    found = files.filter(mentions_domain(text_col, domain))
    # Cheap test on the short column; Spark moves it in front of the text test.
    return found.filter(file_extension(path_col).isin(exts)) if exts else found


def ext_filter(
    files: DataFrame,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    url_col: str = "file_url",
) -> DataFrame:
    """Row form of the extension filter, see :func:`ext_allowed`."""
    return files.filter(ext_allowed(url_col, include, exclude))


def is_interesting(
    path: Column | str, keep: Sequence[str] = INTERESTING_EXT, drop: Sequence[str] = DROPPED_EXT
) -> Column:
    """Config-like path: ``.env*``, ``*config*`` or a kept extension, and no dropped one."""
    p = F.col(path) if isinstance(path, str) else path
    base = F.lower(F.substring_index(p, "/", -1))
    ext = file_extension(p)
    likely = base.startswith(".env") | F.contains(base, F.lit("config")) | ext.isin(list(keep))
    return likely & ~ext.isin(list(drop))


def interesting_path(tree: DataFrame, path_col: str = "path", **lists) -> DataFrame:
    return tree.filter(is_interesting(path_col, **lists))


def skipped_extensions(tree: DataFrame, path_col: str = "path", **lists) -> DataFrame:
    """``repo_url, ext, n_files`` of the files that are not interesting."""
    skipped = tree.filter(~is_interesting(path_col, **lists))
    return skipped.groupBy("repo_url", file_extension(path_col).alias("ext")).agg(
        F.count("*").alias("n_files")
    )


def skipped_files(tree: DataFrame, path_col: str = "path", **lists) -> DataFrame:
    """Per repository a header with file and skipped counts, and an item per skipped extension."""
    keep = is_interesting(path_col, **lists)
    per_ext = tree.groupBy("repo_url", F.when(~keep, file_extension(path_col)).alias("ext")).agg(
        F.count("*").alias("n")
    )
    header = per_ext.groupBy("repo_url").agg(
        F.sum("n").alias("n_files"),
        F.coalesce(F.sum(F.when(F.col("ext").isNotNull(), F.col("n"))), F.lit(0)).alias("n_skipped"),
    )
    items = per_ext.filter("ext IS NOT NULL").select(
        "repo_url", F.lit("extensions").alias("section"), "ext"
    )
    return with_header(header, items, ["repo_url"])


def cap_files(tree: DataFrame, max_files: int | None = None, path_col: str = "path") -> DataFrame:
    """At most ``max_files`` files per repository, by path; all without a limit."""
    if max_files is None:
        return tree
    if max_files < 1:
        raise ValueError("max_files must be greater than 0")
    return top_n_per_key(tree, ["repo_url"], [F.col(path_col)], max_files, salt_col=path_col)


def join_tree_blobs(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """Tree rows with their decoded content: ``tree.*, content, decode_status``.

    ``tree`` should be filtered first; ``blobs`` is ``(sha, encoding,
    content)``, one row per sha. Blobs that no tree row needs are dropped
    before they are decoded, and each other one is decoded once. A blob that
    was never landed has ``decode_status`` ``missing_blob``.
    """
    needed = blobs.join(tree.select("sha").distinct(), "sha", "left_semi")
    return tree.join(decode_content(needed), "sha", "left").withColumn(
        "decode_status", F.coalesce("decode_status", F.lit("missing_blob"))
    )


def join_tree_layout(tree: DataFrame | Layout, blobs: Layout) -> DataFrame:
    """:func:`join_tree_blobs` over blobs laid out by sha: they are read in their buckets and not moved.

    Only the narrow tree rows are dealt out, and not even these if the tree is a
    layout of as many buckets. A blob that very many paths hold, an empty file,
    say, would make one bucket of tree rows huge: such rows stay where they are
    and the blob comes to them. There are fewer than ``HOT_PARTS`` such blobs; they
    are broadcast if their contents are small, else copied for parts of the rows.
    """
    laid_out = isinstance(tree, Layout) and (tree.key, tree.buckets) == (blobs.key, blobs.buckets)
    rows = tree.table if isinstance(tree, Layout) else tree
    sizes = rows.filter("sha IS NOT NULL").groupBy("sha").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r.sha for r in sizes.filter(F.col("n") > max(HOT_FILES, total // HOT_PARTS)).select("sha").collect()]
    is_hot = F.coalesce(F.col("sha").isin(hot), F.lit(False))

    cold = rows.filter(~is_hot) if hot else rows
    needed = decode_content(blobs.matching(cold))  # what no row needs is not decoded
    joined = (cold if laid_out else blobs.aligned(cold)).hint("merge").join(needed, "sha", "left")
    if hot:
        rows = rows.filter(is_hot)
        wanted = blobs.table.filter(F.col("sha").isin(hot))
        if (wanted.agg(F.sum(F.octet_length("content"))).first()[0] or 0) <= HOT_BYTES:
            shared = rows.join(F.broadcast(decode_content(wanted)), "sha", "left")
        else:
            part = F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_COPIES)).cast("int")
            copies = decode_content(wanted).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HOT_COPIES - 1))))
            shared = rows.withColumn("_part", part).hint("merge").join(copies, ["sha", "_part"], "left").drop("_part")
        joined = joined.unionByName(shared)
    return joined.withColumn("decode_status", F.coalesce("decode_status", F.lit("missing_blob")))


def subdomain_inventory(
    files: DataFrame,
    domain: str,
    file_key: str = "path",
    text_col: str = "text",
    seen_at: str | None = None,
) -> DataFrame:
    """Sub-domains of a domain over a corpus: files, occurrences, first and last seen."""
    seen = [F.col(seen_at).alias("_seen")] if seen_at else []
    found = files.filter(F.contains(text_col, F.lit(domain))).select(
        F.col(file_key).alias("_file"), *seen, F.explode(all_urls(text_col, domain)).alias("_url")
    )
    # Reduced per file first: a sub-domain may occur in a third of all rows.
    per_file = found.groupBy(strip_scheme(F.col("_url")).alias("subdomain"), "_file").agg(
        F.count("*").alias("n"),
        *([F.min("_seen").alias("lo"), F.max("_seen").alias("hi")] if seen else []),
    )
    return per_file.groupBy("subdomain").agg(
        F.count("*").alias("n_files"),
        F.sum("n").alias("n_occurrences"),
        *([F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen")] if seen else []),
    )

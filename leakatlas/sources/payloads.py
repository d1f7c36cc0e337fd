"""Landed payloads to relations.

Each function takes a table with one payload per row (``body`` by default) and
parses it with a fixed schema. Bad payloads never abort a job: the functions
that can meet them return, or have a twin that returns, the rejected rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions.urls import clean_url


def _parse(body: Column | str, schema: str) -> Column:
    return F.from_json(F.col(body) if isinstance(body, str) else body, schema)


_HIT_FIELDS = {
    "file_url": "item.html_url",
    "file_api_url": "item.url",
    "repo_name": "item.repository.name",
    "repo_url": "item.repository.html_url",
    "commits_url": "item.repository.commits_url",
    "owner_url": "item.repository.owner.html_url",
}


def _search_rows(pages: DataFrame, body: str, keys: Sequence[str]) -> DataFrame:
    return pages.select(
        *keys, "page", F.posexplode(_parse(body, schemas.SEARCH_PAGE)["items"]).alias("pos", "item")
    ).select(*keys, "page", "pos", *[F.col(src).alias(name) for name, src in _HIT_FIELDS.items()])


def search_items(pages: DataFrame, body: str = "body", keys: Sequence[str] = ()) -> DataFrame:
    """Hits of landed search pages: one row per complete item.

    ``pages`` holds ``page`` and the response body. ``commits_url`` loses its
    ``{/sha}`` placeholder. Items that lack a required field are left to
    :func:`search_items_quarantine`.
    """
    complete = F.lit(True)
    for name in _HIT_FIELDS:
        complete = complete & F.col(name).isNotNull()
    return (
        _search_rows(pages, body, keys)
        .filter(complete)
        .withColumn("commits_url", F.replace("commits_url", F.lit("{/sha}"), F.lit("")))
    )


def search_items_quarantine(
    pages: DataFrame, body: str = "body", keys: Sequence[str] = ()
) -> DataFrame:
    """What :func:`search_items` leaves out, with the reason in ``detail``.

    Either a page whose body has no ``items`` array (``pos`` NULL), or an item
    named by its first missing field.
    """
    missing = F.coalesce(
        *[
            F.when(F.col(name).isNull(), F.lit("missing " + src.removeprefix("item.")))
            for name, src in _HIT_FIELDS.items()
        ]
    )
    bad_items = (
        _search_rows(pages, body, keys)
        .select(*keys, "page", "pos", missing.alias("detail"))
        .filter("detail IS NOT NULL")
    )
    bad_pages = pages.filter(_parse(body, schemas.SEARCH_PAGE)["items"].isNull()).select(
        *keys, "page", F.lit(None).cast("int").alias("pos"), F.lit("missing items").alias("detail")
    )
    return bad_pages.unionByName(bad_items)


def search_page_sizes(pages: DataFrame, body: str = "body", keys: Sequence[str] = ()) -> DataFrame:
    """``page, n_items`` per landed search page, empty pages included."""
    return pages.select(
        *keys, "page", F.size(_parse(body, schemas.SEARCH_PAGE)["items"]).alias("n_items")
    ).filter("n_items >= 0")


def repo_tree(trees: DataFrame, body: str = "body", keys: Sequence[str] = ("repo_url",)) -> DataFrame:
    """``(keys, path, sha)`` of every blob entry of landed tree payloads."""
    entries = trees.select(*keys, F.explode(_parse(body, schemas.TREE)["tree"]).alias("e"))
    return blob_only(entries.select(*keys, "e.type", "e.path", "e.sha")).drop("type")


def repo_tree_quarantine(trees: DataFrame, body: str = "body", keys: Sequence[str] = ("repo_url",)) -> DataFrame:
    """What :func:`repo_tree` leaves out: ``(keys, pos, detail)``.

    A payload without a ``tree`` array (``pos`` NULL), or a blob entry without
    path or sha. Entries of other types are no blobs and no errors.
    """
    tree = _parse(body, schemas.TREE)["tree"]
    bad = trees.filter(tree.isNull()).select(*keys, F.lit(None).cast("int").alias("pos"), F.lit("missing tree").alias("detail"))
    entries = trees.select(*keys, F.posexplode(tree).alias("pos", "e")).filter("e.type = 'blob'")
    missing = F.when(F.col("e.path").isNull(), "missing path").when(F.col("e.sha").isNull(), "missing sha")
    return bad.unionByName(entries.select(*keys, "pos", missing.alias("detail")).filter("detail IS NOT NULL"))


def blob_only(entries: DataFrame) -> DataFrame:
    """Tree entries of type blob that carry both a path and a sha."""
    return entries.filter("type = 'blob' AND path IS NOT NULL AND sha IS NOT NULL")


def decode_blobs(blobs: DataFrame, body: str = "body", keys: Sequence[str] = ("sha",)) -> DataFrame:
    """``(keys, content, decode_status)`` of landed blob payloads."""
    parsed = blobs.select(*keys, _parse(body, schemas.BLOB).alias("b"))
    return decode_content(parsed.select(*keys, "b.encoding", "b.content"), keys)


def decode_content(blobs: DataFrame, keys: Sequence[str] = ("sha",)) -> DataFrame:
    """Decode an ``(encoding, content)`` table.

    Base64 content loses its line breaks and must decode to strict UTF-8; any
    other encoding is taken as is. ``decode_status`` is ``ok``,
    ``missing_content``, ``invalid_base64`` or ``invalid_utf8``; content is
    NULL unless ``ok``.
    """
    packed = F.regexp_replace("content", r"[\r\n]", "")
    raw = F.try_to_binary(packed, F.lit("base64"))
    is_base64 = F.coalesce(F.col("encoding") == "base64", F.lit(False))
    staged = blobs.select(
        *keys, "content", is_base64.alias("_b64"), F.when(is_base64, raw).alias("_raw")
    ).select(
        *keys, "content", "_b64", "_raw", F.try_validate_utf8(F.col("_raw").cast("string")).alias("_text")
    )
    return staged.select(
        *keys,
        F.when(F.col("_b64"), F.col("_text")).otherwise(F.col("content")).alias("content"),
        F.when(F.col("content").isNull(), "missing_content")
        .when(~F.col("_b64"), "ok")
        .when(F.col("_raw").isNull(), "invalid_base64")
        .when(F.col("_text").isNull(), "invalid_utf8")
        .otherwise("ok")
        .alias("decode_status"),
    )


def commit_dates(payloads: DataFrame, body: str = "body", keys: Sequence[str] = ("repo_url",)) -> DataFrame:
    """``(keys, committed_at, outcome)``: date of the first commit of each payload, in UTC."""
    commits = _parse(body, schemas.COMMIT_LIST)
    date = F.get(commits, F.lit(0))["commit"]["committer"]["date"]
    # RFC 3339 asks for an offset; Spark alone would accept a bare local time.
    has_offset = F.rlike(F.col("_date"), F.lit(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"))
    return (
        payloads.select(*keys, F.size(commits).alias("_n"), date.alias("_date"))
        .withColumn("committed_at", F.when(has_offset, F.try_to_timestamp(F.upper("_date"))))
        .select(
            *keys,
            "committed_at",
            F.when(F.coalesce("_n", F.lit(-1)) < 0, "invalid_payload")
            .when(F.col("_n") == 0, "no_commits")
            .when(F.col("_date").isNull(), "missing_date")
            .when(F.col("committed_at").isNull(), "invalid_date")
            .otherwise("ok")
            .alias("outcome"),
        )
    )


def repo_metadata(
    infos: DataFrame, topics: DataFrame, body: str = "body", keys: Sequence[str] = ("owner", "name")
) -> DataFrame:
    """Repository metadata from the info payload and the topics payload.

    A payload without ``default_branch`` yields no row. Topics default to an
    empty list whatever went wrong with them; entries that are not strings are
    dropped.
    """
    info = (
        infos.select(*keys, _parse(body, schemas.REPO_INFO).alias("i"))
        .filter("i.default_branch IS NOT NULL")
        .select(
            *keys,
            "i.default_branch",
            "i.description",
            F.coalesce("i.archived", F.lit(False)).alias("is_archived"),
        )
    )
    names = _parse(body, "names ARRAY<VARIANT>")["names"]
    strings = F.transform(
        F.filter(names, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")
    )
    named = topics.select(*keys, strings.alias("topics"))
    return info.join(named, list(keys), "left").withColumn(
        "topics", F.coalesce("topics", F.array().cast("array<string>"))
    )


def repo_metadata_quarantine(infos: DataFrame, body: str = "body", keys: Sequence[str] = ("owner", "name")) -> DataFrame:
    """Info payloads that :func:`repo_metadata` leaves out: ``(keys, detail)``."""
    branch = _parse(body, schemas.REPO_INFO)["default_branch"]
    whole = F.try_parse_json(F.col(body)).isNotNull()
    detail = F.when(whole, "missing default_branch").otherwise("invalid payload")
    return infos.filter(branch.isNull()).select(*keys, detail.alias("detail"))


def default_branch(metadata: DataFrame, keys: Sequence[str] = ("owner", "name")) -> DataFrame:
    return metadata.select(*keys, "default_branch")


def repo_languages(payloads: DataFrame, body: str = "body", keys: Sequence[str] = ("repo_url",)) -> DataFrame:
    """``(keys, lang, bytes)`` from the language map payload."""
    return payloads.select(*keys, F.explode(_parse(body, schemas.LANGUAGES)).alias("lang", "bytes"))


def repo_languages_quarantine(payloads: DataFrame, body: str = "body", keys: Sequence[str] = ("repo_url",)) -> DataFrame:
    """Payloads that are no map of numbers: ``(keys, detail)``. An empty map is not an error."""
    return payloads.filter(_parse(body, schemas.LANGUAGES).isNull()).select(*keys, F.lit("invalid payload").alias("detail"))


def raw_content(files: DataFrame, url: str = "url", text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """Landed file bodies keyed by their cleaned URL: ``(keys, file_url, text)``."""
    return files.select(*keys, clean_url(url).alias("file_url"), F.col(text).alias("text"))


def read_raw_files(spark, path: str) -> DataFrame:
    """Whole files below a path, one row each: ``(file_url, text)``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file_url"), F.col("value").alias("text")
    )

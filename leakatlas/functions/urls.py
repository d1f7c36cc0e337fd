"""URL and path column functions.

Every function takes and returns a ``Column`` built from JVM-side string
expressions, so it can be used in projections, filters and join keys alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

BLOB_MARK = "/blob/"
RAW_HOST = "raw.githubusercontent.com"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c: Column | str) -> Column:
    """Trim all Unicode whitespace; Spark's own ``trim`` only strips U+0020."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+\z", "")


def _last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def clean_url(url: Column | str) -> Column:
    """Drop the query string and every double quote, then trim. ``#fragment`` stays."""
    return trim_unicode(F.replace(F.substring_index(_col(url), "?", 1), F.lit('"'), F.lit("")))


def clean_file_name(url: Column | str) -> Column:
    """Last path segment of the cleaned URL."""
    return _last_segment(clean_url(url))


def extract_file_path(url: Column | str) -> Column:
    """Path inside the repository for blob and raw URLs, else the last segment.

    A second ``/blob/`` ends the path, and a branch name holding ``/`` leaks
    into it: the URL alone cannot tell branch from path.
    """
    return F.element_at(F.transform(F.array(clean_url(url)), _path_of_clean), 1)


def _path_of_clean(url: Column) -> Column:
    after_blob = F.split_part(url, F.lit(BLOB_MARK), F.lit(2))
    raw_parts = F.split(F.split_part(url, F.lit(RAW_HOST + "/"), F.lit(2)), "/")
    return (
        F.when(
            F.contains(url, F.lit(BLOB_MARK)) & F.contains(after_blob, F.lit("/")),
            F.substr(after_blob, F.instr(after_blob, "/") + 1),
        )
        .when(
            F.contains(url, F.lit(RAW_HOST + "/")) & (F.size(raw_parts) > 3),
            F.array_join(F.slice(raw_parts, 4, F.greatest(F.size(raw_parts), F.lit(1))), "/"),
        )
        .otherwise(_last_segment(url))
    )


def file_extension(path_or_url: Column | str) -> Column:
    """Lower-case extension with its dot, ``""`` when there is none.

    Blob and raw URLs are reduced to their repository path first and the last
    dot of that whole path counts; anything else is reduced to its last
    segment, query string included.
    """
    c = _col(path_or_url)
    path = F.when(
        F.contains(c, F.lit(BLOB_MARK)) | F.contains(c, F.lit(RAW_HOST)), extract_file_path(c)
    ).otherwise(_last_segment(c))
    return F.when(
        F.contains(path, F.lit(".")), F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1)))
    ).when(path.isNotNull(), F.lit(""))


def normalize_ext(ext: Column | str) -> Column:
    """Trim, lower-case and prefix a dot; empty stays empty."""
    e = F.lower(trim_unicode(ext))
    return F.when(e.startswith(".") | (e == ""), e).otherwise(F.concat(F.lit("."), e))


def normalize_ext_option(ext: str) -> str:
    """Driver-side twin of :func:`normalize_ext` for option lists."""
    ext = ext.strip().lower()
    return ext if not ext or ext.startswith(".") else "." + ext


def ext_allowed(
    url: Column | str,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    get_path: Callable[[Column], Column] = extract_file_path,
) -> Column:
    """Row predicate of the extension filter.

    ``include=None`` lets everything through to ``exclude``; an *empty*
    include list keeps everything and also switches ``exclude`` off. ``""`` in
    a list stands for files without extension. Exclude wins over include.
    """
    include = None if include is None else sorted({normalize_ext_option(e) for e in include})
    exclude = None if exclude is None else sorted({normalize_ext_option(e) for e in exclude})
    if include == []:
        return F.lit(True)
    ext = file_extension(get_path(_col(url)))
    keep = F.lit(True) if include is None else ext.isin(include)
    return keep & ~ext.isin(exclude) if exclude else keep


def filter_files(
    files: Column | str,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    get_path: Callable[[Column], Column] = extract_file_path,
) -> Column:
    """Extension filter over an array of URLs, order kept."""
    include = None if include is None else list(include)
    exclude = None if exclude is None else list(exclude)
    return F.filter(_col(files), lambda u: ext_allowed(u, include, exclude, get_path))


def repo_owner_name(url: Column | str) -> Column:
    """``struct(owner, name)`` from a repository URL, NULL without a second part."""
    rest = F.replace(
        F.replace(_col(url), F.lit("https://github.com/"), F.lit("")),
        F.lit("http://github.com/"),
        F.lit(""),
    )
    parts = F.split(rest, "/")
    return F.when(
        F.size(parts) >= 2,
        F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name")),
    )

"""Records as a header row and item rows, of one shape at every size.

A repository may own a third of all rows, so its files and findings stay rows:
one row of section ``repository`` with the facts and counts, and one row for
each item. Nothing is gathered, so no group is too large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HEADER = "repository"


def distinct_items(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``items`` once each, without those that lack a key.

    What produces them, a scan for instance, runs once although counting and
    listing both read them: both sides find the same exchange. As one struct
    the item cannot be pruned, and keys are not null before the exchange, so
    neither side changes it.
    """
    payload = [c for c in items.columns if c not in keys and c != "section"]
    known = items.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return known.select(F.struct(*keys, "section", *payload).alias("_item")).distinct().select("_item.*")


def count_items(items: DataFrame, keys: Sequence[str], sections: Sequence[str]) -> DataFrame:
    """Keys and ``n_<section>``; reduced before rows meet by key."""
    return items.groupBy(*keys).agg(*[F.count_if(F.col("section") == s).alias(f"n_{s}") for s in sections])


def with_header(header: DataFrame, items: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Header rows and the items of their keys as one table.

    Columns of the other kind are NULL, but for ``carry``: columns of the
    header that its items repeat, to be sorted by.
    """
    keys = list(keys)
    top = header.withColumn("section", F.lit(HEADER))
    # Items first: a hot key is then a large left side that Spark may split.
    rows = items.join(header.select(*keys, *carry), keys)
    out = top.unionByName(rows, allowMissingColumns=True)
    return out.select(*keys, "section", *[c for c in out.columns if c not in keys and c != "section"])

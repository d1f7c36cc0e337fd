"""Continuous scan of arriving files."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import file_hits
from ..rules import Rule, enabled
from .seen import SeenKeys


def _hits(files: DataFrame, rules, include_disabled: bool, keys: Sequence[str], text_col: str, options: dict) -> DataFrame:
    hits = file_hits(text_col, enabled(rules, include_disabled), **options)
    return files.select(*keys, hits.alias("_hits")).filter(F.size("_hits") > 0)


def _findings(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.select(*keys, F.posexplode("_hits").alias("hit_no", "h")).select(*keys, "hit_no", "h.*")


def scan_stream(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    *,
    sha_col: str = "sha",
    ts_col: str = "ts",
    watermark: str = "1 day",
    key_cols: Sequence[str] = ("repo_url", "path"),
    text_col: str = "text",
    include_disabled: bool = False,
    **scan_options,
) -> DataFrame:
    """Findings of a stream of files; each version of a file is reported once within the watermark.

    A version is ``(key_cols, sha)``: equal content in another repository or
    path is reported there too. The scan is row-local and comes first, so what
    is shuffled and kept as state are the keys of files with findings, without
    their text. Files older than the watermark do not pass the state; use
    :func:`start_scan` to have them in an output of their own. Output as for
    ``scan_secrets``, keyed by the key columns, sha and time.
    """
    keys = list(dict.fromkeys([*key_cols, sha_col, ts_col]))
    found = _hits(files.withWatermark(ts_col, watermark), rules, include_disabled, keys, text_col, scan_options)
    return _findings(found.dropDuplicatesWithinWatermark([*key_cols, sha_col]), keys)


def start_scan(
    files: DataFrame,
    folder: str,
    rules: Sequence[Rule] | None = None,
    *,
    sha_col: str = "sha",
    ts_col: str = "ts",
    watermark: str = "1 day",
    key_cols: Sequence[str] = ("repo_url", "path"),
    text_col: str = "text",
    include_disabled: bool = False,
    alert_by: Sequence[str] = ("repo_url",),
    alert_ttl: str = "30 days",
    snapshot_every: int = 16,
    trigger: dict | None = None,
    **scan_options,
) -> StreamingQuery:
    """Scan a stream into ``folder``/findings, and what comes too late into ``folder``/late.

    The newest event time before each batch, less ``watermark``, divides them.
    It is kept in ``folder``/newest, so a restarted query goes on from it.
    Each batch writes under its own number and may be repeated. A version of a
    file that a batch holds twice is reported once; over batches, versions
    are dropped that an earlier batch within the watermark has reported.

    ``folder``/alerts holds the first finding of each value in a repository (or
    what ``alert_by`` names): reads of the environment are left out, and a
    value is new again when its last alert is older than ``alert_ttl``; a batch
    gives one alert a value at most. Both states are :class:`SeenKeys`, so what a batch reads depends on the
    watermark and the time to live, not on the number of batches before.
    """
    keys = list(dict.fromkeys([*key_cols, sha_col, ts_col]))
    version, alerted = [*key_cols, sha_col], [*alert_by, "value_sha256"]
    types = {c: files.schema[c].dataType for c in {*keys, *alert_by}} | {"value_sha256": T.StringType()}

    def seen_keys(name: str, names: Sequence[str]) -> SeenKeys:
        schema = T.StructType([T.StructField(c, types[c]) for c in dict.fromkeys([*names, ts_col])])
        return SeenKeys(f"{folder}/{name}", schema, ts_col, snapshot_every)

    versions, values = seen_keys("seen_versions", version), seen_keys("seen_values", alerted)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        found = _hits(rows, rules, include_disabled, keys, text_col, scan_options).persist()
        newest = _newest(spark, folder, number)
        limit, ttl = (F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {x}") for x in (watermark, alert_ttl))
        is_late = F.coalesce(F.col(ts_col) < limit, F.lit(False))
        fresh = versions.unseen(found.filter(~is_late).dropDuplicates(version), number, limit)
        for part, name in ((fresh, "findings"), (found.filter(is_late), "late")):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        written = spark.read.schema(found.schema).parquet(f"{folder}/findings/batch={number}")
        versions.write(number, written, limit)
        secrets = _findings(written, keys).filter(~F.col("is_env_reference"))
        first = _first_findings(values.unseen(secrets, number, ttl, alert_ttl), alerted, ts_col, keys)
        first.write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
        values.write(number, spark.read.schema(first.schema).parquet(f"{folder}/alerts/batch={number}"), ttl)
        now = rows.agg(F.greatest(F.max(ts_col), F.lit(newest).cast("timestamp")).alias("newest"))
        now.write.mode("overwrite").parquet(f"{folder}/newest/batch={number}")
        found.unpersist()

    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state")
    return query.trigger(**(trigger or {"availableNow": True})).start()


def _newest(spark: SparkSession, folder: str, number: int) -> datetime.datetime | None:
    """The newest event time of the batches before this one; each batch hands it on."""
    if number == 0:
        return None
    return spark.read.parquet(f"{folder}/newest/batch={number - 1}").first()[0]


def _first_findings(findings: DataFrame, by: Sequence[str], ts_col: str, keys: Sequence[str]) -> DataFrame:
    """The earliest row of ``findings`` per ``by``; ties by the other keys and the place in the file."""
    rest = [c for c in findings.columns if c not in by]
    order = [ts_col, *(c for c in keys if c != ts_col), "hit_no"]
    first = findings.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*by, "_first.*").select(*findings.columns)


def read_scan(spark: SparkSession, folder: str, name: str = "findings") -> DataFrame:
    """What :func:`start_scan` wrote, as ``scan_stream`` gives it; ``name`` is ``findings``, ``late`` or ``alerts``."""
    found = spark.read.parquet(f"{folder}/{name}").drop("batch")
    if name == "alerts":
        return found
    return _findings(found, [c for c in found.columns if c != "_hits"])

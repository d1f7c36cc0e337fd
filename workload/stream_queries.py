"""The scan on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakatlas.streaming.scan_stream import read_scan, start_scan

from .folders import new_folder
from .registry import query
from .scan_queries import hits_ctes

COLUMNS = ("repo_url", "path", "sha", "line_no", "rule_id", "secret_type", "key_name", "value_sha256", "value_len")
STREAM_SQL = (
    "WITH arriving AS (SELECT source AS repo_url, CAST(doc_id AS VARCHAR) AS path, any_value(text) AS text FROM documents GROUP BY source, doc_id, text)"
    + hits_ctes("arriving", True)
    + "SELECT f.repo_url, f.path, sha256(a.text) AS sha, line_no, rule_id, secret_type, key_name, value_sha256, value_len "
    "FROM findings f JOIN arriving a USING (repo_url, path)"
)


NEW_SQL = (
    STREAM_SQL[: STREAM_SQL.rindex("SELECT f.repo_url")]
    + "SELECT repo_url, value_sha256, path, line_no FROM ("
    "SELECT repo_url, value_sha256, path, line_no, row_number() OVER (PARTITION BY repo_url, value_sha256 "
    "ORDER BY CAST(path AS BIGINT), line_no) AS place FROM findings WHERE NOT is_env_reference) WHERE place = 1"
)


def _scanned(spark, sf_dir, name: str) -> str:
    """The folder that a scan of the documents as a stream has filled."""
    folder = new_folder(spark, name)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    arriving = (
        spark.readStream.schema(schema)
        .parquet(f"{sf_dir}/documents.parque[t]")  # a pattern, as the table may be a file or a folder
        .select(
            F.col("source").alias("repo_url"),
            F.col("doc_id").cast("string").alias("path"),
            "text",
            F.sha2("text", 256).alias("sha"),
            F.timestamp_seconds(F.col("doc_id")).alias("ts"),
        )
    )
    start_scan(arriving, folder, include_disabled=True).awaitTermination()
    return folder


@query("scan_stream", STREAM_SQL)
def scan_stream(spark, sf_dir):
    """Documents read as a stream, findings appended to a table, each version of a file once."""
    return read_scan(spark, _scanned(spark, sf_dir, "scan_stream")).select(*COLUMNS)


@query("scan_stream_new", NEW_SQL)
def scan_stream_new(spark, sf_dir):
    """The first finding of each value in a repository, from the same stream."""
    return read_scan(spark, _scanned(spark, sf_dir, "scan_stream_new"), "alerts").select("repo_url", "value_sha256", "path", "line_no")

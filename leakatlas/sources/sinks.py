"""JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row in column ``json``; NULL fields are kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a list or report as JSON lines, one file per task."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)

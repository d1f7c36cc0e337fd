"""Where state and cut lineage are written."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir``, if it is set; no setting is changed."""
    folder = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    return folder.rstrip("/") if folder else None

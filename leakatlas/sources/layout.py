"""Tables laid out in buckets by a key, so that joins on it do not move them.

A layout is a folder of Parquet files, bucketed and sorted by the key, with a
note of its schema and number of buckets. It is registered in the session's
catalog when it is opened, as only catalog tables carry buckets; the folder is
what lasts, and any session can open it. Layouts of the same key and number of
buckets are joined bucket by bucket, and any other table after its own rows,
not those of the layout, have been dealt out alike (:meth:`Layout.aligned`).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Layout:
    """An open layout. ``table`` has its rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        note = json.loads(spark.read.text(f"{folder}/layout").first()[0])
        self.schema = StructType.fromJson(note["schema"])
        self.key, self.buckets = note["key"], note["buckets"]
        self.name = f"layout_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        place = f"{folder}/data".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
            f"INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    @classmethod
    def write(cls, df: DataFrame, folder: str, buckets: int, key: str = "sha") -> Layout:
        """Lay ``df`` out below ``folder``, one file a bucket. This is the one time its rows move."""
        if buckets < 1:
            raise ValueError("buckets must be greater than 0")
        name = f"layout_{uuid.uuid4().hex}"
        rows = df.repartition(buckets, key).sortWithinPartitions(key)
        rows.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/data").saveAsTable(name)
        df.sparkSession.sql(f"DROP TABLE {name}")  # of the catalog only; the files stay
        note = json.dumps({"schema": df.schema.jsonValue(), "key": key, "buckets": buckets})
        # Last: a folder with a note is a whole layout.
        df.sparkSession.createDataFrame([(note,)], "note string").coalesce(1).write.text(f"{folder}/layout")
        return cls(df.sparkSession, folder)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def aligned(self, df: DataFrame) -> DataFrame:
        """``df`` dealt out like the layout, for a join with it."""
        return df.repartition(self.buckets, self.key)

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows of the layout whose key is in ``keys``. Keys are moved, the layout is not."""
        return self.table.join(self.aligned(keys.select(self.key).distinct()).hint("merge"), self.key, "left_semi")

    def append(self, df: DataFrame) -> None:
        """Add the rows of ``df`` whose key the layout lacks; of new rows alike in key, one. Null keys are not added."""
        new = df.filter(df[self.key].isNotNull()).dropDuplicates([self.key])
        # Of the layout only the key column is read, in its buckets.
        new = self.aligned(new).hint("merge").join(self.table.select(self.key), self.key, "left_anti").select(*self.schema.names)
        new.write.mode("append").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name)

    def close(self) -> None:
        """Take the table out of the session's catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

"""State of the stream: what a batch reads, repeated batches, first alerts."""

import datetime

from pyspark.sql import functions as F, types as T

from goldens import A
from leakatlas.streaming.scan_stream import read_scan, start_scan
from leakatlas.streaming.seen import DAY, SeenKeys

D = datetime.datetime
KEYS = T.StructType([T.StructField("repo_url", T.StringType()), T.StructField("ts", T.TimestampType())])
FILES = "repo_url string, path string, text string, sha string, ts timestamp"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), KEYS)


def names(df):
    return sorted((r.repo_url for r in df.collect()), key=str)


def test_files_read_stay_constant_over_batches(spark, tmp_path):
    seen, counts = SeenKeys(str(tmp_path), KEYS, "ts", every=4), []
    for n in range(21):
        limit = F.lit(D(2024, 1, 1) + datetime.timedelta(days=n - 3))
        before = seen.read(spark, n, limit)
        counts.append(len(before.inputFiles()))
        batch = rows(spark, (f"r{n}", D(2024, 1, 1) + datetime.timedelta(days=n)), (f"r{n - 1}", D(2024, 1, 1) + datetime.timedelta(days=n)))
        fresh = seen.unseen(batch, n, limit)
        seen.write(n, fresh.filter("repo_url <> 'r-1'"), limit)
    assert names(fresh) == ["r20"] and names(before) == ["r17", "r18", "r19"]
    assert max(counts[13:]) <= max(counts[5:13]) <= 4 + 3 + 1


def test_only_days_within_the_limit_are_read(spark, tmp_path):
    seen = SeenKeys(str(tmp_path), KEYS, "ts")
    seen.write(0, rows(spark, ("old", D(2024, 1, 1)), ("new", D(2024, 1, 20)), (None, D(2024, 1, 20)), ("timeless", None)), F.lit(None).cast("timestamp"))
    limit = F.lit(D(2024, 1, 15))
    read = seen.read(spark, 1, limit)
    assert names(read) == [None, "new", "timeless"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and DAY in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert names(seen.unseen(rows(spark, ("old", D(2024, 1, 21)), ("new", D(2024, 1, 21)), (None, D(2024, 1, 21))), 1, limit)) == ["old"]


def test_a_repeated_batch_leaves_the_same_state(spark, tmp_path):
    seen, limit = SeenKeys(str(tmp_path), KEYS, "ts", every=2), F.lit(D(2023, 1, 1))
    for n in (0, 1, 1, 2, 2, 3, 3):
        seen.write(n, seen.unseen(rows(spark, (f"r{n}", D(2024, 1, 1 + n)), ("again", D(2024, 1, 1 + n))), n, limit), limit)
    assert names(seen.read(spark, 4, limit)) == ["again", "r0", "r1", "r2", "r3"]


def test_values_are_alerted_once_until_their_time_is_over(spark, tmp_path):
    folder, source = str(tmp_path / "scan"), str(tmp_path / "in")

    def arrive(day, repo, path, text, month=1):
        one = [(repo, path, text, f"{path}-{day}-{month}", D(2024, month, day))]
        spark.createDataFrame(one, FILES).coalesce(1).write.mode("append").parquet(source)
        start_scan(spark.readStream.schema(FILES).parquet(source), folder, watermark="1 day", alert_ttl="20 days", snapshot_every=2).awaitTermination()
        return sorted((r.repo_url, r.path, r.ts.month, r.ts.day) for r in read_scan(spark, folder, "alerts").collect())

    secret = "x = 1\ndb_password=" + A(10)
    first = arrive(2, "A", "b.env", secret + "\n" + secret)
    assert first == [("A", "b.env", 1, 2)]
    assert arrive(3, "A", "c.env", secret) == first  # another file, the same value
    assert arrive(4, "B", "b.env", secret) == [*first, ("B", "b.env", 1, 4)]
    assert len(arrive(5, "A", "d.env", "db_password=" + A(11))) == 3
    assert len(arrive(1, "C", "late.env", secret)) == 3  # behind the watermark: in the other output
    assert read_scan(spark, folder, "late").count() == 1
    assert ("A", "e.env", 2, 10) in arrive(10, "A", "e.env", secret, month=2)  # silent for longer than the time to live
    assert read_scan(spark, folder).filter("path = 'c.env'").count() == 1

"""Streams give what the same plan gives on a batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumika.operators.people import online_clusters
from lumika.streaming.watch import debounce, event_counts, scan_stream, stream_clusters


@pytest.fixture()
def events(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 3, base + dt.timedelta(seconds=s), "click") for i, s in enumerate([0, 1, 2, 4, 5, 30, 31, 33, 60, 61, 90, 200])] + [(None, base, "click"), (1, None, "view")]
    spark.createDataFrame(rows, "root long, at timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def rows(df):
    return sorted(map(str, df.collect()))


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_debounce(spark, events):
    batch = debounce(spark.read.parquet(events), "root", "at", "5 seconds")
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events)
    assert rows(run(spark, debounce(stream, "root", "at", "5 seconds", "1 minute"), "bursts", "complete")) == rows(batch)
    assert batch.agg(F.sum("changes")).first()[0] == 12


def test_windows(spark, events):
    batch = event_counts(spark.read.parquet(events), "at", "kind", "1 minute").where("opened is not null")
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events)
    assert rows(run(spark, event_counts(stream, "at", "kind", "1 minute"), "windows", "complete").where("opened is not null")) == rows(batch)


def test_scan_stream_writes_each_file_once(spark, tmp_path):
    files = spark.createDataFrame([("/a.jpg", 1.0, 5), ("/b.jpg", 1.0, 6)], "path string, mtime double, size_bytes long")
    files.coalesce(1).write.parquet(str(tmp_path / "files"))
    schema = "path string, mtime double, size_bytes long, embedding_ver int, phash string, dominant_colors string"
    held = [spark.createDataFrame([("/a.jpg", 1.0, 5, 1, "aa", "[]")], schema)]
    seen = []

    def write(df, number):
        seen.extend(r["path"] for r in df.collect())

    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "files"))
    for _ in range(2):
        scan_stream(stream, lambda: held[0], write, str(tmp_path / "check")).awaitTermination()
    assert seen == ["/b.jpg"]


def test_stream_clusters_equal_the_batch(spark, tmp_path):
    data = [("r", i, [1.0, 0.1 * i]) if i % 2 else ("s", i, [0.1 * i, 1.0]) for i in range(1, 13)] + [("r", 20, None)]
    df = spark.createDataFrame(data, "root string, face_id long, embedding array<double>")
    unit = F.transform("embedding", lambda v: v / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))
    df = df.select("root", "face_id", unit.alias("embedding"))
    for k, part in enumerate((df.where("face_id <= 6"), df.where("face_id > 6"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "faces"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "faces"))
    got = run(spark, stream_clusters(stream, "root", 2), "clusters", "append")
    assert rows(got) == rows(online_clusters(df, "root").select("root", "face_id", "cluster"))

"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from webloom.operators import crawl
from webloom.streaming import streams


def _source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_visits(spark, tmp_path):
    rows = [(f"http://h/{i % 5}/?utm_x={i}#f",) for i in range(40)]
    got = []
    q = streams.emit(streams.first_visits(_source(spark, tmp_path, rows, "url string")), lambda df, _: got.extend(r.url for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(got) == [f"http://h/{i}" for i in range(5)]


def test_first_visits_with_watermark(spark, tmp_path):
    rows = [(f"http://h/{i % 3}", i) for i in range(12)]
    src = _source(spark, tmp_path, rows, "url string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = []
    streams.emit(streams.first_visits(src, "ts", "1 hour"), lambda df, _: got.extend(r.url for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(got) == ["http://h/0", "http://h/1", "http://h/2"]


def test_host_counters_equal_batch(spark, tmp_path):
    rows = [(f"http://h{i % 2}/{i}", "likely_shell" if i % 2 else "static") for i in range(30)]
    schema = "url string, js_detection string"
    out = str(tmp_path / "out")
    streams.host_counters_to_table(_source(spark, tmp_path, rows, schema), out, str(tmp_path / "cp")).awaitTermination(120)
    last = spark.read.parquet(out).groupBy("host").agg(F.max_by(F.struct("total", "shells", "force_render"), "batch").alias("x")).select("host", "x.*")
    want = crawl.host_stats(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_fresh_pages(spark, tmp_path):
    asked = _source(spark, tmp_path / "a", [("u", 100), ("u", 9000)], "url string, s long").withColumn("ts", F.timestamp_seconds("s"))
    had = _source(spark, tmp_path / "b", [("u", 50), ("v", 60)], "url string, s long").select("url", F.timestamp_seconds("s").alias("ts"), F.lit("h").alias("content_hash"))
    got = []
    streams.emit(streams.fresh_pages(asked, had, "1 hour"), lambda df, _: got.extend(r.url for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert got == ["u"]

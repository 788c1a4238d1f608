"""Incremental forms: visited urls, host counters, cache expiry and page emission on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from webloom.functions.urls import normalize_url, url_host
from webloom.operators.crawl import HOST_PAGES, HOST_SHARE


def first_visits(urls: DataFrame, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each normalised url once. With an event time, state older than the watermark's ``delay`` is dropped."""
    once = urls.withColumn("url", normalize_url(F.col("url"))).where("url <> ''")
    if time is None:
        return once.dropDuplicates(["url"])
    return once.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def host_counters(pages: DataFrame) -> DataFrame:
    """Running ``(host, total, shells, force_render)`` of ``pages(url, js_detection)``; write in update mode."""
    shell = F.when(F.col("js_detection") == "likely_shell", 1).otherwise(0)
    out = pages.groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("total"), F.sum(shell).alias("shells"))
    return out.withColumn("force_render", (F.col("total") >= HOST_PAGES) & (F.col("shells") / F.col("total") > HOST_SHARE))


def fresh_pages(frontier: DataFrame, fetched: DataFrame, ttl: str, time: str = "ts") -> DataFrame:
    """Stream-stream join: requests with the pages fetched within ``ttl`` before them; both sides' state ends with the ttl."""
    f = frontier.withWatermark(time, ttl).select(F.col("url").alias("url"), F.col(time).alias("asked"))
    p = fetched.withWatermark(time, ttl).select(F.col("url").alias("page_url"), F.col(time).alias("got"), "content_hash")
    near = (F.col("url") == F.col("page_url")) & (F.col("got") <= F.col("asked")) & (F.col("asked") <= F.col("got") + F.expr(f"INTERVAL {ttl}"))
    return f.join(p, near).select("url", "asked", "got", "content_hash")


def emit(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands every micro-batch to ``sink`` as it is done; ``once`` takes what is there and ends."""
    writer = pages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def host_counters_to_table(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest counters of each host: one version of the table a micro-batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)

    q = host_counters(pages).writeStream.outputMode("update").foreachBatch(write)
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

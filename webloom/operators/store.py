"""Tables laid out for the joins of a crawl: bucketed and sorted by url, so that a level moves only its own urls."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import content_hash
from webloom.functions.urls import normalize_url
from webloom.operators.fetch import one_snapshot, read_pages
from webloom.session import new_path

#: Columns of a store of pages that were read; one of pages that weren't has ``body`` in place of all after ``status``.
READ = "url string, status int, js_detection string, content_hash string, title string, markdown string, links array<string>"


class Bucketed:
    """A table at a path, bucketed by url; registered under a name of its own for as long as it is used.

    ``n`` buckets are as many as the session's shuffle partitions, so that Spark finds a shuffled frontier and
    the table dealt out alike and exchanges the frontier alone.
    """

    def __init__(self, spark: SparkSession, path: str, n: int | None = None, part: str | None = None) -> None:
        self.spark, self.path, self.part = spark, path, part
        self.n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"webloom_{uuid.uuid4().hex}"

    def append(self, rows: DataFrame, /, **metrics: Column) -> dict:
        """Writes ``rows`` and gives ``metrics`` of them, from the same pass. A task holds whole buckets if the rows come dealt out by url."""
        if metrics:
            seen = Observation()
            rows = rows.observe(seen, *[m.alias(k) for k, m in metrics.items()])
        w = rows.write.mode("append").option("path", self.path).bucketBy(self.n, "url").sortBy("url")
        (w.partitionBy(self.part) if self.part else w).saveAsTable(self.name)
        return {k: seen.get.get(k) or 0 for k in metrics} if metrics else {}

    def attach(self, schema: str) -> Bucketed:
        """Makes the name known to this session for a table that is there."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], schema).schema)
        part = f"PARTITIONED BY ({self.part})" if self.part else ""
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet {part} CLUSTERED BY (url) SORTED BY (url) INTO {self.n} BUCKETS LOCATION '{self.path}'")
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def detach(self) -> None:
        """Forgets the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class PageStore:
    """A snapshot of the web for crawls: urls normalised, one snapshot each, bucketed by url.

    ``read`` stores have each page's links, content hash, title and markdown, read once when the store was
    built, for all crawls to come; as columns of their own, so that a level reads statuses and links and no content.
    """

    def __init__(self, table: Bucketed, read: bool) -> None:
        self.table, self.read = table, read

    @classmethod
    def build(cls, web: DataFrame, path: str | None = None, keep: Column | None = None, read: bool = True, rendered: DataFrame | None = None) -> PageStore:
        """Of ``web(url, status, body)``, or ``(url, links)`` where links are known; ``keep`` is a filter on the normalised ``url``.

        Of several snapshots of one normalised url one counts, see ``one_snapshot``; rows whose url can't be normalised are left
        out. The one exchange is that of the aggregate by url, with as many partitions as buckets.
        """
        spark = web.sparkSession
        known = "links" in web.columns
        columns = ["links"] if known else ["status", "body"]
        rows = web.select(normalize_url(F.col("url")).alias("url"), *columns).where("url <> ''")
        once = one_snapshot(rows if keep is None else rows.where(keep))
        if known:
            links = F.coalesce(F.transform("links", normalize_url), F.array().cast("array<string>"))
            empty = [F.lit(None).cast("string").alias(c) for c in ("js_detection", "content_hash", "title", "markdown")]
            once = once.select("url", F.lit(200).alias("status"), *empty, F.array_distinct(links).alias("links"))
        elif read:
            good = once.withColumn("body", F.when(F.col("status") == 200, F.col("body")))
            once = read_pages(good, "links", "main", rendered=rendered).select("url", "status", *page_columns(F.col("page")))
        table = Bucketed(spark, path or new_path(spark, "page-store"))
        table.append(once)
        return cls(table, known or read)

    @classmethod
    def open(cls, spark: SparkSession, path: str, n: int) -> PageStore:
        """A store that was built with ``read`` and ``n`` buckets, perhaps by another session."""
        return cls(Bucketed(spark, path, n).attach(READ), True)

    def rows(self, urls: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of a few ``urls``: then only the files of their buckets are opened, and in them the row groups that can hold them."""
        found = self.table.rows()
        return found if urls is None else found.where(F.col("url").isin(list(urls)))


def page_columns(page: Column, content: bool = True) -> list[Column]:
    """What a crawl keeps of a page that was read for its links and (``content``) its main content; links are normalised, each once."""
    links = F.coalesce(F.transform(page["links"], normalize_url), F.array().cast("array<string>"))
    title, markdown = (page["title"], page["markdown"]) if content else (F.lit(None).cast("string"),) * 2
    return [F.col("js_detection"), content_hash(markdown).alias("content_hash"), title.alias("title"), markdown.alias("markdown"), F.array_distinct(links).alias("links")]

"""Crawling as a fixpoint of joins: one plan a level, every level written before the next."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import secrets
import signal
import tempfile
import threading
from collections.abc import Callable, Iterator, Sequence
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import normalize_url, url_host
from webloom.operators.cache import PageCache, fresh, with_entries
from webloom.operators.fetch import capped, fetch, one_snapshot, read_pages
from webloom.operators.filters import passes_filters
from webloom.operators.store import Bucketed, PageStore, page_columns
from webloom.session import materialize, new_path

#: A host is rendered throughout once this many pages were seen and more than this share were shells.
HOST_PAGES, HOST_SHARE = 10, 0.8
RESULT_COLUMNS = ("url", "depth", "status", "source", "error", "js_detection")


def host_stats(pages: DataFrame) -> DataFrame:
    """``(host, total, shells, force_render)`` over plainly fetched pages with ``js_detection``."""
    shell = F.when(F.col("js_detection") == "likely_shell", 1).otherwise(0)
    out = pages.groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("total"), F.sum(shell).alias("shells"))
    return out.withColumn("force_render", (F.col("total") >= HOST_PAGES) & (F.col("shells") / F.col("total") > HOST_SHARE))


def new_links(links: DataFrame, visited: DataFrame) -> DataFrame:
    """``links(url)``: normalised, each once, without empties and without what was visited."""
    once = links.select(normalize_url(F.col("url")).alias("url")).where("url <> ''").distinct()
    return once.join(visited.select("url"), "url", "left_anti")


#: A crawl's own table: what it returns, what the next level and the cache need, a part for each level.
LOG = "url string, source string, status string, error string, js_detection string, content_hash string, title string, markdown string, links array<string>, depth int"
#: A level of at most so many links is looked up by its urls; a longer one meets the store bucket by bucket.
FEW = 1000


def crawl(
    spark: SparkSession,
    seeds: Sequence[str] | DataFrame,
    web: PageStore | DataFrame | Callable[[DataFrame], DataFrame],
    *,
    seed_host: str | None = None,
    depth: int = 3,
    allow: Sequence[str] = (),
    deny: Sequence[str] = (),
    source: str = "seed",
    cache: PageCache | DataFrame | None = None,
    now: Column | None = None,
    ttl_seconds: int = 72 * 3600,
    expand_cached: bool = False,
    rendered: DataFrame | None = None,
    content: bool = False,
    step: int | None = None,
    on_level: Callable[[int, DataFrame], None] | None = None,
    stop: threading.Event | None = None,
) -> DataFrame:
    """``(url, depth, status, source, error, js_detection)``: all pages within ``depth`` links, each once, at its least depth.

    ``web`` is a :class:`PageStore`, which many crawls can share; or ``(url, status, body)``, or ``(url, links array<string>)`` where
    links are known, of which those that pass the filters are laid out as a store first; or a function that fetches a level's ``(url)``, see
    ``live.fetch_all``. Of several snapshots of one normalised url one counts. Seeds pass the filters like any link.

    A level is one job that writes its pages, their links too, into the crawl's own table, bucketed by url as the
    store is: new links, each once, are all that is exchanged; they meet the table (visited urls) and the store where those lie.
    The write counts what it writes, so the end needs no job. Links to a hot page are made one before the exchange, and a host with a third of
    all pages is no hot key. With ``rendered``, shells are taken from there, and hosts that were shells on earlier levels are rendered throughout.

    With a ``cache``, a fresh entry gives ``unchanged`` and isn't expanded unless ``expand_cached``; an expired one is fetched, and is
    ``unchanged`` or ``changed`` by its content hash. A :class:`PageCache` gets each level's fetched pages as the level
    is done (its own ttl holds). ``content`` adds title, markdown and content hash of fetched pages.

    With ``step``, a level goes in parts of about so many pages, each written, kept in the cache and committed before the next one: for live
    webs, where pages are dear. ``on_level`` sees each level or part as it is done; ``stop`` ends the crawl before the next one and
    leaves all that was committed.
    """
    live = callable(web)
    keeps = isinstance(cache, PageCache)
    ttl_seconds = cache.ttl if keeps else ttl_seconds
    now = F.unix_timestamp() if now is None else now
    first = seeds.select("url") if isinstance(seeds, DataFrame) else spark.createDataFrame([(s,) for s in seeds], "url string")
    if seed_host is None:
        row = first.select(url_host(F.col("url")).alias("h")).first()
        seed_host = row["h"] if row else ""
    fits = passes_filters(F.col("url"), seed_host, allow, deny)
    store = web if isinstance(web, PageStore) else None if live else PageStore.build(web, keep=fits, read=False)
    wants = ("links", "main") if content or cache is not None else ("links",)
    log = Bucketed(spark, new_path(spark, "crawl"), store.table.n if store else None, part="depth")
    front = first.select(normalize_url(F.col("url")).alias("url")).where("url <> ''").distinct().where(fits)
    few: list[str] | None = None
    hashed = cache is None or keeps or "content_hash" in cache.schema["p"].dataType.names

    def visit(front: DataFrame, few: list[str] | None, level: int) -> dict:
        """Writes what becomes of the urls of ``front`` (those of ``few``, if given) and counts it."""
        work = front.select("url").withColumn("source", F.lit(source if level == 0 else "link"))
        if cache is None:
            work = work.withColumn("entry", F.lit(None).cast("struct<t:bigint,p:struct<content_hash:string>>"))
        else:
            work = with_entries(work, cache.entries_for(front) if keeps else cache)
        work = work.withColumn("cached", fresh(F.col("entry"), now, ttl_seconds))
        if live:
            work = materialize(work, "crawl-frontier")
            known = one_snapshot(materialize(web(work.where("not cached").select("url")), "crawl-fetched").select("url", "status", "body"))
        else:
            known = store.rows(few)
        got = work.join(known if few is not None or live else known.hint("merge"), "url", "left")
        reason = F.when(F.col("status").isNull(), "no snapshot of ").when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" for ")))
        got = got.withColumn("error", F.when(~F.col("cached"), F.concat(reason, F.col("url"))))
        if live or not store.read:
            forced = None
            if rendered is not None and level:
                hosts = host_stats(log.rows().where("status = 'new' and js_detection is not null")).where("force_render").select("host", F.lit(True).alias("__force"))
                got = got.withColumn("host", url_host(F.col("url"))).join(hosts, "host", "left").drop("host")
                forced = F.col("__force")
            got = got.withColumn("body", F.when(~F.col("cached") & F.col("error").isNull(), capped(F.col("body"))))
            got = read_pages(got, *wants, rendered=rendered, forced=forced)
            if forced is not None:
                got = got.withColumn("js_detection", F.when(F.coalesce(forced, F.lit(False)), F.lit(None)).otherwise(F.col("js_detection")))
            got = got.select("url", "source", "cached", "entry", "error", *page_columns(F.col("page"), "main" in wants))
        fetched = ~F.col("cached") & F.col("error").isNull()
        old = F.col("entry.p.content_hash") if hashed else F.lit(None).cast("string")
        again = F.when(old == F.col("content_hash"), "unchanged").when(old.isNotNull() & F.col("content_hash").isNotNull(), "changed").otherwise("new")
        status = F.when(F.col("cached"), "unchanged").when(fetched, F.when(F.col("entry").isNotNull(), again).otherwise("new"))
        expand = F.lit(level < depth) & F.col("error").isNull() & (F.lit(True) if expand_cached else ~F.col("cached"))
        kept = [F.when(fetched, F.col(c)).alias(c) if "main" in wants else F.lit(None).cast("string").alias(c) for c in ("content_hash", "title", "markdown")]
        rows = got.select("url", "source", status.alias("status"), "error", "js_detection", *kept, F.when(expand, F.col("links")).alias("links"), F.lit(level).alias("depth"))
        return log.append(rows, rows=F.count(F.lit(1)), links=F.sum(F.when(F.col("links").isNotNull(), F.size("links"))))

    def parts(front: DataFrame, few: list[str] | None) -> Iterator[tuple[DataFrame, list[str] | None, Column]]:
        """The parts of a level and how the rows of each are told; the frontier is written first, as each part reads it."""
        if step is None:
            yield front, few, F.lit(True)
        elif few is not None:
            for some in batched(few, step):
                yield spark.createDataFrame([(u,) for u in some], "url string"), list(some), F.col("url").isin(list(some))
        else:
            held = materialize(front.select("url"), "crawl-frontier")
            n = -(-held.count() // step)
            for k in range(n):
                mine = F.pmod(F.xxhash64("url"), F.lit(n)) == k
                yield held.where(mine), None, mine

    try:
        for level in range(depth + 1):
            rows = links = 0
            for some, listed, mine in parts(front, few):
                if stop is not None and stop.is_set():
                    break
                done = visit(some, listed, level)
                rows, links = rows + done["rows"], links + done["links"]
                here = log.rows().where((F.col("depth") == level) & mine) if done["rows"] else None
                if keeps and here is not None:
                    blank = [F.lit("").alias(c) for c in ("etag", "last_modified")]
                    cache.upsert(here.where("markdown is not null").select("url", "title", "markdown", *blank, "content_hash"), now)
                if on_level is not None and here is not None:
                    on_level(level, here.select(*RESULT_COLUMNS))
            if not rows or not links or (stop is not None and stop.is_set()):
                break
            front = log.rows().where(F.col("depth") == level).select(F.explode("links").alias("url")).where("url <> ''").where(fits).distinct().repartition(log.n, "url")
            front = front.join(log.rows().select("url"), "url", "left_anti")
            few = None
            if links <= FEW:
                few = [r["url"] for r in front.collect()]
                if not few:
                    break
                front = spark.createDataFrame([(u,) for u in few], "url string")
        columns = [*RESULT_COLUMNS, *(("title", "markdown", "content_hash") if content else ())]
        return spark.read.schema(LOG).parquet(log.path).select(*columns) if _written(spark, log.path) else spark.createDataFrame([], LOG).select(*columns)
    finally:
        log.detach()
        if store is not None and store is not web:
            store.table.detach()


def _written(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


URLSET = "url ARRAY<STRUCT<loc: STRING>>"
INDEX = "sitemap ARRAY<STRUCT<loc: STRING>>"


def sitemap_locs(bodies: DataFrame) -> DataFrame:
    """``bodies(url, body)`` -> ``(kind, loc)``: pages of urlsets and children of indexes; what isn't XML gives none."""
    keep = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
    root = F.regexp_extract("body", r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<([A-Za-z:]+)", 1)
    read = bodies.select(root.alias("root"), F.from_xml("body", URLSET, keep).alias("u"), F.from_xml("body", INDEX, keep).alias("s"))
    page = read.where("root = 'urlset'").select(F.lit("page").alias("kind"), F.explode("u.url.loc").alias("loc"))
    child = read.where("root = 'sitemapindex'").select(F.lit("child").alias("kind"), F.explode("s.sitemap.loc").alias("loc"))
    return page.unionByName(child).where("loc is not null and loc <> ''")


def expand_sitemap(web: DataFrame | Callable[[DataFrame], DataFrame], url: str, max_depth: int = 5, spark: SparkSession | None = None) -> DataFrame:
    """``(url)`` of all pages of a sitemap and its children, repeats kept; failing children are skipped, each child is read once."""
    spark = spark or SparkSession.active()
    frontier = spark.createDataFrame([(url,)], "url string")
    seen, pages = frontier, spark.createDataFrame([], "url string")
    for _ in range(max_depth):
        bodies = fetch(frontier, materialize(web(frontier), "crawl-fetched") if callable(web) else web).where("error is null").select("url", "body")
        locs = materialize(sitemap_locs(bodies), "crawl-sitemap")
        pages = pages.unionByName(locs.where("kind = 'page'").select(F.col("loc").alias("url")))
        frontier = locs.where("kind = 'child'").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return pages


def crawl_sitemap(spark: SparkSession, url: str, web: DataFrame | Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """All pages of a sitemap at depth 0, source ``sitemap``, filtered by the sitemap's own host; links are followed from there."""
    host = spark.range(1).select(url_host(F.lit(url)).alias("h")).first()["h"]
    return crawl(spark, expand_sitemap(web, url), web, seed_host=host, source="sitemap", **options)


def counters(results: DataFrame) -> DataFrame:
    """``(pages, new, changed, unchanged, errors)``; pages counts errors too."""
    n = lambda c: F.count(F.when(c, 1))
    return results.agg(F.count("*").alias("pages"), *[n(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged")], n(F.col("error").isNotNull()).alias("errors"))


def summary(results: DataFrame) -> DataFrame:
    """The same with pages less errors."""
    return counters(results).withColumn("pages", F.col("pages") - F.col("errors"))


#: Pages of a live crawl after which its status is written and what was found is kept.
STATUS_PAGES = 10


class CrawlJobs:
    """Background crawls with a status file each: starting, running, then completed, failed or stopped; live ones go in steps of STATUS_PAGES pages."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        os.makedirs(path, exist_ok=True)
        self._running: dict[str, tuple[threading.Thread, threading.Event]] = {}

    def _write(self, status: dict) -> None:
        status["updated_at"] = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
        fd, tmp = tempfile.mkstemp(dir=self.path, suffix=".tmp")
        with os.fdopen(fd, "w") as f:
            json.dump(status, f)
        os.replace(tmp, f"{self.path}/{status['id']}.json")

    def announce(self, seed: str) -> str:
        """A new job's id, with a status file that says it is starting."""
        job = f"c_{secrets.token_hex(4)}"
        self._write({"id": job, "pid": os.getpid(), "seed": seed, "status": "starting", "pages": 0, "new": 0, "changed": 0, "unchanged": 0, "errors": 0, "started_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "error": ""})
        return job

    def start(self, seed: str, web: DataFrame | Callable[[DataFrame], DataFrame], job: str | None = None, sitemap: bool = False, **options) -> str:
        """Starts a crawl in a thread of its own (under an announced id, if given) and gives its id."""
        job = job or self.announce(seed)
        status = self.status(job) | {"pid": os.getpid()}
        stop = threading.Event()

        def level(_: int, rows: DataFrame) -> None:
            for k, v in counters(rows).first().asDict().items():
                status[k] += v
            self._write(status)

        def run() -> None:
            options.setdefault("step", STATUS_PAGES if callable(web) else None)
            self.spark.sparkContext.setJobGroup(job, f"crawl {seed}", True)
            status["status"] = "running"
            self._write(status)
            try:
                begin = crawl_sitemap if sitemap else crawl
                begin(self.spark, seed if sitemap else [seed], web, on_level=level, stop=stop, **options)
                status["status"] = "stopped" if stop.is_set() else "completed"
            except Exception as e:
                status["status"], status["error"] = ("stopped", "") if stop.is_set() else ("failed", str(e).splitlines()[0])
            self._write(status)

        thread = threading.Thread(target=run, daemon=True)
        self._running[job] = (thread, stop)
        thread.start()
        return job

    def status(self, job: str) -> dict:
        with open(f"{self.path}/{job}.json") as f:
            return json.load(f)

    def list(self) -> list[dict]:
        """All statuses by file name; what can't be read is left out."""
        out = []
        for name in sorted(os.listdir(self.path)):
            if name.endswith(".json"):
                with contextlib.suppress(OSError, ValueError), open(f"{self.path}/{name}") as f:
                    out.append(json.load(f))
        return out

    def wait(self, job: str, seconds: float | None = None) -> dict:
        self._running[job][0].join(seconds)
        return self.status(job)

    def stop(self, job: str) -> None:
        """Only a running crawl can be stopped; one of another process is told by a signal."""
        found = self.status(job)
        if found["status"] not in ("starting", "running"):
            raise ValueError(f"crawl {job} is not running")
        if job not in self._running:
            os.kill(found["pid"], signal.SIGTERM)
            return
        self._running[job][1].set()
        self.spark.sparkContext.cancelJobGroup(job)

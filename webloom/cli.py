"""A thin command line over the operators: ``python -m webloom.cli scrape URL...``."""

from __future__ import annotations

import argparse
import json
import os
import signal
import subprocess
import sys
import time

from pyspark.sql import functions as F

from webloom.functions.text import first_line, post_process
from webloom.functions.urls import build_query, is_bare_domain, llms_url
from webloom.operators import crawl, encode, fetch
from webloom.operators.cache import PageCache
from webloom.session import get_spark, materialize
from webloom.sources import code, docs, inputs, live, web

CONFIG = os.path.join(os.environ.get("XDG_CONFIG_HOME", os.path.expanduser("~/.config")), "webloom", "config.json")
CACHE = os.path.join(os.environ.get("XDG_CACHE_HOME", os.path.expanduser("~/.cache")), "webloom")
#: Names the job that a process crawls for.
WORKER = "WEBLOOM_CRAWL_JOB"


def _fetched(urls, a):
    """The pages of ``urls(url)`` and, for a scrape that looks for them, the llms.txt of bare domains, written once."""
    if getattr(a, "no_llms_txt", True):
        asked = urls
    else:
        asked = urls.unionByName(urls.where(is_bare_domain(F.col("url"))).select(llms_url(F.col("url")).alias("url")))
    return materialize(live.fetch_all(asked.distinct(), a.concurrency), "cli-fetched")


def _page_cache(spark, config: dict) -> PageCache:
    return PageCache(spark, os.path.join(CACHE, "pages"), inputs.duration_seconds(config["cache_ttl"], 72 * 3600))


def _pages(spark, rows, a):
    """``(url, title, markdown, error)`` of ``rows(url)``: fresh entries of the page cache first, the rest fetched and kept there."""
    urls = rows.select("url").distinct()
    if a.no_cache or a.select:
        return fetch.scrape(urls, _fetched(urls, a), selector=a.select or None, llms=not a.no_llms_txt).select("url", "title", "markdown", "error")
    cache = _page_cache(spark, inputs.load_config(CONFIG))
    known = materialize(cache.lookup(urls), "cli-known")
    missing = known.where("hit is null").select("url")
    found = materialize(fetch.scrape(missing, _fetched(missing, a), llms=not a.no_llms_txt), "cli-scraped")
    blank = [F.lit("").alias(c) for c in ("etag", "last_modified")]
    cache.upsert(found.where("error is null").select("url", "title", "markdown", *blank, "content_hash"))
    cache.compact()
    held = known.where("hit is not null").select("url", "hit.title", "hit.markdown", F.lit(None).cast("string").alias("error"))
    return held.unionByName(found.select("url", "title", "markdown", "error"))


def _scrape(spark, a) -> None:
    rows = inputs.resolve_inputs(spark, a.urls, None if sys.stdin.isatty() else sys.stdin.read().splitlines())
    if a.raw:
        urls = rows.select("url").distinct()
        pages = fetch.fetch(urls, live.fetch_all(urls, a.concurrency)).select("url", F.lit("").alias("title"), F.col("body").alias("markdown"), "error")
        text = F.col("markdown")
    else:
        pages = _pages(spark, rows, a).withColumn("markdown", post_process(F.col("markdown"), a.trim, a.max_chars))
        text = encode.page_text(F.col("url"), F.col("title"), F.col("markdown"))
    out = inputs.ordered(rows.join(pages, "url", "left"))
    for r in out.select("error", text.alias("text"), F.to_json(F.struct("url", "title", "markdown")).alias("json")).toLocalIterator():
        print(f"warn: {r['error']}" if r["error"] else r["json"] if a.json else r["text"], file=sys.stderr if r["error"] else sys.stdout)


def _search(spark, a) -> None:
    config = inputs.load_config(CONFIG)
    backend = a.backend or config["backend"]
    reader = spark.read.format("search_payload").options(**{k: str(v) for k, v in config.items()}).option("backend", backend).option("limit", a.limit)
    if a.searxng_url:
        reader = reader.option("searxng_url", a.searxng_url)
    settled = materialize(web.settle_attempts(reader.option("queries", json.dumps([a.query])).load(), backend), "cli-search")
    for r in settled.where("error is not null").select("error").collect():
        raise SystemExit(r["error"])
    results = web.web_results(settled.select(F.col("request_id").alias("query_id"), "body"), backend, a.limit)
    c = F.col
    if a.scrape:
        results = materialize(results, "cli-results")
        pages = _pages(spark, results, a).where("error is null").select("url", F.col("title").alias("page_title"), "markdown")
        results = web.scrape_results(results, pages, a.json, a.trim, a.max_chars)
        text = encode.page_text(c("url"), F.coalesce("page_title", "title"), c("content"))
    else:
        text = encode.search_line(c("url"), c("title"), c("description")) if a.minimal else encode.search_entry(c("title"), c("url"), c("description"))
    shown = encode.escaped_json(F.to_json(F.struct(*[x for x in ("title", "url", "description", "content") if x in results.columns]))) if a.json else text
    rows = results.orderBy("pos").select(shown.alias("line")).collect()
    if not (a.json or a.minimal or a.scrape):
        print(_header(spark, query=a.query, backend=backend, result_count=len(rows)))
    for r in rows:
        print(r["line"])


def _answers(spark, a, backend: str, query: str):
    """Settled answers of a backend as ``(response_id, body)``."""
    options = {k: str(v) for k, v in inputs.load_config(CONFIG).items()} | {"github_token": inputs.resolve_token(inputs.load_config(CONFIG))[0]}
    reader = spark.read.format("search_payload").options(**options).option("backend", backend).option("limit", a.limit)
    settled = materialize(web.settle_attempts(reader.option("queries", json.dumps([query])).load(), backend), "cli-answers")
    for r in settled.where("error is not null").select("error").collect():
        raise SystemExit(r["error"])
    return settled.where("error is null").select(F.col("request_id").alias("response_id"), "body")


def _code(spark, a) -> None:
    text = spark.range(1).select(build_query(a.backend, F.lit(a.query), F.lit(a.lang)).alias("q")).first()["q"]
    results = code.code_results(_answers(spark, a, a.backend, text), a.backend, a.limit)
    c = F.col
    line = encode.code_line(c("url"), c("repo"), c("snippet")) if a.minimal else encode.code_entry(c("repo"), c("path"), c("line"), c("stars"), c("snippet"), c("url"))
    rows = results.orderBy("pos").select(line.alias("line")).collect()
    if not a.minimal:
        print(_header(spark, query=a.query, lang=a.lang or None, backend=a.backend, result_count=len(rows)))
    for r in rows:
        print(r["line"])


def _header(spark, **fields) -> str:
    """What stands before a list of results; fields that are None are left out."""
    columns = [(k, F.lit(None if v is None else str(v)).cast("string")) for k, v in fields.items()]
    return spark.range(1).select(encode.header(columns).alias("t")).first()["t"]


def _docs(spark, a) -> None:
    if a.backend == "local":
        if not a.path:
            raise SystemExit("the local backend searches the files under --path")
        files = spark.read.text(a.path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        files = materialize(files.withColumn("doc_id", F.monotonically_increasing_id()), "cli-files")
        found = docs.local_search(files, spark.createDataFrame([(0, a.query)], "query_id int, text string"), a.limit).join(files, "doc_id")
        line = encode.docs_line(F.col("file"), F.lit("local"), F.col("text")) if a.minimal else encode.docs_entry(F.lit("local"), F.lit(""), first_line(F.col("text")), F.col("file"))
        for r in found.orderBy("rank").select(line.alias("line")).collect():
            print(r["line"])
        return
    found = docs.resolve_library(_answers(spark, a, "context7", a.library or a.query))
    if a.resolve:
        for r in found.orderBy("pos").collect():
            print(f"{r['id']}\t{r['title']}\t{r['description'] or ''}")
        return
    top = a.library or next((r["library"] for r in docs.top_library(found).collect()), None)
    if top is None:
        raise SystemExit(f"no library found for {a.query!r}")
    answer = _answers(spark, a, "context7-docs", json.dumps([top, a.query, a.tokens])).withColumn("library", F.lit(top))
    c = F.col
    line = encode.docs_line(c("url"), c("library"), c("snippet")) if a.minimal else encode.docs_entry(c("title"), c("breadcrumb"), c("snippet"), c("url"))
    for r in docs.docs_results(answer).orderBy("part", "k").select(line.alias("line")).collect():
        print(r["line"])


def _crawl(spark, a) -> None:
    """Fetches level by level on the executors; with ``--background`` in a process of its own; ``status`` and ``stop`` are about those."""
    jobs = crawl.CrawlJobs(spark, os.path.join(CACHE, "crawls"))
    if a.seed == "status":
        for s in [jobs.status(a.job)] if a.job else jobs.list():
            print(json.dumps(s))
        return
    if a.seed == "stop":
        jobs.stop(a.job)
        return
    if a.background:
        job = jobs.announce(a.seed)
        rest = [x for x in a.given if x != "--background"]
        subprocess.Popen([sys.executable, "-m", "webloom.cli", *rest], env=os.environ | {WORKER: job}, start_new_session=True, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        print(job)
        return
    get = lambda urls: live.fetch_all(urls, a.concurrency)
    options = {"depth": a.depth, "allow": a.allow, "deny": a.deny}
    if not a.no_cache:
        options["cache"] = _page_cache(spark, inputs.load_config(CONFIG))
    if job := os.environ.get(WORKER):
        jobs.start(a.seed, get, job, a.sitemap, **options)
        signal.signal(signal.SIGTERM, lambda *_: jobs.stop(job))
        jobs.wait(job)
        return
    began = time.monotonic()
    found = materialize(crawl.crawl_sitemap(spark, a.seed, get, **options) if a.sitemap else crawl.crawl(spark, [a.seed], get, **options), "cli-crawl")
    for r in found.orderBy("depth", "url").toLocalIterator():
        print(json.dumps(r.asDict()))
    print(crawl.summary(found).select(encode.summary_text(F.lit(a.seed), ("pages", "new", "changed", "unchanged", "errors"), F.lit(round(time.monotonic() - began, 1))).alias("t")).first()["t"], file=sys.stderr)


def _cache(spark, a) -> None:
    c = PageCache(spark, a.path)
    if a.clear:
        c.clear()
        return
    print(c.stats().select(encode.cache_text(a.path, F.col("entries"), F.col("bytes"), "72h").alias("t")).first()["t"])


def _config(_spark, a) -> None:
    """Shows the settings; ``init`` writes the built-in ones where there are none, ``path`` says where they are, a key and a value set one."""
    if a.key == "path":
        print(CONFIG)
        return
    if a.key == "init":
        if os.path.exists(CONFIG):
            raise SystemExit(f"config already exists: {CONFIG}")
        inputs.save_config(CONFIG, dict(inputs.DEFAULTS))
        print(f"created {CONFIG}", file=sys.stderr)
        return
    config = inputs.load_config(CONFIG)
    if a.key:
        config = inputs.set_config(config, a.key, a.value)
        inputs.save_config(CONFIG, config)
    print(json.dumps(inputs.discover(config), indent=2))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="webloom")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scrape")
    s.add_argument("urls", nargs="*")
    s.add_argument("--json", action="store_true")
    s.add_argument("--select")
    s.add_argument("--trim", action="store_true")
    s.add_argument("--max-chars", type=int, default=0)
    s.add_argument("--raw", action="store_true")
    s.add_argument("--no-cache", action="store_true")
    s.add_argument("--no-llms-txt", action="store_true")
    s.add_argument("--concurrency", type=int, default=5)
    s.set_defaults(run=_scrape)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--backend", choices=inputs.BACKENDS["web"])
    s.add_argument("--limit", type=int, default=5)
    s.add_argument("--minimal", action="store_true")
    s.add_argument("--json", action="store_true")
    s.add_argument("--scrape", action="store_true")
    s.add_argument("--searxng-url")
    s.add_argument("--max-chars", type=int, default=0)
    s.add_argument("--trim", action="store_true")
    s.set_defaults(run=_search, no_cache=False, no_llms_txt=False, select=None, concurrency=5)
    s = sub.add_parser("code")
    s.add_argument("query")
    s.add_argument("--backend", choices=inputs.BACKENDS["code"], default="sourcegraph")
    s.add_argument("--lang", default="")
    s.add_argument("--limit", type=int, default=5)
    s.add_argument("--minimal", action="store_true")
    s.set_defaults(run=_code)
    s = sub.add_parser("docs")
    s.add_argument("query")
    s.add_argument("--backend", choices=inputs.BACKENDS["docs"], default="context7")
    s.add_argument("--library", default="")
    s.add_argument("--path", default="", help="files that the local backend searches")
    s.add_argument("--tokens", type=int, default=docs.DEFAULT_TOKENS)
    s.add_argument("--limit", type=int, default=5)
    s.add_argument("--resolve", action="store_true")
    s.add_argument("--minimal", action="store_true")
    s.set_defaults(run=_docs)
    s = sub.add_parser("crawl")
    s.add_argument("seed", help="a url, or status or stop with a crawl's id")
    s.add_argument("job", nargs="?")
    s.add_argument("--sitemap", action="store_true")
    s.add_argument("--no-cache", action="store_true")
    s.add_argument("--background", action="store_true")
    s.add_argument("--depth", type=int, default=3)
    s.add_argument("--concurrency", type=int, default=8)
    s.add_argument("--allow", action="append", default=[])
    s.add_argument("--deny", action="append", default=[])
    s.set_defaults(run=_crawl)
    s = sub.add_parser("cache")
    s.add_argument("path")
    s.add_argument("--clear", action="store_true")
    s.set_defaults(run=_cache)
    s = sub.add_parser("config")
    s.add_argument("key", nargs="?")
    s.add_argument("value", nargs="?", default="")
    s.set_defaults(run=_config)
    a = p.parse_args(argv)
    a.given = sys.argv[1:] if argv is None else argv
    spark = None if a.command == "config" else get_spark("webloom-cli")
    if spark is not None:
        live.register(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()

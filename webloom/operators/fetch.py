"""Fetching as joins with snapshot relations: the web is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.text import content_hash
from webloom.functions.urls import is_bare_domain, llms_url

#: Bytes of a body that are kept.
BODY_CAP = 20 << 20


def capped(body: Column) -> Column:
    """The body's first BODY_CAP bytes."""
    return F.when(F.octet_length(body) > BODY_CAP, F.decode(F.substring(F.encode(body, "UTF-8"), 1, BODY_CAP), "UTF-8")).otherwise(body)


def asked_for(big: DataFrame, urls: DataFrame, key: str = "url") -> DataFrame:
    """The rows of ``big`` that ``urls(url)`` asks for.

    A left join keeps its left side, so Spark could only broadcast ``big`` there. This semi join can broadcast the urls,
    where Spark finds them small enough, so that a short frontier filters ``big`` beside its scan and nothing else is shuffled.
    """
    return big.join(urls.select(F.col("url").alias(key)).distinct(), key, "left_semi")


def one_snapshot(web: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """For each url (of ``urls(url)``, if given) that ``web`` knows one row: of several a good status first, then the least status and columns in the order of ``web``."""
    rest = [c for c in web.columns if c != "url"]
    bad = (F.coalesce("status", F.lit(0)) != 200) if "status" in rest else F.lit(False)
    rest.sort(key=lambda c: c != "status")
    best = (web if urls is None else asked_for(web, urls)).groupBy("url").agg(F.min(F.struct(bad.alias("__bad"), *rest)).alias("__w"))
    return best.select("url", *[F.col(f"__w.{c}").alias(c) for c in rest])


def fetch(frontier: DataFrame, web: DataFrame, every: bool = False) -> DataFrame:
    """``frontier(url, ...)`` with ``body`` and ``error`` from ``web(url, status, body)``.

    A status other than 200 and a url that ``web`` doesn't know are error rows, never lost rows; several
    snapshots of a url are one, see :func:`one_snapshot`, or a row each where ``every`` one is asked for.
    """
    known = web.select("url", "status", "body")
    got = frontier.join(asked_for(known, frontier) if every else one_snapshot(known, frontier), "url", "left")
    error = (
        F.when(F.col("status").isNull(), F.concat(F.lit("no snapshot of "), F.col("url")))
        .when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" for "), F.col("url")))
    )
    return got.withColumn("error", error).withColumn("body", F.when(F.col("error").isNull(), capped(F.col("body")))).drop("status")


def fetch_conditional(requests: DataFrame, web: DataFrame) -> DataFrame:
    """``requests(url, etag, last_modified)``: ``not_modified`` where a validator that was sent still holds; its body isn't read."""
    w = one_snapshot(web.select("url", "status", "body", F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_last_modified")), requests)
    got = requests.join(w, "url", "left")
    sent = lambda a, b: (F.coalesce(F.col(a), F.lit("")) != "") & F.col(a).eqNullSafe(F.col(b))
    got = got.withColumn("not_modified", sent("etag", "new_etag") | sent("last_modified", "new_last_modified"))
    return got.withColumn("body", F.when(~F.col("not_modified"), capped(F.col("body"))))


def render_fallback(pages: DataFrame, rendered: DataFrame, forced: Column | None = None) -> DataFrame:
    """``pages(url, body, ...)``: the rendered page where detection says shell (or ``forced``) and a rendering exists.

    Adds ``js_detection`` and ``html``; a missing rendering keeps the fetched page.
    """
    signals = pages.withColumn("__signals", H.html_signals(F.col("body")))
    found = signals.withColumn("js_detection", F.when(F.col("body").isNotNull(), H.detect_js_shell(F.col("__signals"), F.col("body")))).drop("__signals")
    want = F.col("js_detection") == "likely_shell"
    want = want if forced is None else want | forced
    out = found.join(one_snapshot(rendered.select("url", F.col("html").alias("__rendered")), pages), "url", "left")
    return out.withColumn("html", F.when(want, F.coalesce("__rendered", "body")).otherwise(F.col("body"))).drop("__rendered")


def read_pages(pages: DataFrame, *want: str, rendered: DataFrame | None = None, forced: Column | None = None) -> DataFrame:
    """``pages(url, body, ...)`` with ``page`` (the fields of ``html.read_page`` that are wanted) and ``js_detection``.

    A fetched page is parsed once, for its signals and whatever else is wanted. A rendering is parsed
    only where it takes the page's place: where detection says shell or ``forced`` does; then a forced page
    isn't parsed at all if there is a rendering. Without ``rendered`` nothing is detected.
    """
    if rendered is None:
        return pages.withColumn("page", H.read_page(F.col("url"), F.col("body"), *want)).withColumn("js_detection", F.lit(None).cast("string"))
    held = pages.join(one_snapshot(rendered.select("url", F.col("html").alias("__rendered")), pages), "url", "left")
    force = (F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))) & F.col("__rendered").isNotNull()
    held = held.withColumn("__first", H.read_page(F.col("url"), F.when(~force, F.col("body")), "signals", *want))
    held = held.withColumn("js_detection", F.when(F.col("__first").isNotNull(), H.detect_js_shell(F.col("__first"), F.col("body"))))
    again = (force | (F.col("js_detection") == "likely_shell")) & F.col("body").isNotNull()
    held = held.withColumn("__again", H.read_page(F.col("url"), F.when(again, F.col("__rendered")), *want))
    fields = [f.split()[0] for w in H.READ if w in want for f in H.READ[w].split(", ")]
    page = F.struct(*[F.coalesce(F.col(f"__again.{f}"), F.col(f"__first.{f}")).alias(f) for f in fields])
    return held.withColumn("page", F.when(F.col("__again").isNotNull() | F.col("__first").isNotNull(), page)).drop("__rendered", "__first", "__again")


def scrape(frontier: DataFrame, web: DataFrame, rendered: DataFrame | None = None, selector: str | None = None, llms: bool = True) -> DataFrame:
    """``(url, title, markdown, content_hash, error)``: fetch, render if a shell, extract.

    Precedence: a selector wins over llms.txt, that over the page. A selector that meets nothing is an error.
    """
    got = fetch(frontier, web)
    if selector:
        pages = got.withColumn("html", F.col("body")) if rendered is None else render_fallback(got, rendered)
        md = F.when(F.col("error").isNull(), H.extract_selector(F.col("html"), selector))
        pages = pages.withColumn("title", F.lit("")).withColumn("markdown", md)
        missed = F.when(F.col("markdown") == "", F.concat(F.lit("no match for selector in "), F.col("url")))
        pages = pages.withColumn("error", F.coalesce("error", missed))
    else:
        bad = F.when(F.coalesce(F.col("url").rlike(r"[\x00-\x1f\x7f]"), F.lit(True)), F.concat(F.lit("invalid url: "), F.coalesce("url", F.lit("None"))))
        pages = read_pages(got.withColumn("error", F.coalesce("error", bad)), "main", rendered=rendered)
        pages = pages.withColumn("title", F.when(F.col("error").isNull(), F.col("page.title"))).withColumn("markdown", F.when(F.col("error").isNull(), F.col("page.markdown")))
        found = llms_pages(frontier.select("url").distinct(), web) if llms else frontier.select("url").distinct().withColumn("llms_markdown", F.lit(None).cast("string"))
        pages = pages.join(found, "url", "left")
        hit = F.col("llms_markdown").isNotNull()
        pages = pages.withColumn("title", F.when(hit, F.lit("llms.txt")).otherwise(F.col("title"))).withColumn("markdown", F.coalesce("llms_markdown", "markdown"))
        pages = pages.withColumn("error", F.when(~hit, F.col("error")))
    return pages.select("url", "title", "markdown", F.when(F.col("error").isNull(), content_hash(F.col("markdown"))).alias("content_hash"), "error")


def llms_pages(frontier: DataFrame, web: DataFrame) -> DataFrame:
    """``(url, llms_markdown)`` for bare domains whose llms.txt is plain text and answers 200."""
    bare = frontier.where(is_bare_domain(F.col("url"))).select("url", llms_url(F.col("url")).alias("__llms"))
    have = web.where((F.col("status") == 200) & F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/plain")))
    have = one_snapshot(have.select("url", "body"), bare.select(F.col("__llms").alias("url")))
    return bare.join(have.select(F.col("url").alias("__llms"), capped(F.col("body")).alias("llms_markdown")), "__llms").select("url", "llms_markdown")

"""Web search payloads as relations: JSON and HTML result pages, retries, and results joined with pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.text import post_process
from webloom.functions.urls import unwrap_redirect

_HIT = "ARRAY<STRUCT<title: STRING, url: STRING, {d}: STRING>>"
#: backend -> (schema of the payload, path of its results, field of the description)
JSON_BACKENDS = {
    "brave": (f"web STRUCT<results: {_HIT.format(d='description')}>", "web.results", "description"),
    "searxng": (f"results {_HIT.format(d='content')}", "results", "content"),
}
TRIES = 3


def web_results(payloads: DataFrame, backend: str, limit: int) -> DataFrame:
    """``payloads(query_id, body)`` -> ``(query_id, pos, title, url, description)``; the backend's order, the first ``limit``.

    ``brave`` and ``searxng`` are JSON, ``ddg`` is an HTML page whose links are unwrapped. A body
    that can't be read gives no results; a limit of 0 or less gives none.
    """
    if backend == "ddg":
        hit = payloads.select("query_id", F.posexplode(H.search_hits(F.col("body"))).alias("pos", "h"))
        out = hit.select("query_id", "pos", "h.title", unwrap_redirect(F.col("h.href")).alias("url"), "h.description")
    elif backend in JSON_BACKENDS:
        schema, path, description = JSON_BACKENDS[backend]
        read = payloads.select("query_id", F.from_json("body", schema).alias("x")).select("query_id", F.posexplode(f"x.{path}").alias("pos", "h"))
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        out = read.select("query_id", "pos", text("h.title").alias("title"), text("h.url").alias("url"), text(f"h.{description}").alias("description"))
    else:
        raise ValueError(f"unknown web backend {backend!r}")
    return out.where(F.col("pos") < limit)


def settle_attempts(attempts: DataFrame, backend: str | None = None) -> DataFrame:
    """``attempts(request_id, attempt, status, body)`` -> ``(request_id, attempt, status, body, error)``.

    Up to three tries; only a 202 is tried again; the first other answer counts. With a ``backend`` that has keys and limits, its
    errors say so, see :func:`payload_error`.
    """
    tried = attempts.where(F.col("attempt") <= TRIES)
    final = tried.groupBy("request_id").agg(
        F.min(F.when(F.col("status") != 202, F.struct("attempt", "status", "body"))).alias("f"),
        F.max(F.struct("attempt", "status", "body")).alias("last"),
    )
    got = final.select("request_id", F.coalesce("f", "last").alias("x")).select("request_id", "x.*")
    error = F.when(F.col("status") != 200, F.concat(F.lit("search returned status "), F.col("status").cast("string")))
    if backend not in (None, "ddg"):
        error = payload_error(backend, F.col("status"))
    return got.select("request_id", "attempt", "status", F.when(F.col("status") == 200, F.col("body")).alias("body"), error.alias("error"))


def scrape_results(results: DataFrame, pages: DataFrame, keep_failures: bool, trim: bool = False, max_chars: int = 0) -> DataFrame:
    """Results with ``content`` of ``pages(url, page_title, markdown)``; JSON output keeps those without a page, text output drops them."""
    got = results.join(pages, "url", "left" if keep_failures else "inner")
    return got.withColumn("content", post_process(F.col("markdown"), trim, max_chars)).drop("markdown")


def payload_error(backend: str, status: Column) -> Column:
    """What a backend's answer means."""
    return (
        F.when(status == 200, F.lit(None))
        .when(status == 401, F.lit(f"{backend}: invalid API key"))
        .when(status.isin(*((403, 429) if backend == "github" else (429,))), F.lit(f"{backend}: rate limited"))
        .otherwise(F.concat(F.lit(f"{backend} returned status "), status.cast("string")))
    )

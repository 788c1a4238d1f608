"""Code search payloads as relations: server-sent events and nested JSON, with a stars lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import matched_line, utrim
from webloom.functions.urls import code_permalink

MATCHES = "ARRAY<STRUCT<type: STRING, repository: STRING, path: STRING, language: STRING, repoStars: INT, lineMatches: ARRAY<STRUCT<line: STRING, lineNumber: INT>>>>"
ITEMS = "items ARRAY<STRUCT<path: STRING, html_url: STRING, repository: STRUCT<full_name: STRING, node_id: STRING>, text_matches: ARRAY<STRUCT<fragment: STRING, matches: ARRAY<STRUCT<indices: ARRAY<INT>>>>>>>"
COLUMNS = ("response_id", "pos", "repo", "path", "line", "snippet", "language", "stars", "url", "source")


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def sourcegraph_results(responses: DataFrame, limit: int, base_url: str = "https://sourcegraph.com") -> DataFrame:
    """``responses(response_id, body)``: ``matches`` events of a stream, the first line match of each file, in stream order.

    An event's type holds for the data lines after it. A data line that isn't JSON is skipped.
    """
    lines = responses.select("response_id", F.posexplode(F.split("body", "\r?\n")).alias("at", "line"))
    kind = F.when(F.startswith("line", F.lit("event:")), utrim(F.substring("line", 7, 1 << 20)))
    order = Window.partitionBy("response_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sticky = lines.withColumn("event", F.last(kind, ignorenulls=True).over(order))
    data = sticky.where(F.startswith("line", F.lit("data:")) & (F.col("event") == "matches"))
    found = data.select("response_id", "at", F.posexplode(F.from_json(utrim(F.substring("line", 6, 1 << 30)), MATCHES)).alias("k", "m"))
    kept = found.where((F.col("m.type") == "content") & (F.size("m.lineMatches") > 0)).withColumn("first", F.get("m.lineMatches", F.lit(0)))
    ranked = kept.withColumn("pos", F.row_number().over(Window.partitionBy("response_id").orderBy("at", "k")) - 1).where(F.col("pos") < limit)
    line = F.coalesce("first.lineNumber", F.lit(0))
    return ranked.select(
        "response_id", "pos", _text("m.repository").alias("repo"), _text("m.path").alias("path"), line.alias("line"), _text("first.line").alias("snippet"), _text("m.language").alias("language"),
        F.coalesce("m.repoStars", F.lit(0)).alias("stars"), code_permalink(F.lit(base_url), _text("m.repository"), _text("m.path"), line).alias("url"), F.lit("sourcegraph").alias("source"),
    )


def github_results(responses: DataFrame, limit: int, stars: DataFrame | None = None) -> DataFrame:
    """``responses(response_id, body)`` with the matched line as snippet and stars by repository id (unknown: 0).

    The limit is checked after a result is taken, so 0 or less still gives one.
    """
    read = responses.select("response_id", F.posexplode(F.from_json("body", ITEMS)["items"]).alias("pos", "i")).where(F.col("pos") < max(limit, 1))
    match = F.get("i.text_matches", F.lit(0))
    offset = F.get(F.get(match["matches"], F.lit(0))["indices"], F.lit(0))
    snippet = F.when(match.isNotNull(), matched_line(F.coalesce(match["fragment"], F.lit("")), F.coalesce(offset, F.lit(-1)))).otherwise(F.lit(""))
    out = read.select("response_id", "pos", _text("i.repository.full_name").alias("repo"), _text("i.path").alias("path"), F.lit(0).alias("line"), snippet.alias("snippet"), F.lit("").alias("language"), F.col("i.repository.node_id").alias("node_id"), _text("i.html_url").alias("url"), F.lit("github").alias("source"))
    if stars is None:
        out = out.withColumn("stars", F.lit(0))
    else:
        out = out.join(stars.select("node_id", "stars"), "node_id", "left").withColumn("stars", F.coalesce("stars", F.lit(0)))
    return out.select(*COLUMNS)


def star_ids(responses: DataFrame) -> DataFrame:
    """``(response_id, ids)``: repository ids for one batched lookup, repeats kept, in order."""
    read = responses.select("response_id", F.from_json("body", ITEMS)["items"].alias("i"))
    ids = F.filter(F.transform("i", lambda x: x["repository"]["node_id"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return read.select("response_id", ids.alias("ids"))


def code_results(responses: DataFrame, backend: str, limit: int, stars: DataFrame | None = None) -> DataFrame:
    if backend == "sourcegraph":
        return sourcegraph_results(responses, limit)
    if backend == "github":
        return github_results(responses, limit, stars)
    raise ValueError(f"unknown code backend {backend!r}")
